from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelwright.operators.records import render
from labelwright.operators.scoring import keyword_answer
from labelwright.plans import probe_results as pr
from labelwright.plans import probe_sets as ps
from labelwright.vocab import LOGISTICS


@pytest.fixture(scope="module")
def records(spark):
    rows = []
    for i in range(60):
        row = {f: f"{f[:3]}{i}" for f in LOGISTICS.fields}
        row["Shipment_Status"] = ["Delayed", "Delivered", "In Transit"][i % 3]
        row["Traffic_Status"] = ["Heavy", "Detour", "Clear", "Clear"][i % 4]
        row["Waiting_Time"] = "60" if i % 5 == 0 else "10"
        row["Logistics_Delay_Reason"] = None if i % 2 else "Traffic"
        row["row_id"], row["gold"] = i, int(row["Shipment_Status"] == "Delayed" or row["Traffic_Status"] == "Heavy")
        rows.append(row)
    return render(spark.createDataFrame(pd.DataFrame(rows)), LOGISTICS.fields).cache()


def test_plan_sizes(spark):
    plan = ps.full_plan(LOGISTICS)
    groups = Counter(r.probe_group for r in ps.spec_table(spark, LOGISTICS).collect())
    assert groups == {"counterfactual": 37, "robustness": 63, "ood": 4} and len(plan) == 100
    roles = Counter(e.meta.get("role") for e in plan)
    assert roles["rule"] == 4 and roles["pair"] == 2 and roles["single"] == 30
    assert roles["variant"] == 24 and roles["control"] == 24 and roles["order"] == 3 and roles["trigger"] == 6
    assert len(ps.non_rule_edits(LOGISTICS)) == 32 and len(ps.renames(LOGISTICS)) == 3 and len(ps.removals(LOGISTICS)) == 3


def test_cohort_sizes_and_touched_lines(spark, records):
    pdf = records.toPandas()
    d, h, g = pdf.Shipment_Status == "Delayed", pdf.Traffic_Status == "Heavy", pdf.gold == 1
    size = {"all": 60, "negatives": (~g).sum(), "positives": g.sum(), "first_only": (d & ~h).sum(),
            "second_only": (h & ~d).sum(), "first": d.sum(), "second": h.sum()}
    plan = {e.key: e for e in ps.full_plan(LOGISTICS)}
    probes = ps.build_probes(records.withColumn("before", F.col("text")), LOGISTICS, keep=("before",)).toPandas()
    assert {k: v for k, v in probes.groupby("probe_key").size().items()} == {k: size[e.cohort] for k, e in plan.items()}
    for r in probes.itertuples():
        e = plan[r.probe_key]
        before, after = r.before.split("\n"), r.text.split("\n")
        if e.meta.get("role") == "order":
            assert sorted(before) == sorted(after) and before != after
        elif all(s.op == "set" for s in e.steps):
            changed = {a.split(":")[0] for a, b in zip(before, after, strict=True) if a != b}
            assert changed <= {s.name for s in e.steps}
            assert all(f"{s.name}: {s.value}" in after for s in e.steps)
        elif e.steps[0].op == "append":
            assert after[:-1] == before
        elif e.steps[0].op == "drop":
            assert len(after) == 15 - len(e.steps)
        else:
            assert len(after) == 15 and sum(a != b for a, b in zip(before, after, strict=True)) == len(e.steps)


def test_results_and_summary(spark, records):
    spec = ps.spec_table(spark, LOGISTICS)
    probes = ps.build_probes(records.withColumn("original", F.col("text")), LOGISTICS, keep=("gold", "original"))
    answer = keyword_answer(F.col("text"), LOGISTICS.target, ("delay", "heav"))
    scored = pr.score_probes(probes, lambda df: df.withColumn("raw", answer), LOGISTICS)
    res = {r.probe_key: r for r in pr.probe_results(scored, spec).collect()}
    assert len(res) == 100
    assert res["negatives_traffic_to_Heavy"].positive_rate == 1.0 and res["negatives_traffic_to_Heavy"].agree_rule_on_text == 1.0
    assert res["rename_status_only"].agree_rule_on_text is None and res["rename_status_only"].agree_remaining is None
    assert res["only_status_removed"].agree_remaining == 1.0 and res["only_status_removed"].agree_rule_on_text is None
    assert res["value_Delayed_to_Not_Delayed"].positive_rate == 1.0  # the stem scorer cannot read negation
    row = pr.counterfactual_summary(scored, spec).first()
    pdf = records.toPandas()
    neg, pos = int((pdf.gold == 0).sum()), int((pdf.gold == 1).sum())
    assert row.non_rule_edits == 16 * (neg + pos) and row.two_field_edits == neg + pos
    assert row.fields_probed == 13 and row.changed_predictions == 0 and row.rule_edits == row.rule_edits_flipped
    waiting = pdf.Waiting_Time.astype(str) == "60"
    reason = pdf.Logistics_Delay_Reason
    # the pair edits set a second field as well, so only single-field edits can be no-ops here
    assert row.no_op_edits == waiting.sum() + (reason == "Traffic").sum() + reason.isna().sum()


def test_duplicate_keys_and_unknown_cohorts_are_refused(records):
    from labelwright.operators.edits import Edit, apply_plan, set_to

    e = Edit("k", "g", "all", (set_to("Waiting_Time", "1"),))
    with pytest.raises(ValueError, match="unique"):
        apply_plan(records, [e, e], {"all": F.lit(True)})
    with pytest.raises(ValueError, match="undefined"):
        apply_plan(records, [e], {})


def test_first_steps_equal_single_edits(spark):
    from labelwright.operators import edits as ed

    texts = ["a: 1\nb: 2\nc: 3", "b: x\nb: y\na: \nc:", "c: 1\na: b: 2\nb: é z", "a: 1\nb: 2\nc: 3\nc: 4"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, text string")
    plan = [ed.Edit("set_a", "g", "all", (ed.set_to("a", "9"),)), ed.Edit("set_b", "g", "all", (ed.set_to("b", " 8 "),)),
            ed.Edit("both", "g", "all", (ed.set_to("b", "7"), ed.set_to("a", "6"))), ed.Edit("none", "g", "all", ()),
            ed.Edit("drop", "g", "all", (*ed.drop("b"), ed.Step("append", "", "end"))), ed.Edit("named", "g", "all", (ed.Step("rename", "b", "d"),)),
            ed.Edit("order", "g", "all", (ed.reorder("cab"),)), ed.Edit("other", "g", "all", (ed.reorder("bca"), ed.set_to("c", "5"))),
            ed.Edit("two", "g", "all", (ed.reorder("ab"),)), ed.Edit("absent", "g", "all", (ed.set_to("z", "1"),))]
    got = {(r.probe_key, r.row_id): r.text for r in ed.apply_plan(df, plan, {"all": F.lit(True)}, on_error="null").collect()}
    assert len(got) == len(plan) * len(texts)
    for e in plan:
        for r in ed.edit_column(df, "text", e.steps, "after", on_error="null").collect():
            assert got[e.key, r.row_id] == r.after, e.key
    # the lookups in a text stand before the explosion: once per record, not once per probe
    assert ed._prepared(plan) == (["a", "b", "z"], [("a", "b", "c"), ("a", "b")])


def test_tails_are_cut_out_as_the_pattern_matches_them(spark):
    from labelwright.functions import text as tx

    texts = ["N: 1", "a\nN:", "N: 1\nN: 2", "N: 1\n N : 3\nb", "b: N: 2", "N: see N:", "xN: 1", "N", "", None, "N:1\n\tN", "N: é\r\nN : \n", "a: N\nN:4\nc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("after", tx.after_line(F.col("t"), "N"))
    for r in df.select("t", tx.last_line_tail(F.col("t"), "N").alias("a"), tx.last_line_tail(F.col("t"), "N", F.col("after")).alias("b")).collect():
        assert r.a == r.b, r.t


def test_only_rows_near_the_first_are_ordered(spark):
    from labelwright.operators import splits

    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 20_011).alias("o"), F.col("id").cast("string").alias("v"))
    odd = spark.createDataFrame([(7, 5, "a"), (7, 5, "a"), (8, None, "n"), (None, 1, "x")], "g bigint, o bigint, v string")
    both = df.unionByName(odd)
    assert splits._near_first(both, ["g"], "o", 4).filter("g < 3").count() < 300
    few = {r.g: r.examples for r in splits.examples(both, ["g"], "o", "v", 4, few_groups=True).collect()}
    assert few == {r.g: r.examples for r in splits.examples(both, ["g"], "o", "v", 4).collect()} and len(few) == 6


def test_tasks_of_probes_do_not_grow_with_the_table(spark, monkeypatch):
    from checks import views
    from labelwright import session

    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    plan = ps.line_shuffles(views.RECORDS)
    assert ps.build_probes(views.texts_table(spark, sf), views.RECORDS, plan).rdd.getNumPartitions() >= orders / 50


def test_answers_by_place_equal_the_pattern(spark):
    import re

    texts = ["a: x", "Delay_b: 1", "Delay_b: heavy", "a: DELAYed", "delay\na: 1", "delay: delay", "x: a\n:heav", "heav\nb: 1\nDelay: c", "", None,
             "delay delay\nq: 1", "é: dElAy", "delay\n\nheav: heav", "a\r: delay"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", keyword_answer(F.col("t"), "T", ("delay", "Heav")).alias("a"), keyword_answer(F.col("t"), "T", ("kilo", "delay|heav")).alias("b")).collect():
        plain = r.t is not None and any(re.search("delay|heav", ln.partition(":")[2], re.I) for ln in r.t.split("\n"))
        assert r.a == r.b == f"T: {int(plain)}", r.t
