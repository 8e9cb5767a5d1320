import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelwright.operators import conditions as cond
from labelwright.operators.models import ModelSpec, fit_and_score
from labelwright.operators.trees import tree_cv
from labelwright.plans.label_audit import audit


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(0)
    n = 1000
    status = rng.choice(["Delayed", "Delivered", "In Transit"], n)
    traffic = rng.choice(["Heavy", "Detour", "Clear"], n)
    reason = rng.choice(["Weather", "Traffic", None], n)
    y = ((status == "Delayed") | (traffic == "Heavy")).astype(int)
    wait = rng.integers(0, 60, n).astype(float)
    wait[:50] = np.nan
    return pd.DataFrame({"id": range(n), "status": status, "traffic": traffic, "reason": reason, "wait": wait, "y": y})


COLUMNS = ["status", "traffic", "reason", "wait"]


def test_planted_rule_is_recovered(spark, planted):
    parts = audit(spark.createDataFrame(planted), "y", COLUMNS, tree=True, keys=["id"])
    pure = {r.condition for r in parts["pure_conditions"].collect()}
    assert {'status == "Delayed"', 'traffic == "Heavy"'} <= pure
    rule = parts["rule"].first()
    assert rule.mismatches == 0 and rule.n_conditions == 2 and rule.accuracy == 1.0
    assert set(rule.rule.split(" OR ")) == {'status == "Delayed"', 'traffic == "Heavy"'}
    tree = parts["tree"].first()
    assert tree.acc_mean == 1.0 and tree.acc_min == 1.0 and tree.folds == 5


def test_missing_is_a_value_and_support_counts(spark, planted):
    found = cond.categorical_conditions(spark.createDataFrame(planted), "y", COLUMNS)
    reasons = {r.value: r.n_rows for r in found.filter("column = 'reason'").collect()}
    want = planted["reason"].fillna("nan").value_counts().to_dict()
    assert reasons == want
    few = spark.createDataFrame(planted.head(60)).withColumn("status", F.when(F.col("id") < 19, "A").otherwise("B"))
    assert {r.value for r in cond.categorical_conditions(few, "y", ["status"]).collect()} == {"B"}


def test_negative_control_has_no_rule(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.choice(list("abcd"), 2000), "b": rng.random(2000), "y": rng.integers(0, 2, 2000)})
    parts = audit(spark.createDataFrame(pdf), "y")
    rule = parts["rule"].first()
    assert rule.rule is None and rule.n_conditions == 0 and rule.mismatches == pdf["y"].sum()
    assert parts["pure_conditions"].count() == 0


def brute_stump(x, y):
    ok = ~np.isnan(x)
    x, y = x[ok], y[ok]
    values = np.unique(x)
    best = None
    for lo, hi in zip(values, values[1:], strict=False):
        left, right = y[x <= lo], y[x > lo]
        g = sum(2 * p.sum() * (len(p) - p.sum()) / len(p) for p in (left, right))
        if best is None or g < best[0] - 1e-9:
            best = (g, (lo + hi) / 2, len(left), int(left.sum()), len(right), int(right.sum()))
    return best


@pytest.mark.parametrize("limits", [{}, {"small": 3, "range_cells": 4}])
def test_stump_matches_brute_force(spark, limits):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, 600).astype(float)
    y = ((x > 21) ^ (rng.random(600) < 0.1)).astype(int)
    x[:200], y[:200] = 7.0, 0  # a third of the rows share one value
    x[-30:] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"x": x, "const": 1.0, "y": y})).withColumn(
        "z", (-F.col("x")).cast("double"))
    out = {(r.column, r.op): r for r in cond.stump_conditions(df, "y", **limits).collect()}
    _, thr, nl, pl, nr, pr = brute_stump(x, y)
    low, high = out["x", "<="], out["x", ">"]
    assert (low.threshold, low.n_rows, low.positives, high.n_rows, high.positives) == (thr, nl, pl, nr, pr)
    assert out["z", "<="].threshold == pytest.approx(-thr)
    assert not [k for k in out if k[0] == "const"]


def test_pure_column_gives_no_stump(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": np.arange(100.0), "y": 1}))
    assert cond.stump_conditions(df, "y").count() == 0


def overlapping(n=3000):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({f"c{i}": rng.choice([f"v{j}" for j in range(6)], n) for i in range(4)})
    pdf["x"] = rng.integers(0, 100, n).astype(float)
    pdf["y"] = ((pdf.c0 == "v1") | (pdf.c1 == "v2") | (pdf.c2 == "v3") | (pdf.c2 == "v4") | (pdf.x > 90)).astype(int)
    return pdf


def brute_greedy(pdf, found):
    """The stated greedy loop on whole masks."""
    masks = [(r.label, (pdf[r.column] == r.value) if r.op == "==" else
              (pdf[r.column] <= r.threshold if r.op == "<=" else pdf[r.column] > r.threshold)) for r in found]
    covered, chosen = np.zeros(len(pdf), dtype=bool), []
    while masks:
        gains = [int((m & ~covered).sum()) for _, m in masks]
        best = int(np.argmax(gains))
        if gains[best] == 0:
            break
        chosen.append(masks[best][0])
        covered |= masks[best][1]
    return " OR ".join(chosen)


def greedy(spark, pdf_or_df, names=None):
    df = spark.createDataFrame(pdf_or_df) if isinstance(pdf_or_df, pd.DataFrame) else pdf_or_df
    names = names or [c for c in df.columns if c != "y"]
    found = cond.single_conditions(df, "y", names)
    return found, cond.greedy_or_rule(df, "y", found, names).first()


def test_greedy_rule_agrees_with_brute_force(spark, monkeypatch):
    pdf = overlapping()
    names = [c for c in pdf.columns if c != "y"]
    found, row = greedy(spark, pdf, names)
    pure = cond.rank_conditions(found.filter("pure_label = 1"), names).withColumn("label", cond.describe()).collect()
    assert row.rule == brute_greedy(pdf, pure) and row.rule.count(" OR ") >= 3
    assert (row.mismatches, row.accuracy, row.positives_covered) == (0, 1.0, pdf.y.sum())
    monkeypatch.setattr(cond, "ROUNDS_PER_PIN", 1)
    assert tuple(greedy(spark, pdf, names)[1]) == tuple(row)


@pytest.mark.parametrize("kind", ["decimal(6,2)", "float", "double", "int"])
def test_a_number_is_found_and_covered_whatever_its_type(spark, kind):
    df = spark.range(600).select((F.col("id") % 6).alias("k")).select(
        (F.col("k") if kind == "int" else F.col("k") / 10).cast(kind).alias("d"), (F.col("k") == 1).cast("int").alias("y"))
    row = greedy(spark, df)[1]
    assert row.rule == ('d == "1"' if kind == "int" else f'd == "{0.1 if kind != "float" else 0.10000000149011612}"')
    assert (row.positives_covered, row.mismatches) == (100, 0)


def test_nan_and_null_are_the_missing_value(spark):
    k = F.col("id") % 6
    df = spark.range(600).select(F.when(k == 1, F.lit(float("nan"))).when(k != 2, k.cast("double")).alias("d"), k.isin(1, 2).cast("int").alias("y"))
    row = greedy(spark, df)[1]
    assert row.rule == 'd == "nan"' and row.positives_covered == row.positives_total == 200


def test_a_tie_falls_to_the_condition_that_ranks_first(spark):
    df = spark.range(1_000).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") < 100, "A").otherwise("B").alias("s"),
                                   (F.col("id") < 100).cast("int").alias("y"))
    assert greedy(spark, df, ["x", "s"])[1].rule == "x <= 99.5"
    assert greedy(spark, df, ["s", "x"])[1].rule == 's == "A"'


def test_a_wide_text_column_can_decide_the_label(spark):
    df = spark.range(12_000).select((F.col("id") % 6_000).alias("v"), F.col("id")).select(
        "id", F.concat(F.lit("c"), F.col("v").cast("string")).alias("code"), (F.col("v") % 2).cast("int").alias("y"))
    row = tree_cv(df.filter("id % 6000 < 60"), "y", ["id"], depth=2).first()
    assert row.folds == 5
    spec = ModelSpec("lr", "logistic", (), ("code",), {"regParam": 1e-6})
    scored = fit_and_score(df, df, [spec], "y", ["id", "y"])
    assert scored.filter("pred = y").count() == 12_000
