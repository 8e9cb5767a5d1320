import math

import pytest
from pyspark.sql import functions as F

from labelwright.functions import text as tx
from labelwright.operators import edits as ed
from labelwright.operators import records as rec
from labelwright.operators import rule_tables as rt
from labelwright.vocab import LOGISTICS

TEXT = "\n".join(f"{f}: v{i}" for i, f in enumerate(LOGISTICS.fields))


def one(spark, expression, **columns):
    names = list(columns) or ["x"]
    row = [tuple(columns.values())] if columns else [("",)]
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame(row, schema).select(expression.alias("out")).first()["out"]


@pytest.mark.parametrize("raw, label", [
    ("Logistics_Delay: 1", 1), ("Logistics_Delay:0", 0), ("  Logistics_Delay: 1\n", 1), ("Logistics", None),
    ("Logistics_Delay: 2", None), ("Logistics_Delay: 10", None), ("assistant\nLogistics_Delay: 1", None),
    ("The answer is 1", None), ("", None), (None, None), ("\xa0Logistics_Delay:\xa01", 1), ("Logistics_Delay: 1é", None),
    ("Logistics_Delay: 1.", 1), ("x\nLogistics_Delay: 1", None),
])
def test_answers_are_anchored(spark, raw, label):
    assert one(spark, tx.answer_label(F.col("raw"), "Logistics_Delay"), raw=raw) == label


def test_render_round_trip_and_missing(spark):
    df = spark.createDataFrame([(1.5, math.nan, " 27.0 ", None, "  ")], "a double, b double, c string, d string, e string")
    out = rec.render(df, ["a", "b", "c", "d", "e", "absent"]).first()["text"]
    assert out == "a: 1.5\nb: None\nc: 27.0\nd: None\ne: None\nabsent: None"
    back = rec.decode(spark.createDataFrame([(out,)], "text string"), "text", ["a", "c", "zzz"], ["a"]).first()
    assert (back["a"], back["c"], back["zzz"]) == (1.5, "27.0", None)
    sparse = rec.render_sparse(df.select("c", "d", "e"), ["c", "d", "e"]).first()["text"]
    assert sparse == "c:  27.0 "


def test_decode_first_colon_trim_and_last_wins(spark):
    text = "a: 1:2\nno colon\n b :  x \na: 3\nempty:\n c　: y \r"
    mapped = rec.decode(spark.createDataFrame([(text,)], "text string"), "text").first()["fields"]
    assert mapped == {"a": "3", "b": "x", "empty": "", "c": "y"}
    wide = rec.decode(spark.createDataFrame([(text,)], "text string"), "text", ["a", "b", "empty", "c", "d"]).first()
    assert tuple(wide) == ("3", "x", "", "y", None)


def test_regex_characters_in_field_names_are_literal(spark):
    text = "a.b: 1\naxb: 2"
    assert one(spark, tx.tail_value(tx.last_line_tail(F.col("t"), "a.b")), t=text) == "1"


def test_set_changes_exactly_one_line(spark):
    df = spark.createDataFrame([(TEXT,)], "text string")
    out = ed.edit_column(df, "text", [ed.set_to("Traffic_Status", "Hea$1\\vy")]).first()["text"]
    changed = [(a, b) for a, b in zip(TEXT.split("\n"), out.split("\n"), strict=True) if a != b]
    assert changed == [("Traffic_Status: v8", "Traffic_Status: Hea$1\\vy")]
    for name in ("Timestamp", "Demand_Forecast"):  # first and last line
        out = ed.edit_column(df, "text", [ed.set_to(name, "z")]).first()["text"]
        assert out.count("\n") == TEXT.count("\n") and f"{name}: z" in out.split("\n")


def test_set_needs_colon_and_space_and_takes_the_first(spark):
    df = spark.createDataFrame([("A:1\nA: 2\nA: 3",)], "text string")
    assert ed.edit_column(df, "text", [ed.set_to("A", "9")]).first()["text"] == "A:1\nA: 9\nA: 3"
    assert ed.edit_column(df, "text", [ed.set_to("A", " ")]).first()["text"] == "A:1\nA: None\nA: 3"


def test_absent_field_is_an_error_or_null(spark):
    df = spark.createDataFrame([("A: 1",)], "text string")
    assert ed.edit_column(df, "text", [ed.set_to("B", "1")], on_error="null").first()["text"] is None
    with pytest.raises(Exception, match="does not fit"):
        ed.edit_column(df, "text", [ed.set_to("B", "1")]).collect()
    with pytest.raises(Exception, match="does not fit"):
        ed.apply_plan(df.withColumn("row_id", F.lit(1)), [ed.Edit("k", "g", "all", (ed.set_to("B", "1"),))],
                      {"all": F.lit(True)}).collect()


def test_drop_rename_reorder(spark):
    df = spark.createDataFrame([(TEXT,)], "text string")
    dropped = ed.edit_column(df, "text", ed.drop("Shipment_Status", "Traffic_Status")).first()["text"]
    assert dropped.count("\n") == 12 and "Shipment_Status" not in dropped
    renamed = ed.edit_column(df, "text", [ed.Step("rename", "Shipment_Status", "Status")]).first()["text"]
    assert "\nStatus: v5\n" in renamed and "Shipment_Status" not in renamed
    order = ed.seeded_order(0, LOGISTICS.fields)
    assert sorted(order) == sorted(LOGISTICS.fields) and order != list(LOGISTICS.fields)
    moved = ed.edit_column(df, "text", [ed.reorder(order)]).first()["text"]
    assert sorted(moved.split("\n")) == sorted(TEXT.split("\n")) and moved.startswith(order[0] + ":")
    assert ed.edit_column(df, "text", [ed.reorder(order[1:])], on_error="null").first()["text"] is None


def test_drop_keeps_untrimmed_keys_and_takes_whole_lines(spark):
    df = spark.createDataFrame([(" A: 1\nA: 2\nA\nAB: 3",)], "text string")
    assert ed.edit_column(df, "text", ed.drop("A")).first()["text"] == " A: 1\nAB: 3"


def test_chat_needs_target_last_and_null_becomes_empty(spark):
    df = spark.createDataFrame([(" x ", None, "1")], "a string, b string, y string")
    turns = rec.to_chat(df, "y", "SYS").first()["conversations"]
    assert [(t["from"], t["value"]) for t in turns] == [("system", "SYS"), ("user", "a: x\nb: "), ("assistant", "y: 1")]
    with pytest.raises(ValueError, match="last column"):
        rec.to_chat(df.select("y", "a"), "y", "SYS")


def test_unparsable_gold_is_an_error_and_listed(spark):
    rows = [([("system", "s"), ("user", "u"), ("assistant", "y: 1")],), ([("system", "s"), ("user", "u"), ("assistant", "y: 7")],),
            ([("user", "u")],)]
    df = spark.createDataFrame(rows, "conversations array<struct<`from`:string,value:string>>")
    assert rec.chat_rejects(df, "y").count() == 2
    with pytest.raises(Exception, match="unparsable gold"):
        rec.gold_from_chat(df, "y").collect()
    good = rec.gold_from_chat(df, "y", on_error="null").filter("gold is not null").collect()
    assert [(r.user_text, r.gold) for r in good] == [("u", 1)]


def test_rule_and_remaining_clause_on_texts(spark):
    base = "\n".join(f"{f}: x" for f in LOGISTICS.fields)
    late = base.replace("Shipment_Status: x", "Shipment_Status: Delayed")
    heavy = base.replace("Traffic_Status: x", "Traffic_Status:  Heavy ")
    cut = "\n".join(ln for ln in heavy.split("\n") if not ln.startswith("Shipment"))
    renamed = late.replace("Shipment_Status", "Status")
    df = spark.createDataFrame([("base", base), ("late", late), ("heavy", heavy), ("cut", cut), ("renamed", renamed)],
                               "k string, text string")
    out = {r.k: (r.rule_on_text, r.remaining) for r in rt.read_rule(df, LOGISTICS).collect()}
    assert out == {"base": (0, None), "late": (1, None), "heavy": (1, None), "cut": (None, 1), "renamed": (None, None)}


def test_row_jobs_also_run_on_streams(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("Delayed", "y: 1")], "Shipment_Status string, raw string").write.parquet(source)
    stream = spark.readStream.schema("Shipment_Status string, raw string").parquet(source)
    jobs = rec.parse_answers(rec.render(stream, ["Shipment_Status"]), "raw", "y")
    query = jobs.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start(sink)
    query.awaitTermination(60)
    row = spark.read.parquet(sink).first()
    assert (row["text"], row["label"]) == ("Shipment_Status: Delayed", 1)
