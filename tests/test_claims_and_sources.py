import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.plans import claim_check as cc
from labelwright.plans.run_logs import summarize_runs
from labelwright.sources import chat, fingerprints, reports, tables


def tokens_of(spark, text):
    df = spark.createDataFrame([(1, text)], "d int, t string").select("d", cc.clean_markup(F.col("t")).alias("t"))
    return [(r.line_no, r.token, r.percent) for r in cc.number_tokens(df, "d", "t").orderBy("line_no").collect()]


def test_markup_is_removed_before_numbers_are_read(spark):
    text = "---\nyear: 1999\n---\n```\n123\n```\n[see 7](a/8.md) https://x.y/9 deadbeef0123 10"
    assert [t for _, t, _ in tokens_of(spark, text)] == ["7", "10"]


@pytest.mark.parametrize("line, want", [
    ("the learning rate is 8.3e-07 at the end", [("8.3e-07", False)]),
    ("1,234 rows, 22.7% late, -5 and v1.5 a-3 x/4 2b", [("1,234", False), ("22.7", True), ("-5", False)]),
    ("1.5x", [("1", False)]),
    ("(0.452).", [("0.452", False)]),
    ("é5 5é 6", [("6", False)]),
])
def test_number_tokens(spark, line, want):
    assert sorted(t[1:] for t in tokens_of(spark, line)) == sorted(want)


def backed(spark, text, json, allow=""):
    reports_ = spark.createDataFrame([(json,)], "j string")
    known = cc.known_numbers(reports_, "j").union(cc.allowlist_numbers(
        spark.createDataFrame([(a,) for a in allow.split("\n")], "l string"), "l"))
    docs = spark.createDataFrame([("doc", text)], "d string, t string")
    return {r.token for r in cc.unsupported_claims(cc.number_tokens(docs, "d", "t"), known, "d").collect()}


REPORT = '{"acc": 0.452, "n": 1000, "nested": [{"rate": 0.22749, "flag": true, "note": "77"}], "lr": 8.3e-07, "value": "30.5", "one": 1.0}'


@pytest.mark.parametrize("text, missing", [
    ("acc 0.452 of 1,000, that is 45.2% and 22.7%", set()),
    ("acc 0.9137", {"0.9137"}),
    ("acc 0.443", {"0.443"}),
    ("acc 0.5 or 0.45", {"0.5", "0.45"}),
    ("perfect 1.000 or 1.0 or 1", set()),
    ("not 0.998", {"0.998"}),
    ("lr 8.3e-07, 8.30e-07 or 9.9e-07", {"9.9e-07"}),
    ("77 is only in a note", {"77"}),
    ("edited to 30.5", set()),
    ("rate 0.2275 or 0.227", set()),
])
def test_wrong_numbers_are_caught(spark, text, missing):
    assert backed(spark, text, REPORT) == missing


def test_allow_list_backs_only_itself(spark):
    assert backed(spark, "5e-5 then 50.00 then 42", "{}", "5e-5 # rate\n# none\n42") == {"50.00"}


def test_python_rounding_of_binary_ties(spark):
    df = spark.createDataFrame([(0.0045,), (2.5,), (1e22,), (123456.0,)], "v double")
    rows = df.select(cc.printed(F.col("v")).alias("p")).select("p.*").collect()
    assert [r.f3 for r in rows] == [f"{x:.3f}" for x in (0.0045, 2.5, 1e22, 123456.0)]
    assert [r.r for r in rows] == ["0.0045", "2.5", "1e+22", "123456.0"]


def test_csv_nulls_coercion_and_bad_targets(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('name,x,y\nNone,1.5,1\n"",oops,0\n NA ,,1\n')
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.IntegerType())])
    rows = [tuple(r) for r in tables.read_labelled_csv(spark, str(path), schema, "y").collect()]
    assert rows == [("None", 1.5, 1), (None, None, 0), (" NA ", None, 1)]
    path.write_text("name,x,y\na,1,maybe\n")
    with pytest.raises(Exception):
        tables.read_labelled_csv(spark, str(path), schema, "y").collect()
    path.write_text("name,x,y\na,1,\n")
    with pytest.raises(Exception, match="null label"):
        tables.read_labelled_csv(spark, str(path), schema, "y").collect()


def test_chat_lines_round_trip_and_errors(spark, tmp_path):
    source = tmp_path / "c.jsonl"
    source.write_text('{"conversations":[{"from":"user","value":"é\\n\\"x\\""}]}\n\n{"conversations":[]}\n', encoding="utf-8")
    df = chat.read_chat_jsonl(spark, str(source))
    assert df.count() == 2
    chat.write_chat_jsonl(df, str(tmp_path / "out"))
    again = chat.read_chat_jsonl(spark, str(tmp_path / "out"))
    assert df.exceptAll(again).count() == 0 and again.exceptAll(df).count() == 0
    raw = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert "é" in raw and len(raw.strip().split("\n")) == 2
    source.write_text('{"conversations":[}\n')
    with pytest.raises(Exception):
        chat.read_chat_jsonl(spark, str(source)).collect()


def test_fingerprints_match_hashlib_and_manifests(spark, tmp_path):
    data = {"a.bin": b"x\r\ny\xff\xe9\r\r\n", "b.bin": b"same\n"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    found = fingerprints.fingerprint_files(spark, str(tmp_path), "*.bin")
    rows = {r.file: r for r in found.collect()}
    for name, content in data.items():
        assert rows[name].sha256 == hashlib.sha256(content).hexdigest()
        assert rows[name].sha256_lf == hashlib.sha256(content.replace(b"\r\n", b"\n")).hexdigest()
    recorded = spark.createDataFrame([("a.bin", rows["a.bin"].sha256_lf), ("d.bin", "1")], "file string, sha256_lf string")
    changed = recorded.withColumn("sha256_lf", F.lit("0"))
    assert {r.status for r in fingerprints.compare_manifest(found, changed).collect()} == {"changed", "new", "missing"}
    status = {r.file: r.status for r in fingerprints.compare_manifest(found, recorded).collect()}
    assert status == {"a.bin": "same", "b.bin": "new", "d.bin": "missing"}


def test_leaves_are_read_by_structure(spark):
    texts = ['[[1, [2, {"deep": [[3.50]]}]], {"a\\"value": "12", "b": {"value": "1,234"}}]', '{"note": "has 77 and \\"value\\": \\"88\\"", "value": true}',
             '{"value": ["9"], "value": {"value": "0.07"}}', "{bad 55", None, "", "41", '{"big": 123456789012345678901234567890, "e": 2e-5, "n": null}', "[]"]
    reports_ = spark.createDataFrame([(t,) for t in texts], "j string")
    forms = {r.form for r in cc.known_numbers(reports_, "j").collect()}
    assert {"1", "2", "3.500", "3.50", "3.5", "1234", "41", "123456789012345678901234567890", "2e-05", "2.0e-05", "20.00"} <= forms
    assert not forms & {"12", "77", "88", "9", "55", "true", "null", "3"}
    assert {r.j for r in cc.malformed(reports_, "j").collect()} >= {"{bad 55"}


def test_files_are_hashed_in_chunks_wherever_they_are_cut(spark, tmp_path):
    data = {"cut.bin": b"abc\r\ndef\r\r\n\r", "empty.bin": b"", "one.bin": b"\r\n" * 50, "deep/x.bin": b"\n\r", "other.txt": b"no"}
    (tmp_path / "deep").mkdir()
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    listed = fingerprints.list_files(spark, str(tmp_path), "*.bin")
    for chunk in (1, 2, 4, 5, 1 << 20):
        rows = {r.file: r for r in fingerprints.hash_files(listed, chunk=chunk).collect()}
        assert set(rows) == {"cut.bin", "empty.bin", "one.bin", "x.bin"}
        for name, content in data.items():
            if row := rows.get(name.split("/")[-1]):
                assert (row.n_bytes, row.sha256) == (len(content), hashlib.sha256(content).hexdigest())
                assert row.sha256_lf == hashlib.sha256(content.replace(b"\r\n", b"\n")).hexdigest(), (name, chunk)
    found = fingerprints.fingerprint_files(spark, str(tmp_path))
    recorded = spark.createDataFrame([("empty.bin", hashlib.sha256(b"").hexdigest()), ("gone.bin", "0")], "file string, sha256_lf string")
    status = {r.file: r.status for r in fingerprints.compare_manifest(found, recorded).collect()}
    assert status["empty.bin"] == "same" and status["gone.bin"] == "missing" and status["other.txt"] == "new"
    assert fingerprints.fingerprint_files(spark, str(tmp_path), "*.none").collect() == []


def test_reports_and_blank_labels(spark, tmp_path):
    scored = spark.createDataFrame([(1, 1, 1, "Logistics_Delay: 1", 1, 0.5), (2, 0, 1, "n/a", None, None)],
                                   "id int, gold int, rule int, raw string, label int, p1 double")
    table = reports.prediction_table(scored, ["id"], scores=["p1"])
    assert [r.model_label for r in table.orderBy("id").collect()] == ["1", ""]
    reports.write_predictions(table, str(tmp_path / "p"), "csv")
    reports.write_report({"predictions": table}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "predictions")).count() == 2


def test_run_log_takes_the_earliest_minimum(spark):
    log = spark.createDataFrame([("r", 10, 0.5), ("r", 20, 0.0), ("r", 30, 0.0), ("r", 40, None), ("s", 5, 2.0)],
                                "run string, step int, value double")
    out = {r.run: r for r in summarize_runs(log).collect()}
    assert (out["r"].points, out["r"].first_step, out["r"].min_step, out["r"].last_step, out["r"].first_reached_step) == (3, 10, 20, 30, 20)
    assert out["s"].first_reached_step is None
