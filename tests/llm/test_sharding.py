from collections import Counter
from zlib import crc32

import pytest

from labelwright.llm.sharding import shard_documents, stratified_shards

from .fixtures import SCHEMA, no_documents, odd_documents, odd_rows


def check_slots(rows, shards):
    """Counts at most one apart, slots gapless from 0 in each shard."""
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert set(slots) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("shards", [1, 3, 8, 40])
def test_every_shard_has_its_share_of_every_source(spark, shards):
    sizes = {"hot": 700, "b": 90, "c": 41, "d": 8, "one": 1, None: 60}
    rows = [(i, f"text {i}", "en", s, 1, "clash", "clash", 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), shards).collect()
    assert len(got) == len(rows)
    check_slots(got, shards)
    counts = Counter((r.source, r.shard) for r in got)
    for source, n in sizes.items():
        # the ranks of a source lie evenly among all rows, so a cut is off by less than a row at each end
        assert all(abs(counts[source, k] - n / shards) <= 2 for k in range(shards)), source
    for r in got:
        text = rows[r.doc_id][1].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, crc32(text), "rows", None)


def test_shards_do_not_depend_on_the_layout_of_the_input(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3}", 1, None, None, 1) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = [{(r.doc_id, r.shard, r.slot) for r in shard_documents(docs.repartition(n), 8).collect()} for n in (1, 7)]
    assert found[0] == found[1]


def test_odd_rows_few_rows_and_empty_table(spark):
    got = shard_documents(odd_documents(spark), 8).collect()
    check_slots(got, 8)
    want = Counter((r[0], len((r[1] or "").encode()) + 1, crc32((r[1] or "").encode()), r[3]) for r in odd_rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.source) for r in got) == want
    few = shard_documents(odd_documents(spark).limit(3), 8).collect()
    assert len(few) == 3
    check_slots(few, 8)
    assert shard_documents(no_documents(spark), 8).collect() == []


def test_equal_rows_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a", "x", "y")] * 20 + [(1, "b", "x", "y")] * 20, "id int, source string, Shard string, _mix string")
    got = stratified_shards(rows, 4)
    assert got.columns == ["id", "source", "Shard", "_mix", "shard", "slot"]
    plain = [tuple(r) for r in got.collect()]
    assert Counter((r[1], r[4]) for r in plain) == {(s, k): 5 for s in "ab" for k in range(4)}
