"""The pipeline against brute force, stage by stage, and the registration of all queries."""

import sys

import pytest

import __spark_entry__
import corpus_pipeline
from labelwright.llm.queries import ORACLES, QUERIES
from tools.compare import compare, oracle_connection

from .test_near_dedup import shingle_set
from .test_packing import check
from .test_personal_data import base
from .test_quality import plain


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows after each stage, the documents first."""
    out, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "t")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_quality_stage(stages):
    before, after = stages[0], stages[1]
    kept = {r.doc_id for r in after}
    assert all(not plain(r.text)[5] for r in after)
    # two hundred documents prove no cutoff: only the fixed rules reject
    assert kept == {r.doc_id for r in before if not plain(r.text)[5]} and len(kept) > 50


def test_exact_stage(stages):
    best = {}
    for r in stages[1]:
        key = "".join(c for c in r.text if c not in " \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, (1, 0)), (-len(r.text), r.doc_id))
    assert {r.doc_id for r in stages[2]} == {i for _, i in best.values()}


def test_near_stage(stages):
    rows = [(r.doc_id, shingle_set(r.text)) for r in stages[2]]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    assert {r.doc_id for r in stages[3]} == {root(i) for i, _ in rows}


def test_personal_data_and_packing_stages(stages):
    before = {r.doc_id: r for r in stages[3]}
    for r in stages[4]:
        assert r.n_chars == (len(r.text) if r.text != before[r.doc_id].text else before[r.doc_id].n_chars)
        assert not base(r.text)
    assert {r.doc_id for r in stages[4]} == set(before)
    check([(r.doc_id, r.text) for r in stages[4]], stages[5])


def test_all_but_the_last_stage_return_documents(stages):
    assert all(rows[0].__fields__ == stages[0][0].__fields__ for rows in stages[:5])


def test_all_queries_are_registered():
    known = __spark_entry__.queries()
    assert set(QUERIES) <= set(known) and "pipeline" in known
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, sf, name):
    assert compare(spark, oracle_connection(sf), name, QUERIES[name], ORACLES[name], sf).startswith("ok")


def test_the_rest_does_without_these_modules(monkeypatch):
    monkeypatch.setitem(sys.modules, "labelwright.llm.queries", None)
    assert not any(n.startswith("op") or n == "pipeline" for n in __spark_entry__.queries())
