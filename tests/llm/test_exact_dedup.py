import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelwright.llm.exact_dedup import drop_exact_copies, exact_groups

from .fixtures import SCHEMA, no_documents, odd_documents, odd_rows


def plain(rows):
    """Rows of ``exact_groups`` for (doc_id, text)."""
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i or 0, i))
    out = Counter()
    for norm, members in groups.items():
        best = min(members, key=lambda m: m[:3])
        digest, kept = hashlib.sha256(norm.encode()).hexdigest(), False
        for m in sorted(members, key=lambda m: m[:3]):
            out[m[3], best[3], len(members), not kept and m == best, digest] += 1
            kept = kept or m == best
    return out


def copies(seed, n):
    rnd = random.Random(seed)
    texts = ["", None, " ", "a b", "ab", "A B", "long " * 3_000, "é x", "é x", "​a"]
    return [(rnd.choice([i, i, i // 2, None]), rnd.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("content_hash", [F.md5, lambda c: F.lit("all collide"), lambda c: F.substring(F.md5(c), 1, 1)])
def test_groups_equal_brute_force_even_when_hashes_collide(spark, content_hash):
    rows = copies(1, 200)
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "clash", "clash", 2) for i, t in rows], SCHEMA).repartition(5)
    assert Counter(tuple(r) for r in exact_groups(docs, content_hash=content_hash).collect()) == plain(rows)


def test_odd_rows_and_empty_table(spark):
    assert Counter(tuple(r) for r in exact_groups(odd_documents(spark)).collect()) == plain([r[:2] for r in odd_rows()])
    assert exact_groups(no_documents(spark)).collect() == [] and drop_exact_copies(no_documents(spark)).collect() == []


def test_one_whole_row_of_each_group_stays(spark):
    docs = odd_documents(spark)
    got = drop_exact_copies(docs)
    assert got.columns == docs.columns
    want = Counter((k[0], k[4]) for k in plain([r[:2] for r in odd_rows()]) if k[3])
    have = Counter((r[0], hashlib.sha256(re.sub("[\x20\x09-\x0D]", "", r[1] or "").encode()).hexdigest()) for r in got.collect())
    assert have == want
    rows = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in rows for r in got.collect())
