import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwright.operators import masks, splits


def test_split_is_exact_seeded_disjoint_and_complete(spark):
    df = spark.range(1003).selectExpr("id", "id % 7 as x")
    for ratio in (0.0, 0.8, 0.5, 1.0):
        parts = splits.seeded_split(df, ["id"], ratio, 3)
        assert parts.filter("split = 'train'").count() == int(1003 * ratio)
        assert splits.permutation_check(df, parts.drop("split")).first()["is_permutation"]
    a = splits.seeded_split(df, ["id"], 0.5, 3).filter("split='train'").select("id")
    b = splits.seeded_split(df.orderBy(F.desc("id")), ["id"], 0.5, 3).filter("split='train'").select("id")
    c = splits.seeded_split(df, ["id"], 0.5, 4).filter("split='train'").select("id")
    assert a.exceptAll(b).count() == 0 and a.exceptAll(c).count() > 100


@pytest.mark.parametrize("ratio", [0.1, 0.5, 0.9])
def test_split_stays_exact_when_one_key_holds_a_third(spark, ratio):
    df = spark.range(900).selectExpr("if(id < 300, -1, id) as k", "id % 3 as x")
    parts = splits.seeded_split(df, ["k"], ratio, 1)
    assert parts.filter("split = 'train'").count() == int(900 * ratio)
    assert splits.permutation_check(df, parts.drop("split")).first()["is_permutation"]


def test_folds_keep_the_class_ratio(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 5 = 0 as int) as y")
    out = splits.stratified_folds(df, "y", ["id"], 5, 2, 1)
    for fold in ("fold_0", "fold_1"):
        assert {(r["count"], r["p"]) for r in out.groupBy(fold).agg(F.count("*").alias("count"), F.sum("y").alias("p")).collect()} == {(100, 20)}
    assert out.filter("fold_0 <> fold_1").count() > 300


def test_overlap_counts_copies_once(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    test = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "t string")
    row = splits.split_overlap(train, test, "t").first()
    assert tuple(row) == (4, 2, 1)


def test_permutation_check_sees_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    assert tuple(splits.permutation_check(a, b).first()) == (1, 1, False)


def by_hand(ids, head, tail):
    """The stated meaning, token by token."""
    keep, i = [False] * len(ids), 0
    if ids:
        keep[-1] = True
    while i < len(ids):
        if ids[i:i + len(head)] != head:
            i += 1
            continue
        body = i + len(head)
        ends = [j for j in range(body, len(ids)) if ids[j] == tail[0]]
        if not ends:
            for j in range(body, len(ids)):
                keep[j] = True
            if body == len(ids):
                keep[-1] = False
            break
        if ids[ends[0]:ends[0] + len(tail)] == tail:
            for j in range(body, ends[0] + 1):
                keep[j] = True
            i = ends[0] + len(tail)
        else:
            i = ends[0] + 1
    return [t if k else -100 for t, k in zip(ids, keep, strict=True)]


@pytest.mark.parametrize("ids, want", [
    ([1, 2, 7, 8, 3, 4, 9], [-100, -100, 7, 8, 3, -100, 9]),
    ([1, 2, 7, 8], [-100, -100, 7, 8]),
    ([5, 6], [-100, 6]),
    ([1, 2], [-100, -100]),
    ([1, 2, 7, 3, 5, 6], [-100, -100, -100, -100, -100, 6]),  # no full suffix: no response
    ([1, 1, 2, 7, 3, 4], [-100, -100, -100, 7, 3, 4]),
    ([], []),
])
def test_response_labels(spark, ids, want):
    assert by_hand(ids, [1, 2], [3, 4]) == want
    df = spark.createDataFrame([(ids,)], "t array<int>")
    assert df.select(masks.response_labels(F.col("t"), [1, 2], [3, 4]).alias("l")).first()["l"] == want


def test_response_labels_on_random_arrays(spark):
    rng = np.random.default_rng(0)
    rows = [([int(x) for x in rng.integers(1, 5, rng.integers(0, 30))],) for _ in range(300)]
    df = spark.createDataFrame(rows, "t array<int>")
    for r in df.select("t", masks.response_labels(F.col("t"), [1, 2], [3, 4]).alias("l")).collect():
        assert r.l == by_hand(r.t, [1, 2], [3, 4])


def test_folds_keep_rows_without_a_label(spark):
    df = spark.range(100).selectExpr("id", "if(id % 4 = 0, null, cast(id % 2 as int)) as y")
    out = splits.stratified_folds(df, "y", ["id"], 5)
    assert out.count() == 100 and {r["count"] for r in out.filter("y is null").groupBy("fold_0").count().collect()} == {5}
