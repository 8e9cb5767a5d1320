"""Exact trees against a plain recursive one, and models that run in the workers."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelwright.operators.scoring import fit_line_weights, line_weight_scorer, model_scorer, score_texts
from labelwright.operators.splits import stratified_folds
from labelwright.operators.trees import fit_trees, tree_cv


def impurity(n, p):
    return 2 * p * (n - p) / n


def grow(rows, columns, depth):
    """A nested (test, met, other) or a label; rows are (values, y)."""
    n, p = len(rows), sum(y for _, y in rows)
    best = None
    if depth and 0 < p < n:
        for c, _ in enumerate(columns):
            values = sorted({v[c] for v, _ in rows})
            for a, b in zip(values, values[1:] + [None], strict=True):
                if isinstance(a, str):
                    at, hit = a, [y for v, y in rows if v[c] == a]
                elif b is None:
                    continue
                else:
                    at, hit = (a + b) / 2, [y for v, y in rows if v[c] <= a]
                if len(hit) < n:
                    found = (impurity(len(hit), sum(hit)) + impurity(n - len(hit), p - sum(hit)), c, at)
                    best = min(best, found) if best else found
    if best is None:
        return int(2 * p > n)
    _, c, at = best
    met = (lambda v: v[c] == at) if isinstance(at, str) else (lambda v: v[c] <= at)
    return met, grow([r for r in rows if met(r[0])], columns, depth - 1), grow([r for r in rows if not met(r[0])], columns, depth - 1)


def ask(tree, values):
    while isinstance(tree, tuple):
        tree = tree[1] if tree[0](values) else tree[2]
    return tree


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_trees_of_all_folds_equal_a_plain_tree(spark, depth):
    rnd = random.Random(depth)
    data = [(i, rnd.choice("abcd"), rnd.choice(["x", "y", None]), rnd.choice([1.0, 2.5, 4.0, None, float("nan")]), rnd.random()) for i in range(160)]
    data = [(*r, int((r[1] == "a") ^ (r[4] > 0.6) or rnd.random() < 0.1)) for r in data]
    df = spark.createDataFrame(data, "id int, s string, t string, q double, r double, y int")
    known = sorted(r[3] for r in data if r[3] is not None and r[3] == r[3])
    middle = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
    fold = {r.id: r.fold_0 for r in stratified_folds(df, "y", ["id"], 5, 1, 0).collect()}
    rows = {i: ((middle if q is None or q != q else q, r, s, t or "nan"), y) for i, s, t, q, r, y in data}
    accs = []
    for f in range(5):
        tree = grow([rows[i] for i in rows if fold[i] != f], "qrst", depth)
        held = [rows[i] for i in rows if fold[i] == f]
        accs.append(sum(ask(tree, v) == y for v, y in held) / len(held))
    for limits in ({}, {"small": 10, "range_cells": 7}):
        got = tree_cv(df, "y", ["id"], depth=depth, **limits).first()
        assert (got.depth, got.folds) == (depth, 5)
        assert got.acc_mean == pytest.approx(sum(accs) / 5, abs=1e-12) and got.acc_min == pytest.approx(min(accs), abs=1e-12)


def test_a_planted_rule_is_found_whole_and_one_class_needs_no_tree(spark):
    df = spark.range(3_000).select("id", F.when(F.col("id") % 5 == 0, "Delayed").otherwise("Fine").alias("status"),
                                   (F.col("id") % 97 / 7).alias("hours"), F.lit("same").alias("flat"))
    ruled = df.withColumn("y", ((F.col("status") == "Delayed") | (F.col("hours") > 9)).cast("int"))
    assert tree_cv(ruled, "y", ["id"]).first()[1:] == (5, 1.0, 1.0)
    assert tree_cv(df.withColumn("y", F.lit(1)), "y", ["id"]).first()[1:] == (5, 1.0, 1.0)
    assert tree_cv(ruled.limit(0), "y", ["id"]).first().folds == 0
    rows = ruled.select((F.col("id") % 2).alias("fold"), F.col("y").cast("bigint").alias("y"), "status", "hours", "flat")
    trees = fit_trees(rows, ["status", "flat"], ["hours"], 2, 2)
    # the number covers more of the label, so it is cut first; its side is pure, the other is cut by status
    assert all(trees[f, 1]["c"] == 1 and 9 < trees[f, 1]["x"] < 9.2 and trees[f, 3]["v"] == "Delayed" for f in (0, 1) if (f, 3) in trees)
    assert all((f, 3) in trees and (f, 2) not in trees for f in (0, 1))


def loud_model(folder, outputs=lambda texts: {"raw": [f"seen {len(t)}" for t in texts]}):
    def load():
        import uuid

        with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass

        def predict(texts):
            with open(f"{folder}/batches-{os.getpid()}", "a") as file:
                file.write(f"{len(texts)} {sum(len(t.encode()) for t in texts)}\n")
            return outputs(texts)

        return predict

    return load


def test_a_model_is_loaded_once_per_worker_and_fed_by_bytes(spark, tmp_path):
    texts = [None, "", "é" * 10, "long " * 100] + [f"text {i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    for _ in range(2):  # a second job runs in the same workers
        scored = model_scorer(loud_model(str(tmp_path)), batch_bytes=100, batch_texts=9)
        got = {r.id: r.raw for r in scored(df).unionByName(scored(df.filter("id < 0"))).collect()}
        assert got == {i: None if t is None else f"seen {len(t)}" for i, t in enumerate(texts)}
    sizes = [tuple(map(int, line.split())) for p in tmp_path.glob("batches-*") for line in p.read_text().splitlines()]
    assert all(n <= 9 and (b <= 100 or n == 1) for n, b in sizes) and sum(n for n, _ in sizes) == 2 * 403
    loads = Counter(p.name.split("-")[0] for p in tmp_path.iterdir() if not p.name.startswith("batches"))
    assert loads and max(loads.values()) <= 2  # one for each of the two scorers


def test_clashing_columns_and_wrong_answers_are_errors(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    with pytest.raises(ValueError, match="already present"):
        model_scorer(loud_model(str(tmp_path)), "ID string")(df)
    with pytest.raises(Exception, match="one raw per text"):
        model_scorer(loud_model(str(tmp_path), lambda texts: {"raw": ["x"] * (len(texts) + 1)}))(df).collect()


def test_line_weights_equal_plain_arithmetic(spark):
    from math import exp, log

    rows = [("a: 1\nb: 2", 1), ("a: 1\n a: 1 \n", 1), ("a: 0\nb: 2", 0), ("", 0), (None, 1), ("a: 1", None)]
    df = spark.createDataFrame(rows, "text string, y int")
    prior, weights = fit_line_weights(df, "y")
    assert prior == pytest.approx(log(4) - log(3))
    assert weights == pytest.approx({"a: 1": log(3 / 1) - log(5 / 4), "b: 2": log(2 / 2) - log(5 / 4), "a: 0": log(1 / 2) - log(5 / 4)})
    assert list(fit_line_weights(df, "y", most=1)[1]) == ["a: 1"]
    scored = {r.text: r for r in score_texts(df.drop("y"), line_weight_scorer(spark, prior, weights, "T"), "T").collect()}
    assert scored[None].raw is None and scored[None].label is None and scored[None].margin is None
    assert scored[""].margin == pytest.approx(prior) and scored[""].label == 1
    m = prior + weights["a: 0"] + weights["b: 2"]
    got = scored["a: 0\nb: 2"]
    assert got.margin == pytest.approx(m) and got.p1 == pytest.approx(1 / (1 + exp(-m))) and got.label == int(m > 0)


def test_trees_read_equal_rows_once(spark, monkeypatch):
    from labelwright.operators import trees

    df = spark.range(6_000).selectExpr("id", "cast(id % 3 AS string) AS s", "if(id % 9 = 4, NULL, cast(id % 5 AS double)) AS x",
                                       "cast(id % 5 > 2 OR id % 17 = 0 AS int) AS y")
    seen, fit = [], trees.fit_trees

    def counted(rows, *args, **options):
        seen.append(rows.count())
        plain = rows.select("fold", "y", "s", "x", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_i")).drop("_i")
        assert plain.count() == 6_000
        found = fit(rows, *args, **options)
        assert found == fit(plain, *args)
        return found

    monkeypatch.setattr(trees, "fit_trees", counted)
    row = trees.tree_cv(df, "y", ["id"]).first()
    assert row.folds == 5 and 0.9 < row.acc_mean < 1 and seen[0] <= 5 * 2 * 3 * 6
