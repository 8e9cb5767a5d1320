import random
from collections import Counter
from hashlib import sha256
from math import floor, isfinite

from pyspark.sql import types as T

from labelwright.llm.clustering import cluster_vectors

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("VEC_ID", T.StringType()), T.StructField("cluster", T.StringType()), T.StructField("v", T.LongType())])


def brute_force(rows, clusters, rounds, dimension):
    kept = [(i, [floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == dimension and all(x is not None and isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(x) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(centroids)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, k in found:
        inertia[k] += d
    return Counter((i, k, d, inertia[k], sum(inertia.values()), sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in found)


def answer(spark, rows, **options):
    table = spark.createDataFrame([(i, e, "clash", "clash", 1) for i, e in rows], SCHEMA).repartition(3)
    return Counter(tuple(r) for r in cluster_vectors(table, dimension=4, **options).collect())


def test_matches_brute_force_with_odd_rows(spark):
    rnd = random.Random(1)
    vectors = [[rnd.choice([-1.5, -0.25, 0.0, 0.125, 0.75]) + rnd.randint(-40, 40) / 4096 for _ in range(4)] for _ in range(120)]
    rows = list(enumerate(vectors))
    rows += [(500, None), (501, []), (502, [0.5] * 3), (503, [0.5] * 5), (504, [0.5, None, 0.5, 0.5]), (505, [float("nan")] * 4),
             (506, [float("inf"), 0.0, 0.0, 0.0]), (507, [0.0, 0.0, float("-inf"), 0.0]), (None, vectors[0]), (None, vectors[1]),
             (3, vectors[3]), (3, vectors[3]), (3, [-0.0001] * 4), (508, [-0.0] * 4), (509, [100.0, -100.0, 0.0, 0.0])]
    for clusters, rounds in ((8, 10), (1, 2), (30, 3)):
        assert answer(spark, rows, clusters=clusters, rounds=rounds) == brute_force(rows, clusters, rounds, 4)


def test_equal_centroids_and_few_rows(spark):
    rows = [(i, [0.25] * 4) for i in range(20)] + [(50, [0.5] * 4)]  # empty clusters stay where they are
    assert answer(spark, rows, clusters=8, rounds=4) == brute_force(rows, 8, 4, 4)
    assert answer(spark, rows[:3], clusters=8, rounds=4) == brute_force(rows[:3], 8, 4, 4)


def test_no_vector_is_kept(spark):
    assert answer(spark, []) == answer(spark, [(1, None), (2, [float("nan")] * 4)]) == Counter()


def test_ids_and_vectors_of_other_types(spark):
    table = spark.createDataFrame([("a", [0.1, 0.2]), ("b", [0.3, float("nan")]), ("c", [-0.3, 0.4])], "id string, e array<double>")
    got = cluster_vectors(table, id_col="id", vector_col="e", dimension=2, clusters=1, rounds=1).collect()
    assert sorted(r.vec_id for r in got) == ["a", "c"]
