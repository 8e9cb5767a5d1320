"""Clusters of vectors around centroids, in built-in expressions on whole numbers."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pin, take

#: Parts of one that a component is counted in, components of a vector, first centroids, rounds, seed of their choice.
SCALE = 1024
DIMENSION = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3


def whole_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = DIMENSION,
                  scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors with exactly ``dimension`` components, none null or non-finite, as floor(scale * x)."""
    rows = take(vectors, id_col, vector_col).toDF("vec_id", "e")
    good = F.forall("e", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is greater than any number
    rows = rows.filter((F.size("e") == dimension) & good)
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def first_centroids(rows: DataFrame, n: int, seed: int) -> list[list[int]]:
    """The vectors of the ``n`` smallest hashes of their ids; equal hashes by components, null ids last."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = rows.select(mark.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(n)
    return [list(r["v"]) for r in chosen.collect()]  # n rows


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid: squared Euclidean distance, ties to the smaller number.

    Each centroid is a literal array; ``zip_with`` and ``aggregate`` sum the squares, and the least struct wins.
    """
    def distance(centroid: list[int]) -> Column:
        literal = F.expr(f"array({', '.join(f'{x}L' for x in centroid)})")  # one call, not one per component
        squares = F.zip_with(vector, literal, lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("bigint"), lambda s, x: s + x)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]))


def _placed(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    return rows.withColumn("_near", nearest(F.col("v"), centroids)).select("*", "_near.cluster", "_near.distance").drop("_near")


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The next centroids: floor of the mean of each component; a centroid without vectors stays.

    The sums are one hash aggregation with a column per component, so a task sends a row per cluster, and as
    many rows as there are centroids reach the driver, where the division is exact.
    """
    sums = [F.expr(f"sum(v[{i}]) AS s{i}") for i in range(len(centroids[0]))]
    found = {r["cluster"]: r for r in _placed(rows, centroids).groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()}
    return [[found[k][f"s{i}"] // found[k]["n"] for i in range(len(c))] if k in found else c for k, c in enumerate(centroids)]


def cluster_vectors(vectors: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimension: int = DIMENSION,
                    scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    Kept are vectors with exactly ``dimension`` components, none null or non-finite; each component counts as
    floor(scale * x). The first centroids are the kept vectors with the smallest sha256 of seed:id (fewer rows than ``clusters``: all of
    them). Each round assigns every vector to the nearest centroid and moves the centroids; then vectors are assigned once more.

    Ties go to the smaller number. Rows that repeat id and vector are rows like others; a null id comes last among the
    first centroids. Components beyond some 10^5 would not fit 64-bit squares: Spark then fails with an arithmetic overflow,
    in place of a wrong number. An empty table gives an empty result; other columns are ignored. Whole numbers are
    written down once, each round reads them and exchanges sums only.
    """
    rows = pin(whole_vectors(vectors, id_col=id_col, vector_col=vector_col, dimension=dimension, scale=scale), "lz4")
    centroids = first_centroids(rows, clusters, seed)
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
                           F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    placed = pin(_placed(rows, centroids).select("vec_id", "cluster", "distance"), "lz4")
    inertia = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row per cluster
    each = F.array(*[F.lit(inertia.get(k, 0)).cast("bigint") for k in range(len(centroids))])
    marks = F.array(*[F.lit(sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids])
    return placed.select("vec_id", "cluster", "distance", F.get(each, "cluster").alias("cluster_inertia"),
                         F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), F.get(marks, "cluster").alias("centroid_sha256"))


def cluster_sql(table: str, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimension: int = DIMENSION, scale: int = SCALE) -> str:
    """The same in SQL: vectors and centroids as rows of (number, component, value)."""
    def near(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT rid, k AS cluster, d AS distance FROM (SELECT rid, k, sum((x - c) * (x - c)) AS d FROM v JOIN c{k} USING (i) GROUP BY rid, k)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)"""

    steps = []
    for k in range(rounds):
        steps.append(near(k))
        steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT k, i, coalesce(m, c) AS c FROM c{k} LEFT JOIN (SELECT cluster AS k, i, (s - ((s % n) + n) % n) // n AS m
  FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM v JOIN a{k} USING (rid) GROUP BY cluster, i)) USING (k, i))""")
    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM {table}
  WHERE len(embedding) = {dimension} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
v AS MATERIALIZED (SELECT rid, unnest(range({dimension})) AS i, unnest(e) AS x FROM t),
f AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, e) - 1 AS k, e FROM t QUALIFY k < {clusters}),
c0 AS MATERIALIZED (SELECT k, unnest(range({dimension})) AS i, unnest(e) AS c FROM f),
{", ".join(steps)}, {near(rounds)},
h AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN t USING (rid) JOIN h ON k = cluster
"""
