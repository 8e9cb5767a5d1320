"""Seeded splits and folds, split overlap and permutation checks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, row_hash
from ..functions.joins import join_groups, never_null


def _ranked(df: DataFrame, by: Sequence[str], keys: Sequence[str], seed: int | str, out: str) -> DataFrame:
    """Add ``out``: the row's 0-based position by hash order within its ``by`` group.

    Positions are counted inside hash buckets (65,536 per group, evenly filled because
    ``keys`` is a row key) and shifted by the sizes of the buckets before.
    """
    digest = row_hash(seed, keys)
    group = F.concat_ws("|", *[never_null(b) for b in by])
    hashed = df.withColumns({"_h": digest, "_b": hash_bucket(digest), "_g": group})
    sizes = hashed.groupBy("_g", "_b").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_g", "_b", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    # the window and the join share one partitioning: the rows are shuffled once
    inside = Window.partitionBy("_g", "_b").orderBy("_h", *keys)
    placed = hashed.withColumn("_pos", F.row_number().over(inside)).join(offsets, ["_g", "_b"])
    return placed.withColumn(out, F.col("_pos") + F.col("_off") - 1).drop("_g", "_h", "_b", "_pos", "_off")


def seeded_split(df: DataFrame, keys: Sequence[str], ratio: float = 0.8, seed: int = 0, out: str = "split") -> DataFrame:
    """Exactly ``floor(n * ratio)`` training rows, by hash order of the row key.

    Bucket counts (at most 65,536) show which bucket holds the cut; only that bucket is
    ranked, to find the last training hash. The split itself is then a plain comparison,
    without a shuffle. Copies of one key that straddle the cut are told apart by position.
    """
    digest = row_hash(seed, keys)
    sizes = df.groupBy(hash_bucket(digest).alias("b")).agg(F.count("*").alias("n")).toPandas().sort_values("b")
    take = math.floor(float(sizes["n"].sum()) * ratio + 1e-9)
    upto = sizes["n"].cumsum()
    beyond = sizes[upto > take]
    if beyond.empty:
        return df.withColumn(out, F.lit("train"))
    bucket = beyond["b"].iloc[0]
    k = int(take - (upto - sizes["n"])[beyond.index[0]])
    if k == 0:
        return df.withColumn(out, F.when(hash_bucket(digest) < bucket, "train").otherwise("test"))
    edge = df.select(digest.alias("h")).filter(hash_bucket(F.col("h")) == bucket)
    place = F.row_number().over(Window.partitionBy(hash_bucket(F.col("h"))).orderBy("h"))
    around = [r.h for r in edge.withColumn("i", place).filter(F.col("i").between(k, k + 1)).orderBy("i").collect()]
    if len(set(around)) == 2:
        return df.withColumn(out, F.when(digest <= around[0], "train").otherwise("test"))
    tied = around[0]
    below = edge.filter(F.col("h") < tied).count()
    plain = df.filter(digest != tied).withColumn(out, F.when(digest < tied, "train").otherwise("test"))
    copies = df.filter(digest == tied).withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(
        F.xxhash64(*df.columns))))
    return plain.unionByName(copies.withColumn(
        out, F.when(F.col("_i") <= k - below, "train").otherwise("test")).drop("_i"))


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], k: int = 5, repeats: int = 1, seed: int = 0) -> DataFrame:
    """Add one ``fold_<r>`` column per repeat; each class is dealt evenly over the folds."""
    out = df
    for r in range(repeats):
        out = _ranked(out, [label], keys, f"{seed}.{r}", f"_pos{r}").withColumn(
            f"fold_{r}", F.pmod(F.col(f"_pos{r}"), F.lit(k)).cast("int")).drop(f"_pos{r}")
    return out


def split_overlap(train: DataFrame, test: DataFrame, text: str) -> DataFrame:
    """Test rows whose exact text also occurs in train: rows, overlapping rows, distinct texts.

    Both sides are reduced to distinct 256-bit hashes of their texts before they meet, so copies cost
    nothing and no text is sent.
    """
    digest = F.sha2(F.col(text).cast("string").cast("binary"), 256).alias("t")
    seen = train.select(digest).filter(F.col("t").isNotNull()).distinct()
    mine = test.groupBy(digest).agg(F.count("*").alias("c"))
    flagged = mine.join(seen.withColumn("_seen", F.lit(True)), "t", "left")
    hit = F.coalesce(F.col("_seen"), F.lit(False))
    return flagged.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("test_rows"),
        F.coalesce(F.sum(F.when(hit, F.col("c"))), F.lit(0)).alias("test_rows_in_train"),
        F.count_if(hit).alias("distinct_shared_texts"))


def union_splits(parts: dict[str, DataFrame], out: str = "split") -> DataFrame:
    """Bag union of named splits, with the name of the part in ``out``."""
    frames = [df.withColumn(out, F.lit(name)) for name, df in parts.items()]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows whose number of copies differs, with ``_surplus`` (left minus right)."""
    columns = left.columns
    both = left.withColumn("_one", F.lit(1)).unionByName(right.select(*columns).withColumn("_one", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_one").alias("_surplus")).filter(F.col("_surplus") != 0)


def permutation_check(source: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: copies missing from and extra in ``parts``, and whether it is a permutation.

    Rows are counted by a 256-bit hash of all their columns, so no row is sent whole.
    """
    def hashed(df: DataFrame) -> DataFrame:
        return df.select(F.sha2(F.to_json(F.struct(*source.columns), {"ignoreNullFields": "false"}).cast("binary"), 256).alias("_row"))

    gap = bag_difference(hashed(source), hashed(parts))
    s = F.col("_surplus")
    missing = F.coalesce(F.sum(F.when(s > 0, s)), F.lit(0))
    extra = F.coalesce(F.sum(F.when(s < 0, -s)), F.lit(0))
    return gap.agg(missing.alias("missing_rows"), extra.alias("extra_rows"),
                   ((missing == 0) & (extra == 0)).alias("is_permutation"))


def first_k(df: DataFrame, order: Sequence[str | Column], k: int) -> DataFrame:
    """The first ``k`` rows of a total order (Spark keeps k rows per task, not a full sort)."""
    return df.orderBy(*order).limit(k)


#: Buckets by whose smallest row the first rows of a group are bounded.
BUCKETS = 64


def _near_first(df: DataFrame, by: Sequence[str], order: str, k: int) -> DataFrame:
    """The rows up to a bound that no one of a group's first ``k`` rows exceeds, for a few groups (their bounds are broadcast).

    The bound is the k-th of the smallest values of hash buckets: k rows at least lie below it, and seldom many more. A group that
    fills fewer buckets is kept whole. Rows are neither sorted nor sent for this.
    """
    bucket = F.pmod(F.xxhash64(order), F.lit(BUCKETS)).alias("_b")
    least = df.filter(F.col(order).isNotNull()).groupBy(*by, bucket).agg(F.min(order).alias("_least"))
    bounds = least.groupBy(*by).agg(F.get(F.sort_array(F.collect_list("_least")), F.lit(k - 1)).alias("_bound"))
    near = join_groups(df, F.broadcast(bounds), by, "left")
    return near.filter(F.col(order).isNull() | F.col("_bound").isNull() | (F.col(order) <= F.col("_bound"))).drop("_bound")


def examples(df: DataFrame, by: Sequence[str], order: str, value: str, k: int = 3, *, few_groups: bool = False) -> DataFrame:
    """The values of the first ``k`` rows per group, as an array. Of ``few_groups`` only rows near the first are ordered."""
    rows = df.select(*by, order, value)
    if few_groups:
        rows = _near_first(rows, by, order, k)
    w = Window.partitionBy(*by).orderBy(order)
    top = rows.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= k)
    return top.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", value))).alias("_v")).select(
        *by, F.col(f"_v.{value}").alias("examples"))


def distinct_outputs(df: DataFrame, raw: str) -> DataFrame:
    return df.groupBy(F.col(raw).alias("raw")).agg(F.count("*").alias("n"))
