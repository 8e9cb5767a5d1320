"""From colliding sets to verified links and classes, without all pairs of a bucket.

Sets are known by a key; ``kind`` of key is free. Used with different signatures and texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, pin

#: Blanks between words, and words of a shingle.
BLANK = r"[\x20\x09-\x0D]+"
SHINGLE = 5
THRESHOLD = 0.8
#: Counters of how common shingles are; shingles that share one only look commoner than they are.
COUNTERS = 1 << 18


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def shingles(ws: Column, size: int = SHINGLE) -> Column:
    """Hashes of the distinct shingles of a word array; a shorter text is one shingle, no words are none."""
    parts = F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - (size - 1), F.lit(1))), lambda w, i: F.xxhash64(
        w, *[F.get(ws, i + k) for k in range(1, size)]))
    return F.array_distinct(parts)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(1.0))


def crowded(cells: DataFrame) -> DataFrame:
    """Of (bucket, key) cells, all distinct, those in buckets of two keys or more, with ``popularity`` of the key.

    Popularity is the number of keys that a key meets in its buckets. The original of many
    altered copies meets most of them, though two copies may be far apart, so the most popular
    key of a bucket is the one to compare with the others. Counts are summed up before they are sent.
    """
    counts = cells.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    rows = pin(cells.join(counts, "bucket"))
    popular = pin(rows.groupBy("key").agg(F.sum("n").alias("popularity")))
    told = pin(rows.select("bucket", "key").join(popular, "key"))
    forget(rows, popular)
    return told


def hubs(rows: DataFrame) -> DataFrame:
    """(bucket, hub): the most popular key of every bucket."""
    return pin(rows.groupBy("bucket").agg(F.max_by("key", F.struct("popularity", "key")).alias("hub")))


def components(links: DataFrame) -> DataFrame:
    """(key, comp) of every key in ``links`` (a, b): ``comp`` is the smallest key connected with it.

    Each round hangs a key under its smallest neighbour, if that is smaller, and follows these to the top, each step twice as far as
    the one before. Then the tops alone go on, with the links between different ones: half of the keys at most, and none where a
    component is done. Every step is written down, and those before it are dropped.
    """
    edges, whole = pin(links.select("a", "b").distinct()), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels = pin(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "key"))
        while True:
            step = pin(labels.join(labels.select(F.col("key").alias("comp"), F.col("comp").alias("next")), "comp").select(
                "key", F.col("comp").alias("old"), F.col("next").alias("comp")))
            forget(labels)
            labels = step.select("key", "comp")
            if step.filter("comp != old").isEmpty():
                break
        tops = [labels.select(F.col("key").alias(k), F.col("comp").alias(f"_{k}")) for k in "ab"]
        rest = pin(edges.join(tops[0], "a").join(tops[1], "b").filter("_a != _b").select(
            F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        forget(edges)
        if whole is None:
            whole = labels
        else:
            further = labels.select(F.col("key").alias("comp"), F.col("comp").alias("top"))
            told = pin(whole.join(further, "comp", "left").select("key", F.coalesce("top", "comp").alias("comp")))
            forget(whole, labels)
            whole = told
        if rest.isEmpty():
            return whole
        edges = rest


def rare_shingles(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, token): of ``sets`` (key, tokens), distinct tokens written down, the rarest of each, as many as two similar sets need to share one.

    Similar sets have at least ``threshold`` of the larger one in common, so of n tokens in any order that all sets keep to, the first
    n - ceil(threshold * n) + 1 hold the first common one. Here the order is by a counter of how often tokens occur, then by the token.
    """
    import numpy as np

    spot = F.col("t").bitwiseAND(COUNTERS - 1)
    counts = sets.select(F.explode("tokens").alias("t")).groupBy(spot.alias("c")).agg(F.count("*").alias("n")).toArrow()  # a row per counter
    table = np.zeros(COUNTERS, np.int64)
    table[counts.column("c").to_numpy()] = counts.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def pick(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            token = batch.column(1).flatten().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((token, shared.value[token & (COUNTERS - 1)], row))
            within = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            kept = within < (size - np.ceil(threshold * size - 1e-6).astype(np.int64) + 1)[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[kept])), pa.array(token[order][kept])], names=["key", "token"])

    kind = sets.schema["key"].dataType.simpleString()
    return sets.select("key", "tokens").mapInArrow(pick, f"key {kind}, token bigint")


def linked_classes(rows: DataFrame, verify: Callable[[DataFrame], DataFrame], threshold: float = THRESHOLD, *,
                   sketches: DataFrame | None = None, alike: Callable[[str, str], Column] | None = None,
                   finer: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes, links) from the rows of ``crowded``.

    ``verify`` turns distinct (a, b) pairs into (a, b, similarity). ``links`` has the verified pairs;
    ``classes`` has (key, comp) for every key with a link. ``sketches`` (key, ...) and ``alike``, a condition
    on two rows of a bucket with these columns under the given names, tell pairs that cannot be similar without their texts.
    ``finer`` turns a table of keys into (key, token), such that similar keys have a token in common (``rare_shingles``).

    1. In each bucket all keys are compared with the bucket's hub only.
    2. Keys of one bucket that are not connected after that are compared with each other, but for pairs that cannot be
       similar: their similarities to the hub are too far apart (one minus the Jaccard similarity is a metric), or
       their sketches say so. So no link that could join two classes is lost, and a group of copies around an
       original costs one comparison per copy. With ``finer``, these keys are dealt to a bucket per old bucket and token instead, where both
       steps begin anew: a bucket of many keys around a common line is not compared pair by pair.
    """
    chosen = hubs(rows)
    with_hub = rows.select("bucket", "key").join(chosen, "bucket")
    first = pin(verify(with_hub.filter("key != hub").select(
        F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()))
    near = first.filter(F.col("similarity") >= threshold)
    classes = components(near)
    placed = pin(with_hub.join(classes, "key", "left").withColumn("comp", F.coalesce("comp", "key")))
    # buckets that are still in two parts, besides those of two keys, which are settled
    open_ = pin(placed.groupBy("bucket").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y"), F.count("*").alias("_n")).filter(
        "_x != _y AND _n > 2").select("bucket"))
    left = placed.join(open_, "bucket").filter("key != hub")
    if finer is not None:
        forget(chosen)
        left = pin(left.select("bucket", "key", "comp"))
        forget(placed, open_)
        tokens = finer(left.select("key").distinct())
        cells = pin(left.join(tokens, "key").select(F.xxhash64("bucket", "token").alias("bucket"), "key", "comp"))
        forget(left)
        several = cells.groupBy("bucket").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).filter("_x != _y").select("bucket")
        some = crowded(cells.join(several, "bucket").select("bucket", "key").distinct())
        forget(cells)
        links = pin(near.select("a", "b", "similarity").union(linked_classes(some, verify, threshold)[1]).distinct())
        return components(links), links
    left = left.withColumns({"a": F.least("key", "hub"), "b": F.greatest("key", "hub")})
    left = left.join(first.select("a", "b", "similarity"), ["a", "b"]).select("bucket", "key", "comp", "similarity")
    left = pin(left if sketches is None else left.join(sketches, "key"))
    apart = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.comp") != F.col("y.comp"))
    apart = apart & (F.abs(F.col("x.similarity") - F.col("y.similarity")) <= 1 - threshold + 1e-6)
    if alike is not None:
        apart = apart & alike("x", "y")
    rest = left.alias("x").join(left.alias("y"), apart).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    rest = pin(rest.join(first, ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return classes, near.select("a", "b", "similarity")
    second = pin(verify(rest)).filter(F.col("similarity") >= threshold)
    links = near.select("a", "b", "similarity").union(second.select("a", "b", "similarity"))
    return components(links), links


def verify_texts(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(a, b, similarity): exact Jaccard of the shingle sets of ``texts`` (key, text; one row per key, written down).

    Plain equi-joins, which Spark can split where a key is hot.
    """
    joined = pin(pairs).join(texts.select(F.col("key").alias("a"), F.col("text").alias("_ta")), "a").join(
        texts.select(F.col("key").alias("b"), F.col("text").alias("_tb")), "b")
    staged = joined.select("a", "b", words(F.col("_ta")).alias("_wa"), words(F.col("_tb")).alias("_wb"))
    staged = staged.select("a", "b", shingles(F.col("_wa"), size).alias("_sa"), shingles(F.col("_wb"), size).alias("_sb"))
    return staged.select("a", "b", jaccard(F.col("_sa"), F.col("_sb")).alias("similarity"))
