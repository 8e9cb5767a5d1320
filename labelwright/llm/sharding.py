"""Shards that all match the mixture of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, pin, take, text_of

#: Seed of the order inside a source.
SEED = 20


def _mixed(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def stratified_shards(rows: DataFrame, n_shards: int, *, source_col: str = "source", seed: int = SEED) -> DataFrame:
    """Proportional stratified interleaving: ``rows`` plus ``shard`` and ``slot``.

    ``rows`` are short rows: ids and measures, not texts. Rows are put in seeded order within
    their source and ranked there; the fractional rank (rank - 1/2) / (rows of the source)
    orders all rows together, and equal cuts of that order are the shards. So every shard has
    its share of every source, to one row, and shard sizes differ by one at most. Rows with a
    null source are a source of their own. ``slot`` is gapless from 0 in each shard. Rows equal in all columns are
    interchangeable. An empty table gives an empty result.

    A source that holds a third of all rows is ranked over many ranges: no window spans a source.
    """
    names = rows.columns
    plain = rows.toDF(*[f"c{i}" for i in range(len(names))])
    source = f"c{names.index(source_col)}"
    tie = F.rand(seed)  # tells only rows apart that are equal in every column
    keyed = plain.select("*", _mixed(seed, *[F.col(c) for c in plain.columns]).alias("_mix"), tie.alias("_tie"))
    ranged = pin(keyed.repartitionByRange(source, "_mix", "_tie").withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(F.col(source).alias("_source"), "_range").agg(F.count("*").alias("_n"))
    same = Window.partitionBy("_source")  # one row per source and range
    before = same.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_source", F.col("_range").alias("_r"), F.sum("_n").over(same).alias("_all"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", source).orderBy("_mix", "_tie")
    ranked = ranged.withColumn("_in", F.row_number().over(inside)).join(
        counts, (F.col("_range") == F.col("_r")) & F.col(source).eqNullSafe(F.col("_source")))
    share = (2 * (F.col("_before") + F.col("_in")) - 1) / (2 * F.col("_all"))
    mixed = ranked.select(*plain.columns, share.alias("_share"), _mixed(seed, F.col(source)).alias("_first"), "_mix", "_tie")
    placed, total = numbered(mixed, "_share", "_first", "_mix", "_tie")
    shard = F.expr(f"_at * {n_shards} div {max(total, 1)}")
    first = F.expr(f"(_shard * {max(total, 1)} + {n_shards} - 1) div {n_shards}")
    return placed.withColumn("_shard", shard).select(
        *plain.columns, F.col("_shard").cast("int").alias("shard"), (F.col("_at") - first).cast("bigint").alias("slot")).toDF(
            *names, "shard", "slot")


def document_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (UTF-8 bytes plus 1; null text: 1) and text_crc32 of each document."""
    text = text_of("_text")
    return take(docs, id_col, text_col, source_col).toDF("doc_id", "_text", "source").select(
        "doc_id", "source", (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))


def shard_documents(docs: DataFrame, n_shards: int = 8, **columns: str) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null: not the key law), source.

    A null text has no bytes; a null source is a source of its own, null and repeated ids are ids like others. Rows that repeat in all that
    is returned are interchangeable. Fewer rows than shards leave shards empty, an empty table gives an empty result; other columns are ignored.
    """
    placed = stratified_shards(document_rows(docs, **columns), n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "source")
