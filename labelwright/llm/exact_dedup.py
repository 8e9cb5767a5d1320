"""Exact duplicates of whole texts, white space aside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import take, text_of, unpack_row, with_row, without_blanks


def _groups(rows: DataFrame) -> DataFrame:
    """Group by 128-bit hash and, inside it, by the bytes of the normalised text.

    The text is part of the grouping key, so texts whose hashes collide are told apart byte by
    byte. Partial aggregation sends one copy of a text per task, however often it occurs there.
    """
    order = F.struct(-F.col("_size"), F.col("doc_id").isNull(), F.col("doc_id"))
    return rows.groupBy("_hash", "_norm").agg(F.min(order).alias("_best"), F.count("*").alias("group_size"))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of ``[\\x20\\x09-\\x0D]``; null counts
    as empty. Of equal texts the row with the most code points stays, then the smallest id (a
    null id comes last). Rows that repeat id and text count each in ``group_size``; exactly one
    of them is kept. An empty table gives an empty result; other columns are ignored.

    ``content_hash`` maps the normalised text's bytes to the grouping hash.
    """
    rows = take(docs, id_col, text_col).toDF("doc_id", "_text").select(
        "doc_id", F.char_length(text_of("_text")).alias("_size"), without_blanks(text_of("_text")).alias("_norm"))
    rows = rows.withColumn("_hash", content_hash(F.col("_norm").cast("binary")))
    sha = F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256")
    groups = _groups(rows).select(F.col("_hash").alias("_g"), sha, "group_size", F.col("_best.doc_id").alias("keep_id"),
                                  (-F.col("_best.col1")).alias("_keep_size"))
    # rows that repeat id and text are one row with a count until the end, so that one of them can be kept
    members = rows.select("doc_id", "_size", F.col("_hash").alias("_g"), sha).groupBy("_g", "text_sha256", "doc_id", "_size").agg(
        F.count("*").alias("_times"))
    joined = members.join(groups, ["_g", "text_sha256"])
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_size") == F.col("_keep_size"))
    copies = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))))
    return copies.select("doc_id", "keep_id", "group_size", (best & (F.col("_copy") == 1)).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay (see ``exact_groups``), with all their columns.

    Null texts are equal to empty ones; a null id gives way to any other. Of rows that repeat id and text one stays, whichever
    it is where other columns differ. An empty table stays empty; columns that differ in case only, or repeat a name, come back as they were.
    """
    rows = with_row(docs, id_col, text_col).toDF("doc_id", "_text", "_row")
    rows = rows.select("doc_id", "_row", F.char_length(text_of("_text")).alias("_size"),
                       without_blanks(text_of("_text")).alias("_norm"))
    order = F.struct(-F.col("_size"), F.col("doc_id").isNull(), F.col("doc_id"))
    kept = rows.withColumn("_hash", F.md5(F.col("_norm").cast("binary"))).groupBy("_hash", "_norm").agg(
        F.min_by("_row", order).alias("_row"))
    return unpack_row(kept, docs.columns)
