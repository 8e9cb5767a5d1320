"""Small tables with the cases every operator must bear."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("Text", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("_row", T.LongType())])


def odd_rows():
    """Nulls everywhere, empty and very long texts, repeated rows and ids, strange characters."""
    rnd = random.Random(5)
    words = ["the", "of", "Ärger", "naïve", "thanon", "ering,", "x", "12", "3.5", "don't", "日本語", "🙂🙂", "á", "▁x", "<s>"]
    long = " ".join(rnd.choice(words) for _ in range(6_000))
    texts = ["", None, " ", "  a  b ", "a b", "ab", "a\nb", "\n\n", "\tx\r\n y\x0b\x0c", "a b  c", "don't DON'T we'll",
             "x" * 3_000, "a " * 900, long, long + "!", "é é", "1234567 12 1", "!!! ??? ###", "trailing  ", " \n \n", "▁▁a ▁",
             "word\n  two   three \n\nfour", "control \x00\x01\x1c\x1f x", "mixed😀emoji 🙂 x", "ﬁ ligature Ⅷ ½ ٣"]
    rows = [(i, t, "en", f"s{i % 3}", 1, "clash", "clash", 7) for i, t in enumerate(texts)]
    rows += [(None, "a b", None, None, None, None, None, None), (None, "a b", None, None, None, None, None, None),
             (3, "  a  b ", "en", "s0", 1, "clash", "clash", 7), (3, "other text with id three", "en", "s0", 1, None, None, 7),
             (900, "a b", "en", None, None, None, None, None), (1000, None, None, None, None, None, None, None)]
    return rows


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
