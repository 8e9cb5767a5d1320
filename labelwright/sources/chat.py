"""Chat records as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TURN = T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])
CHAT_SCHEMA = T.StructType([T.StructField("conversations", T.ArrayType(TURN))])


def read_chat_jsonl(spark: SparkSession, path: str, extra: T.StructType | None = None) -> DataFrame:
    """Blank lines are skipped; a malformed line fails the job."""
    schema = T.StructType([*(extra.fields if extra else []), *CHAT_SCHEMA.fields])
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_chat_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record per line, UTF-8, nulls written out."""
    df.write.mode(mode).option("ignoreNullFields", False).option("encoding", "UTF-8").json(path)
