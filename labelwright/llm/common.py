"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_path

#: The white space of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pin(df: DataFrame, compression: str = "none") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Most tables written here are short rows of ids and hashes, which do not compress; without a
    codec thousands of small files also need no off-heap buffers.
    """
    path = new_path(df.sparkSession, "llm")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_bytes(table: DataFrame) -> int:
    """Bytes of the files of a table made by ``pin``."""
    context, total = table.sparkSession.sparkContext, 0
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        total += path.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``pin`` that no later step reads, since what was made from them is written down."""
    for table in tables:
        spark = table.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that are written down and done.

    Its cleaner acts when the driver's JVM collects garbage, by default every 30 minutes; a job of several large
    shuffles calls this between them, so that the disk holds one of them at a time. The cleaner works in the background, so it
    gets a moment; plans that hold each other take a second collection.
    """
    import gc
    from time import sleep

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        sleep(0.7)


def take(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact spelling.

    Works where other columns differ from them in case alone, or where a name stands twice
    (then the first counts), so that extra columns of the input can never clash.
    """
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)])


def with_row(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and ``_row``, a struct of all columns by position (see ``row_columns``)."""
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    whole = F.struct(*[F.col(f"_{i}") for i in range(len(df.columns))]).alias("_row")
    return plain.select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)], whole)


def unpack_row(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns that ``with_row`` put into ``_row``, under their own names."""
    return df.select(*[F.col("_row")[f"_{i}"].alias(f"_{i}") for i in range(len(names))]).toDF(*names)


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def without_blanks(text: Column) -> Column:
    """``text`` without the characters of ``[\\x20\\x09-\\x0D]``, by byte-wise replacement."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def numbered(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """(``df`` with ``_at``, the 0-based place of every row in the order; number of rows).

    The rows are range partitioned, written down together with the number of their range, and
    numbered inside it; the offsets come from one count per range. No task sees more than a
    range. ``order`` must start with enough distinct values to cut ranges; rows equal in all of
    ``order`` keep an arbitrary order that is fixed once the table is written.
    """
    ranged = pin(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order)
    placed = ranged.withColumn("_in", F.row_number().over(inside)).join(offsets, "_range")
    return placed.withColumn("_at", F.col("_before") + F.col("_in") - 1).drop("_range", "_in", "_before"), ranged.count()


def texts(batches: Iterator, column: str) -> Iterator:
    """(batch, list of texts with '' for null) of Arrow batches."""
    for batch in batches:
        yield batch, [t or "" for t in batch.column(column).to_pylist()]


def size_of(key: str, value: bytes = b"") -> int:
    """Bytes that an entry of a dictionary takes, about: its slots, two objects and what they hold."""
    return 190 + len(key) + len(value)


class Memory(dict):
    """What ``make`` gives for a key, remembered for at most ``limit`` bytes of entries; long keys are made anew each time."""

    def __init__(self, make, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.held = make, limit, longest, 0

    def __missing__(self, key):
        value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        """Remember a value that was made elsewhere."""
        if len(key) <= self.longest:
            self.held += 190 + len(key) + len(value)
            if self.held > self.limit:  # the older half goes
                from itertools import islice

                for old in list(islice(self, len(self) // 2)):
                    self.held -= size_of(old, self[old])
                    del self[old]
            self[key] = value


def worker_state(name: str, make):
    """One object per Python worker process, kept over tasks (a bounded cache, a loaded model)."""
    import sys
    import types

    home = sys.modules.setdefault("_labelwright_state", types.ModuleType("_labelwright_state"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)
