"""Session helpers: a tuned local session and durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "labelwright", **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a local session (a laptop, the tests) that names neither gets a temporary folder, which is
    remembered in the session so that all jobs share it. On a cluster executors would each write to
    their own disk there, so a session that names no folder is refused.
    """
    configured = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
                  or spark.conf.get("labelwright.scratch.dir", None))
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="labelwright-")
    spark.conf.set("labelwright.scratch.dir", made)
    return made


def new_path(spark: SparkSession, kind: str) -> str:
    path = f"{scratch_dir(spark)}/labelwright/{kind}-{uuid.uuid4().hex}"
    for paths in _OPEN:
        paths.append(path)
    return path


#: Paths made inside the open ``scratch`` blocks.
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables made inside the block when it ends.

    Results that are read after the block must have been written elsewhere, or collected.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in _OPEN.pop():
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Used where several later steps need one intermediate result: it is computed once, has
    known size statistics (so Spark can pick joins by real sizes), a short lineage, and
    survives the loss of executors.
    """
    path = new_path(df.sparkSession, "pin")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task, where each row is dear to work on.
TASK_ROWS = 50_000


def spread(df: DataFrame, rows: int | None = None, each: int | None = None) -> DataFrame:
    """``df`` over all cores, where its source comes in fewer partitions (one short file, say).

    For tables whose rows are cheap to move and dear to work on. ``df`` should be a plain scan: a large
    one has partitions enough and is left as it is. With ``rows``, the number of its rows or a bound of it, ``df`` may be any step,
    and is cut into tasks of about ``each`` rows (``TASK_ROWS``), so that no task grows with the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        return df.repartition(max(cores, -(-rows // (each or TASK_ROWS))))
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
