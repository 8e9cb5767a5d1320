"""Content hashes of files, read in chunks where they lie."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes read at a time; hashing holds no more of a file.
CHUNK = 4 << 20
_LISTED = "path string, file string, n_bytes bigint"


def list_files(spark: SparkSession, path: str, glob: str = "*", *, recursive: bool = True) -> DataFrame:
    """``path, file, n_bytes`` of the files below ``path`` (or of the one file it names) whose name fits ``glob``, empty ones too.

    Names come from the file system's own listing, page by page; no file is opened.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fits = jvm.org.apache.hadoop.fs.GlobFilter(glob)
    found, files = [], root.getFileSystem(conf).listFiles(root, recursive)
    while files.hasNext():
        one = files.next()
        if fits.accept(one.getPath()):
            found.append((one.getPath().toString(), one.getPath().getName(), one.getLen()))
    return spark.createDataFrame(found, _LISTED)


def hash_files(listed: DataFrame, open_file=None, chunk: int = CHUNK) -> DataFrame:
    """``listed`` (path, ...) plus ``sha256`` and ``sha256_lf``: the raw hash, and that with CRLF read as LF.

    Each task streams its files in chunks of ``chunk`` bytes and keeps both hashes at once; a CR at the end of a chunk waits for
    the next one. So a file may have any size, and a task holds one chunk. Files are spread over the cores, one file at a time in a task.
    ``open_file`` opens a path for reading; by default the file system that the path's scheme names.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*listed.schema.fields, T.StructField("sha256", T.StringType()), T.StructField("sha256_lf", T.StringType())])
    at = listed.columns.index("path")

    def hashed(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa
        from pyarrow import fs

        def opened(path: str):
            if path.startswith("file:"):
                return fs.LocalFileSystem().open_input_stream("/" + path[5:].lstrip("/"))
            system, name = fs.FileSystem.from_uri(path)
            return system.open_input_stream(name)

        def both(path: str) -> tuple[str, str]:
            raw, unix, held = sha256(), sha256(), b""
            with (open_file or opened)(path) as stream:
                while part := stream.read(chunk):
                    raw.update(part)
                    part = held + part
                    held = b"\r" if part.endswith(b"\r") else b""
                    unix.update(part[:len(part) - len(held)].replace(b"\r\n", b"\n"))
            unix.update(held)
            return raw.hexdigest(), unix.hexdigest()

        for batch in batches:
            for k in range(batch.num_rows):
                one, two = both(batch.column(at)[k].as_py())
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([one]), pa.array([two])], names=schema.names)

    cores = listed.sparkSession.sparkContext.defaultParallelism
    return listed.repartition(cores, "path").mapInArrow(hashed, schema)


def fingerprint_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``file, n_bytes, sha256, sha256_lf`` of every file below ``path``: raw hash, and hash with CRLF read as LF."""
    return hash_files(list_files(spark, path, glob or "*")).select("file", "n_bytes", "sha256", "sha256_lf")


def compare_manifest(found: DataFrame, recorded: DataFrame, column: str = "sha256_lf") -> DataFrame:
    """Files with ``status`` same / changed / missing / new against a recorded manifest."""
    a = found.select("file", F.col(column).alias("_now"))
    b = recorded.select("file", F.col(column).alias("_then"))
    now, then = F.col("_now"), F.col("_then")
    status = F.when(then.isNull(), "new").when(now.isNull(), "missing").when(now == then, "same").otherwise("changed")
    return a.join(b, "file", "full").select("file", status.alias("status"))
