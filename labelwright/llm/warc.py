"""Web archives: a deterministic sharded writer, and a reader."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import take, text_of

#: Compressed bytes after which a file is closed and the next one begun.
ROLL_BYTES = 256 << 20
#: Fixed value: date of all records, so that equal input gives equal files.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _first_of_payload(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, digest, top): ``top`` is the largest page_id with the payload, for pages that revisit another.

    Hashes only; copies are summed up before they are sent, and the largest group meets one short row.
    """
    each = pages.filter(F.octet_length("html") >= min_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("_n"))
    top = each.groupBy("digest").agg(F.max("page_id").alias("top"), F.sum("_n").alias("_all")).filter("_all > 1")
    return each.join(top, "digest").select("page_id", "digest", "top")


def _writer(out: str, roll_bytes: int):
    """Write a sorted partition to gzip members, roll files, and tell what was written.

    A page is preceded by the row that tells its payload's response, if there are copies.
    """
    def write(batches: Iterator) -> Iterator:
        import hashlib
        import uuid as ids
        import zlib
        from base64 import b32encode

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(out)
        shard, attempt = TaskContext.get().partitionId(), ids.uuid4().hex[:12]
        stream, number, size, rows, digest, done = None, 0, 0, 0, None, []

        def member(text: str, block: bytes) -> bytes:
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()

        def close():
            nonlocal stream, number
            if stream:
                stream.close()
                done.append((shard, number, f"tmp-{shard:06d}-{number:04d}-{attempt}", f"part-{shard:06d}-{number:04d}.warc.gz", size, rows, digest.hexdigest()))
                stream, number = None, number + 1

        def keep(data: bytes):
            nonlocal size
            stream.write(data)
            digest.update(data)
            size += len(data)

        def put(data: bytes):
            nonlocal stream, size, rows, digest
            if stream is None:
                size, rows, digest = 0, 0, hashlib.sha1()
                stream = store.open_output_stream(f"{root}/tmp-{shard:06d}-{number:04d}-{attempt}", compression=None)
                keep(member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:uuid:{ids.uuid5(ids.NAMESPACE_OID, f'{shard}-{number}')}>\r\n"
                           f"WARC-Filename: part-{shard:06d}-{number:04d}.warc.gz\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n", b""))
            keep(data)
            rows += 1
            if size >= roll_bytes:
                close()

        def record_id(page: str) -> str:
            return f"<urn:uuid:{ids.uuid5(ids.NAMESPACE_URL, page)}>"

        told, seen = None, None
        for batch in batches:
            for page, key, url, html, top in zip(*(batch.column(c).to_pylist() for c in ("page_id", "digest", "url", "html", "top")), strict=True):
                if html is None:  # the response of this page's payload
                    told, seen = (page, key, top), None
                    continue
                payload = html.encode()
                revisit = told is not None and told[:2] == (page, key) and (told[2] != page or seen == (page, key))
                seen = (page, key)
                sha = b32encode(hashlib.sha1(payload).digest()).decode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                block = head if revisit else head + payload
                name = "" if page is None else str(page)
                address = "".join((url or "").split()) or "urn:page:" + name
                lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Date", DATE), ("WARC-Target-URI", address),
                         ("WARC-Record-ID", record_id(f"{name}|{address}|{sha}")), ("WARC-Payload-Digest", f"sha1:{sha}"),
                         ("WARC-Block-Digest", f"sha1:{b32encode(hashlib.sha1(block).digest()).decode()}"), ("X-Page-ID", name)]
                if revisit:
                    lines += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", "" if told[2] is None else str(told[2]))]
                lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
                put(member("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n", block))
        close()
        columns = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "number", "written", "name", "bytes", "records", "sha1"])

    return write


def write_archives(pages: DataFrame, out: str, *, shards: int | None = None, roll_bytes: int = ROLL_BYTES, min_bytes: int = 0,
                   id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row of ``pages`` below ``out`` (a URI of a shared store) and return the manifest.

    Records are range-sorted by page_id and payload hash into shards; a shard rolls to a new file
    once ``roll_bytes`` compressed bytes are written. Headers, lengths and digests are made anew from
    the payload (the html in UTF-8; null is empty). Of records with equal payloads of at least
    ``min_bytes``, the one with the largest page_id is a response and the others revisit it; rows that
    repeat page_id and payload are one response and revisits. A null page_id is smaller than any other.

    A task writes under a temporary name of its own attempt and reports what it wrote. That
    report is written as a table (``out/written``); only then are its files renamed, and the manifest
    (``out/manifest``) is the last thing to appear. So a task that ran twice leaves at most a stray
    temporary file that no manifest names, and the renaming can be repeated. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    rows = take(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    rows = rows.withColumn("html", text_of("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    tops = _first_of_payload(rows, min_bytes)
    told = tops.select("page_id", "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "top", F.lit(0).alias("kind"))
    both = told.unionByName(rows.select("page_id", "digest", "url", "html", F.lit(None).cast(rows.schema["page_id"].dataType).alias("top"), F.lit(1).alias("kind")))
    by = ["page_id", "digest"]
    dealt = both.repartitionByRange(shards, *by) if shards else both.repartitionByRange(*by)
    sorted_rows = dealt.sortWithinPartitions(*by, "kind", "url").drop("kind")
    schema = "shard bigint, number bigint, written string, name string, bytes bigint, records bigint, sha1 string"
    sorted_rows.mapInArrow(_writer(out, roll_bytes), schema).write.parquet(f"{out}/written")
    written = spark.read.schema(schema).parquet(f"{out}/written")

    def rename(batches: Iterator) -> Iterator:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out)
        for batch in batches:
            for old, new in zip(batch.column("written").to_pylist(), batch.column("name").to_pylist(), strict=True):
                there = store.get_file_info(f"{root}/{old}").type != fs.FileType.NotFound
                if there:  # else an earlier attempt of this task has renamed it
                    store.move(f"{root}/{old}", f"{root}/{new}")
            yield batch

    written.mapInArrow(rename, schema).drop("written").write.parquet(f"{out}/manifest")
    return spark.read.schema("shard bigint, number bigint, name string, bytes bigint, records bigint, sha1 string").parquet(f"{out}/manifest")


def read_archives(spark: SparkSession, out: str, *, id_type: str = "bigint") -> DataFrame:
    """One row per record of the files that the manifest names, read member by member.

    page_id, url, record_type, payload_bytes, payload_digest (bare base32), refers_to and payload
    (null for revisits). Payload length and digest of a response are taken from the payload itself
    and must equal its headers; those of a revisit come from its headers.
    """
    manifest = spark.read.schema("shard bigint, number bigint, name string, bytes bigint, records bigint, sha1 string").parquet(f"{out}/manifest")

    def members(stream):
        import zlib

        data, packer, parts = stream.read(1 << 20), None, []
        while data:
            packer = packer or zlib.decompressobj(31)
            parts.append(packer.decompress(data))
            if packer.eof:
                yield b"".join(parts)
                data, packer, parts = packer.unused_data or stream.read(1 << 20), None, []
            else:
                data = stream.read(1 << 20)
        if packer is not None:
            raise ValueError("an archive ends inside a record")

    def read(batches: Iterator) -> Iterator:
        import hashlib
        from base64 import b32encode

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out)
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in members(stream):
                        head, _, block = record.partition(b"\r\n\r\n")
                        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
                        length = int(http.decode().rpartition("Content-Length: ")[2].split("\r\n")[0])
                        sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != length or b32encode(hashlib.sha1(payload).digest()).decode() != sha):
                            raise ValueError(f"a payload differs from its headers in {name}")
                        rows.append((fields.get("X-Page-ID") or None, fields["WARC-Target-URI"], kind, length, sha, fields.get("X-Refers-To-Page-ID") or None,
                                     payload.decode() if kind == "response" else None))
                        held += len(payload)
                        if len(rows) >= 1_000 or held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = manifest.select("name").repartition(max(1, min(100_000, manifest.count())))
    found = files.mapInArrow(read, "page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, payload string")
    return found.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def archive_and_read_back(pages: DataFrame, root: str, **options) -> DataFrame:
    """Write ``pages`` to a new folder below ``root`` and read the archives back (see the two functions)."""
    out = f"{root}/warc-{uuid.uuid4().hex}"
    out = out if "://" in out or out.startswith("file:") else f"file://{out}"
    write_archives(pages, out, **options)
    kind = pages.schema[pages.columns.index(options.get("id_col", "page_id"))].dataType.simpleString()
    return read_archives(pages.sparkSession, out, id_type=kind)
