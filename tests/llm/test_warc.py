import hashlib
from base64 import b32encode
from collections import Counter, defaultdict

from labelwright.llm.warc import archive_and_read_back, read_archives, write_archives

ROWS = [(1, "http://a.b/c", "<p>x</p>"), (2, "http://a.b/d", "<p>x</p>"), (9, None, "<p>x</p>"), (3, "u v\r\nw", None), (4, "", ""),
        (5, "http://long", "é🙂" * 70_000), (6, "http://r", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n\x00"), (None, "http://n", "own"), (None, None, "<p>x</p>"),
        (7, "http://same", "twice"), (7, "http://same", "twice"), (7, "http://other", "else"), (8, "z", "\r\n\r\n")]
SCHEMA = "page_id long, url string, html string, HTML string, digest int, kind int"


def table(spark):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in ROWS], SCHEMA).repartition(3)


def expected(rows, min_bytes=0):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    out = Counter()
    for payload, pages in groups.items():
        sha = b32encode(hashlib.sha1(payload).digest()).decode()
        top = max((p for p in pages if p is not None), default=None)
        left = True
        for page in pages:
            response = len(payload) < min_bytes or (page == top and left)
            left = left and not (page == top and response)
            out[page, len(payload), sha, "response" if response else "revisit", None if response else top] += 1
    return out


def found(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_odd_pages(spark, tmp_path):
    assert found(archive_and_read_back(table(spark), str(tmp_path))) == expected(ROWS)
    assert found(archive_and_read_back(table(spark), str(tmp_path), min_bytes=6, shards=3)) == expected(ROWS, 6)


def test_pages_roll_and_come_back_whole(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    out = f"file://{tmp_path}/w"
    manifest = write_archives(pages, out, shards=2, roll_bytes=20_000).collect()
    assert len(manifest) > 4 and sum(r.records for r in manifest) == len(rows)
    files = {p.name: p.read_bytes() for p in (tmp_path / "w").glob("*.warc.gz")}
    assert {r.name: (r.bytes, r.sha1) for r in manifest} == {n: (len(b), hashlib.sha1(b).hexdigest()) for n, b in files.items()}
    back = read_archives(spark, out)
    assert found(back) == expected(rows)
    html = dict((r[0], r[2]) for r in rows)
    assert all(r.payload == html[r.page_id] for r in back.filter("record_type = 'response'").collect())
    write_archives(pages, f"file://{tmp_path}/again", shards=2, roll_bytes=20_000)
    assert files == {p.name: p.read_bytes() for p in (tmp_path / "again").glob("*.warc.gz")}


def test_files_no_manifest_names_are_not_read(spark, tmp_path):
    out = f"file://{tmp_path}/w"
    write_archives(table(spark), out)
    (tmp_path / "w" / "tmp-000000-0000-lost").write_bytes(b"half a file")
    assert found(read_archives(spark, out)) == expected(ROWS)


def test_empty_table(spark, tmp_path):
    assert archive_and_read_back(table(spark).limit(0), str(tmp_path)).collect() == []
