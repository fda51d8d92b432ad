import hashlib

from pyspark.sql import functions as F

from hirelake.llm import warc

SCHEMA = "page_id bigint, url string, html string, record_type string, chunk int, last string"


def _pages(spark):
    big = "".join(f"<p>line {n} é\r\n\r\nWARC/1.1\r\n</p>" for n in range(9000))
    rows = [
        (1, "http://a.net/x", "a" * 1000),
        (2, None, "a" * 1000),
        (3, "http://b.net/\r\nx%0A", "a" * 1000),
        (4, "http://c", "a" * 999),
        (5, "http://c", "a" * 999),
        (6, "", None),
        (7, "x", ""),
        (8, "y", big),
        (8, "y", big),
        (9, "y", "é" * 500),
        (None, "y", "é" * 500),
        (None, "z", "ñ" * 500),
    ]
    return spark.createDataFrame([(*r, "t", 1, "l") for r in rows], SCHEMA)


def test_round_trip(spark):
    pages = _pages(spark)
    files, folder = warc.write_pages(pages)
    assert files.agg(F.sum("records")).first()[0] == 12
    found = sorted(
        (r.page_id or -1, r.record_type, r.refers_to or -1, r.payload_bytes, r.payload_digest)
        for r in warc.read_records(files, folder).collect()
    )
    refers = {1: 3, 2: 3}
    expected = []
    for r in pages.collect():
        data = (r.html or "").encode()
        to = refers.get(r.page_id, -1)
        if r.page_id is None and "é" in r.html:
            to = 9
        kind = "response" if to < 0 else "revisit"
        expected.append((r.page_id or -1, kind, to, len(data), hashlib.sha1(data).hexdigest()))
    assert found == sorted(expected)


def test_chunks(spark):
    pages = _pages(spark).filter("page_id = 8").limit(1)
    files, folder = warc.write_pages(pages)
    rows = sorted(warc.read_archives(files, folder).collect(), key=lambda r: r.chunk_no)
    html = pages.first().html.encode()
    assert b"".join(r.chunk for r in rows) == html and len(rows) > 3
    assert max(len(r.chunk) for r in rows) == warc.CHUNK
    for n, r in enumerate(rows):
        assert r.digest_so_far == hashlib.sha1(html[: (n + 1) * warc.CHUNK]).hexdigest()
        assert r.last == (n == len(rows) - 1)


def test_urls_come_back(spark):
    files, folder = warc.write_pages(_pages(spark))
    found = {r.page_id: r.url for r in warc.read_records(files, folder).collect()}
    assert found[2] is None and found[3] == "http://b.net/\r\nx%0A" and found[6] == ""


def test_no_pages(spark):
    files, folder = warc.write_pages(_pages(spark).limit(0))
    assert warc.read_records(files, folder).count() == 0
