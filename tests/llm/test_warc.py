import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from quillspan.llm import warc
from quillspan.llm.queries import QUERIES
from quillspan.llm.scratch import Scratch


def plain(rows):
    most = {}
    for page, html in rows:
        if page is not None:
            most[html or ""] = max(page, most.get(html or "", page))
    out = []
    for page, html in rows:
        body = (html or "").encode()
        head = most.get(html or "")
        revisit = head is not None and head != page
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=str)


def test_query_against_a_plain_version(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = QUERIES["op10_warc"](spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == plain([(r.page_id, r.html) for r in pages])


def archive(spark, rows, schema="page_id long, url string, html string"):
    path = Scratch(spark, "t").path("warc")
    warc.write_pages(spark.createDataFrame(rows, schema), path)
    return path


ROWS = [(1, "http://a/é\r\nX: y", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://b", None), (4, "u", ""), (None, "n", "alone"), (None, "n", "<p>same</p>"), (9, "long", "x" * 3_000_000)]


def test_payloads_headers_and_nulls_round_trip(spark):
    path = archive(spark, ROWS)
    got = warc.read(spark, path).collect()
    assert len(got) == len(ROWS)
    by = {r.record_id: r for r in got}
    assert by["<urn:page:2>"].payload == b"<p>same</p>" and by["<urn:page:1>"].payload is None
    assert by["<urn:page:1>"].refers_to == "<urn:page:2>" and "X" not in by["<urn:page:1>"].headers
    assert by["<urn:page:3>"].refers_to == "<urn:page:4>" and by["<urn:page:4>"].payload == b""
    assert by["<urn:page:9>"].payload == b"x" * 3_000_000 and by["<urn:page:2>"].target_uri is None
    assert {r.payload for r in got if r.record_id == "<urn:page:none>"} == {b"alone", None}


def test_predicates_are_pushed_down_and_payloads_skipped(spark):
    path = archive(spark, ROWS)
    found = warc.read(spark, path, "record_id", "record_type", "headers").where((F.col("record_type") == "revisit") & (F.col("record_id") == "<urn:page:1>"))
    assert [r.record_id for r in found.collect()] == ["<urn:page:1>"]
    reader = warc.WarcReader(path, warc.read(spark, path, "record_type").schema)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.In(("headers", "WARC-Date"), ("2024-01-01T00:00:00Z",)), warc.EqualTo(("payload_bytes",), 3)]))
    assert [f.attribute for f in left] == [("payload_bytes",)]
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == 4


def test_skipped_blocks_are_not_read(spark, tmp_path):
    import pyarrow.fs as fs

    path = archive(spark, [(i, "u", f"{i}" + "".join(chr(33 + (i * j * j) % 90) for j in range(200_000))) for i in range(1, 4)])
    stretch = [s for s in warc.WarcReader(path, warc.read(spark, path, "record_type").schema).partitions() if s.end]
    store, _ = warc.open_fs(stretch[0].path)
    seen = [h for s in stretch for h, _ in warc.records(store, warc.open_fs(s.path)[1], s.start, s.end, window=512)]
    assert len(seen) == 3 and isinstance(store, fs.LocalFileSystem)


def test_small_payloads_may_all_be_responses(spark):
    path = Scratch(spark, "t").path("warc")
    warc.write_pages(spark.createDataFrame(ROWS, "page_id long, url string, html string"), path, least=100)
    assert warc.read(spark, path, "record_type").where("record_type = 'revisit'").count() == 0


def test_empty_table_and_clashing_columns(spark):
    assert warc.read(spark, archive(spark, []), "record_id").count() == 0
    path = archive(spark, [(1, "u", "h", "z", b"p")], "page_id long, url string, html string, sha string, payload binary")
    assert warc.read(spark, path, "payload").first().payload == b"h"


def test_repeated_rows_are_alike(spark):
    got = warc.read(spark, archive(spark, [(1, "u", "h"), (1, "u", "h")]), "record_type").collect()
    assert [r.record_type for r in got] == ["response", "response"]


def test_archives_of_other_makers(spark, tmp_path):
    """Plain and compressed files without a manifest, with all kinds of records, one gzip member each."""
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    kinds = [
        ("warcinfo", "application/warc-fields", b"software: x\r\n", b"software: x\r\n"), ("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", b""),
        ("response", "application/http; msgtype=response", http + b"3\r\nabc\r\n2;x\r\nde\r\n0\r\n\r\n", b"abcde"), ("response", "application/http", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\nnot gzip", b"not gzip"),
        ("response", "application/http", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"z" * 300_000), b"z" * 300_000), ("resource", "image/png", b"\x89PNG" * 50_000, b"\x89PNG" * 50_000), ("conversion", "text/plain", b"plain", b"plain"), ("revisit", "application/http", b"HTTP/1.1 200 OK\r\n\r\n", None),
    ]
    parts = [f"WARC/1.0\r\nWARC-Type: {k}\r\nWARC-Record-ID: <{i}>\r\nContent-Type: {c}\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for i, (k, c, b, _) in enumerate(kinds)]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    got = warc.read(spark, str(tmp_path), "record_id", "record_type", "payload").collect()
    assert sorted(((r.record_id, r.record_type, r.payload) for r in got), key=str) == sorted([(f"<{i}>", k, p) for i, (k, _, _, p) in enumerate(kinds)] * 2, key=str)
    assert warc.read(spark, str(tmp_path), "record_id", "record_type").where("record_type = 'resource'").count() == 2


def test_field_names_are_the_same_in_any_case(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    one = f"WARC/1.0\r\nwarc-type: response\r\nWARC-RECORD-ID: <a>\r\nwarc-target-uri: http://x.y/\r\n  z\r\nX-Other: 1\r\ncontent-type: application/http\r\ncontent-length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(one * 2)
    got = warc.read(spark, str(tmp_path), "record_id", "record_type", "target_uri", "payload", "headers").where("record_type = 'response'").collect()
    assert [(r.record_id, r.record_type, r.target_uri, bytes(r.payload), r.headers["X-Other"]) for r in got] == [("<a>", "response", "http://x.y/ z", b"hello", "1")] * 2
