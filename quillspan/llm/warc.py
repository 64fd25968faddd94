"""WARC archives as a Spark data source, ``spark.read.format("warc")``.

Writing puts one or more ``.warc`` files a task into a folder, and on success a manifest
that names the files of the tasks that counted, with record starts about every
``SPLIT`` bytes. Reading plans a partition for each such stretch. Headers of a record are
parsed first; record-type and header predicates that Spark pushes down are tested on
them alone, and a payload that no predicate lets through or that the schema doesn't ask
for is stepped over unread. Response bodies are gzip-encoded inside their block, so what is
stepped over is never decoded. Archives of other makers are read too: a ``.warc`` without a manifest, and a
``.warc.gz``, is a partition of its own, as nothing says where its records begin.

Paths may be of any file system that pyarrow reaches. All files are written under names of
their own, so a task that runs twice leaves no doubt about which of its files count."""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: The reader's columns; a schema given by the user may name any of them in any order.
COLUMNS = {
    "record_id": "string", "record_type": "string", "target_uri": "string", "warc_date": "string", "payload_digest": "string", "refers_to": "string",
    "content_type": "string", "content_length": "bigint", "payload_bytes": "bigint", "headers": "map<string,string>", "payload": "binary",
}
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type"}
#: Names of fields are the same in any case; those that are looked at are spelled so.
SPELLED = {name.lower(): name for name in (*HEADERS.values(), "Content-Length", "X-Payload-Length")}
SPLIT, ROLL, MANIFEST = 64 << 20, 512 << 20, "_manifest.json"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: gzip\r\n\r\n"
REVISIT = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str) -> str:
    """A header's value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes, digest: str, n: int, refers_to: str | None = None) -> bytes:
    """One record. A revisit carries no body; its digest and length are of the full payload."""
    if kind == "response":
        deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
        block = HTTP + deflate.compress(payload) + deflate.flush()
    else:
        block = REVISIT
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {clean(uri)}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {refers_to}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Takes (record_id, record_type, target_uri, warc_date, payload, payload_digest, payload_bytes, refers_to)."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, out, size = [], None, 0
        store, root = open_fs(self.path)
        store.create_dir(root, recursive=True)
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= ROLL:
                    if out is not None:
                        out.close()
                    files.append({"name": f"part-{uuid.uuid4().hex}.warc", "starts": [0], "size": 0})
                    out, size = store.open_output_stream(posixpath.join(root, files[-1]["name"])), 0
                elif size - files[-1]["starts"][-1] >= SPLIT:
                    files[-1]["starts"].append(size)
                size += out.write(record(row["record_type"], row["record_id"], row["target_uri"], row["warc_date"], row["payload"] or b"", row["payload_digest"], row["payload_bytes"], row["refers_to"]))
                files[-1]["size"] = size
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        store, root = open_fs(self.path)
        store.create_dir(root, recursive=True)
        names = posixpath.join(root, MANIFEST)
        listed = []
        if store.get_file_info(names).type == fs.FileType.File:
            with store.open_input_stream(names) as f:
                listed = json.loads(f.read())
        listed += [x for m in messages if m for x in m.files]
        with store.open_output_stream(names) as f:
            f.write(json.dumps(listed).encode())

    def abort(self, messages: list) -> None:
        store, root = open_fs(self.path)
        for m in messages:
            for x in m.files if m else ():
                store.delete_file(posixpath.join(root, x["name"]))


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.tests = path, schema, []
        if unknown := [f.name for f in schema if f.name not in COLUMNS]:
            raise ValueError(f"no such column of a WARC record: {', '.join(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and IN on header columns and on ``headers['Name']``; the rest stay with Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) else None
            if name in HEADERS and len(f.attribute) == 1:
                self.tests.append((HEADERS[name], frozenset([f.value] if isinstance(f, EqualTo) else f.value), name))
            elif name == "headers" and len(f.attribute) == 2:
                self.tests.append((f.attribute[1], frozenset([f.value] if isinstance(f, EqualTo) else f.value), name))
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        store, root = open_fs(self.path)
        names = posixpath.join(root, MANIFEST)
        out = []
        if store.get_file_info(names).type == fs.FileType.File:
            with store.open_input_stream(names) as f:
                for x in json.loads(f.read()):
                    out += [Stretch(posixpath.join(self.path, x["name"]), a, b) for a, b in zip(x["starts"], [*x["starts"][1:], x["size"]], strict=True)]
        else:
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.path.endswith((".warc", ".warc.gz")):
                    out.append(Stretch(posixpath.join(self.path, posixpath.basename(info.path)), 0, info.size))
        return out or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.start:
            return
        store, path = open_fs(partition.path)
        names = [f.name for f in self.schema]
        rows: dict[str, list] = {n: [] for n in names}
        held = 0
        found = gzip_records(store, path) if path.endswith(".gz") else records(store, path, partition.start, partition.end)
        for head, block in found:
            if any(field(head, h, c) not in values for h, values, c in self.tests):
                continue
            for n in names:
                rows[n].append(column(n, head, block))
            held += 200 + (len(rows["payload"][-1] or b"") if "payload" in rows else 0)
            if held > 8 << 20:
                yield batch_of(rows, self.schema)
                rows, held = {n: [] for n in names}, 0
        if held:
            yield batch_of(rows, self.schema)


ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}


def batch_of(rows: dict[str, list], schema: StructType) -> pa.RecordBatch:
    arrays = [pa.array([list(x.items()) for x in rows[f.name]] if f.name == "headers" else rows[f.name], ARROW[f.dataType.simpleString()]) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])


def field(head: dict[str, str], name: str, asked: str) -> str | None:
    value = head.get(name)
    return value.removeprefix("sha1:") if value and asked == "payload_digest" else value


def column(name: str, head: dict[str, str], block) -> object:
    if name == "headers":
        return dict(head)
    if name == "payload":
        return payload_of(head, block())
    if name == "content_length":
        return int(head["Content-Length"])
    if name == "payload_bytes":
        return int(head["X-Payload-Length"]) if "X-Payload-Length" in head else None
    return field(head, HEADERS[name], name)


def payload_of(head: dict[str, str], block: bytes) -> bytes | None:
    """The body of a response or request as it was before its encodings, the block of records that have no HTTP
    headers, and null for revisits. A body that isn't what its headers say is given as it stands."""
    kind = head.get("WARC-Type")
    if kind == "revisit":
        return None
    if kind not in ("response", "request") or not head.get("Content-Type", "application/http").lower().startswith("application/http"):
        return block
    http, _, body = block.partition(b"\r\n\r\n")
    http = http.lower()
    try:
        plain = dechunked(body) if b"\r\ntransfer-encoding: chunked" in http else body
        return zlib.decompress(plain, 47) if b"\r\ncontent-encoding: gzip" in http and plain else plain
    except (ValueError, zlib.error):
        return body


def dechunked(body: bytes) -> bytes:
    """A body without the sizes of its chunks."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def header_of(text: bytes, where: str) -> dict[str, str]:
    version, *lines = re.sub(r"\r\n[ \t]+", " ", text.decode("utf-8", "replace")).split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record begins at {where}")
    found = ((k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines))
    return {SPELLED.get(k.lower(), k): v for k, v in found}


def gzip_records(store: fs.FileSystem, path: str, window: int = 1 << 16) -> Iterator[tuple[dict[str, str], object]]:
    """As :func:`records`, of a compressed archive from its beginning; what isn't asked for is read past, not kept."""
    with store.open_input_stream(path, compression="gzip") as f:
        held, seen = b"", 0

        def fill(n: int) -> bool:
            nonlocal held
            while len(held) < n and (more := f.read(max(window, n - len(held)))):
                held += more
            return len(held) >= n

        while fill(1) and (held := held.lstrip(b"\r\n")) or fill(1):
            size = 2048
            while (cut := held.find(b"\r\n\r\n")) < 0:
                if not fill(size) and b"\r\n\r\n" not in held:
                    raise ValueError(f"a record of {path} has no end of headers")
                size *= 4
            head = header_of(held[:cut], f"record {seen} of {path}")
            held, seen, n = held[cut + 4 :], seen + 1, int(head["Content-Length"])

            def block(n: int = n) -> bytes:
                fill(n)
                return held[:n]

            yield head, block
            left = n + 4
            while left > len(held):
                left -= len(held)
                held = f.read(window)
                if not held:
                    return
            held = held[left:]


def records(store: fs.FileSystem, path: str, start: int, end: int, window: int = 1 << 16) -> Iterator[tuple[dict[str, str], object]]:
    """Headers of each record and a function that reads its block. A block that isn't
    asked for is skipped by a seek, beyond what the window already holds."""
    with store.open_input_file(path) as f:
        held, base, at = b"", start, start

        def have(first: int, n: int) -> bytes:
            nonlocal held, base
            if first < base or first + n > base + len(held):
                f.seek(first)
                held, base = f.read(max(n, window)), first
            return held[first - base : first - base + n]

        while at < end:
            size = 2048
            while (cut := (text := have(at, min(size, end - at))).find(b"\r\n\r\n")) < 0:
                if size >= end - at:
                    raise ValueError(f"a record of {path} at {at} has no end of headers")
                size *= 4
            head = header_of(text[:cut], f"{at} of {path}")
            first, n = at + cut + 4, int(head["Content-Length"])
            yield head, lambda first=first, n=n: have(first, n)
            at = first + n + 4


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return ", ".join(f"{k} {v}" for k, v in COLUMNS.items())

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A record for each row of ``pages`` (page_id, url, html): of equal payloads of at least
    ``least`` bytes the one with the largest page_id is the response, the others revisit it.

    Null html is the empty payload. A null page_id is never the largest; where no other
    has its payload, it is a response. Rows that repeat a page_id and its html are alike.
    The largest id is summed up before the shuffle; pages join it by digest."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    heads = rows.where(F.col("payload_bytes") >= least).groupBy("sha").agg(F.max("page_id").alias("head"))
    joined = rows.join(heads, "sha", "left")
    revisit = F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("page_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return joined.select(
        F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:none>")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"),
        F.when(~revisit, F.col("payload")).alias("payload"), F.col("sha").alias("payload_digest"), "payload_bytes", F.when(revisit, urn(F.col("head"))).alias("refers_to"),
    )


def write_pages(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write the records of ``pages`` as archives under ``path``."""
    register(pages.sparkSession)
    page_records(pages, least).withColumn("payload_digest", base32_of(F.col("payload_digest"))).write.format("warc").mode("append").save(path)


def base32_of(hexadecimal):
    """Upper-case base32 of 40 hexadecimal digits: each 5 of them are 4 base32 digits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def four(k: int):
        n = F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(alphabet), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]

    return F.concat(*(x for k in range(8) for x in four(k)))


def read(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The records of the archives under ``path``; only ``columns`` are read."""
    register(spark)
    return spark.read.format("warc").schema(", ".join(f"{c} {COLUMNS[c]}" for c in columns or COLUMNS)).load(path)


def page_of(record_id):
    return F.regexp_extract(record_id, "^<urn:page:(.*)>$", 1).try_cast("long")
