"""Operator 8: WARC derivatives. Responses become linked metadata and plain-text conversion records.

Each response gives two records that refer to it: a conversion (its visible text, a line for each block) and a metadata
record (title, character set, link count and the source's HTTP headers as warc-fields). Record ids are made from the
response's id and the kind of record, so a run that is repeated gives the same ones. Digests are SHA-1 in base 32; the
source's payload digest is kept, or made where it is missing.

``read_warc`` reads WARC files (plain or gzip, one member a record) through Spark's binary reader, each file in one
task, record by record. ``warc_record`` gives the bytes of a record as a gzip member; members of any order make a
valid file when they are put one after another.

A null url gives a record without target; null html an empty payload. Repeated rows and null ids give two records each;
repeated ids give equal record ids. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creasework.llm.common import extended, table
from creasework.llm.html import Parser, flowed

#: Capture date of pages that carry none.
DATE = "2024-01-01T00:00:00Z"
# none of them looks beyond the next "<", so that a page of open tags takes no longer than another
_TITLE = re.compile(r"<title[^<>]*>([^<]*(?:<(?!/title)[^<]*)*)</title", re.I)
_LINK = re.compile(r"""<a\s[^<>]*?href\s*=\s*["']?[^"'\s<>]""", re.I)
_TITLE_END = re.compile("</title", re.I)
_CHARSET = re.compile(r"""charset\s*=\s*["']?([\w-]+)""", re.I)
_HEADERS = ["record_id", "target_uri", "date", "http_headers", "payload_digest"]


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def warc_record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A gzip member with the record; headers that are None stay out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def visible_text(html: str) -> str:
    """A line for each block of text outside the head; a body in a head that is not closed is a body."""
    page = Parser(html)
    in_head: list[bool] = []
    for e in page.elements:  # parents come before their children
        in_head.append(e.tag == "head" or e.tag != "body" and e.parent is not None and in_head[e.parent.first])
    return "\n".join(flowed([n for n in page.nodes if n.element.tag not in ("title", "noscript") and not in_head[n.element.first]]))


def responses(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as responses: record_id, target_uri, date, http_headers, payload, payload_digest."""
    seed = F.sha2(F.concat_ws(" ", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))), 256)
    hexed = F.concat_ws("-", *(F.substring(seed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    payload = F.coalesce("html", F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return pages.select("page_id", F.concat(F.lit("<urn:uuid:"), hexed, F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(DATE).alias("date"), http.alias("http_headers"), payload.alias("payload"), F.lit(None).cast("string").alias("payload_digest"))


def derivatives(source: DataFrame, keep: list[str]) -> DataFrame:
    """Two rows for each response: its conversion and its metadata record, with all headers, content and record bytes."""
    names = ["warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", "content_length", "source_headers", "content", "record"]
    kinds = [pa.string()] * 8 + [pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.slice(at, 200)
                out: list[list] = [[] for _ in names]
                for ref, uri, date, http, payload_digest, payload in zip(*(part.column(c).to_pylist() for c in [*_HEADERS, "payload"]), strict=True):
                    payload = payload or ""
                    own = payload_digest or digest(payload.encode("utf-8", "surrogatepass"))
                    title, charset = _TITLE.search(payload) if _TITLE_END.search(payload) else None, _CHARSET.search((http or "") + payload[:1024])
                    fields = [f"title: {' '.join(title[1].split())}" if title else None, f"charset-detected: {charset[1].lower()}" if charset else None, f"outlinks: {len(_LINK.findall(payload))}"]
                    fields += [f"http-{h}" for h in (http or "").split("\r\n")[1:]]
                    made = (("conversion", "text/plain", visible_text(payload)), ("metadata", "application/warc-fields", "\r\n".join(f for f in fields if f)))
                    for kind, content_type, content in made:
                        block = content.encode("utf-8", "surrogatepass")
                        name = record_id(kind, ref)
                        block_digest = digest(block)
                        headers = [("WARC-Record-ID", name), ("WARC-Refers-To", ref), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", own if kind == "metadata" else None), ("WARC-Block-Digest", block_digest), ("Content-Type", content_type)]
                        row = (kind, name, ref, uri, date, content_type, own, block_digest, len(block), http, content, warc_record(kind, headers, block))
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
                twice = pa.array([i // 2 for i in range(2 * len(part))])
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(twice) for c in keep), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[*keep, *names])

    strings = ", ".join(f"{n} string" for n in names[:8])
    schema = extended(source, keep, f"{strings}, content_length long, source_headers string, content string, record binary")
    return source.select(*keep, *_HEADERS, "payload").mapInArrow(run, schema)


def _members(data: bytes) -> Iterator[bytes]:
    """The records of a file, one at a time, without unpacking all of it."""
    if data[:2] != b"\x1f\x8b":
        yield from _records(data)
        return
    while data:
        unpack = zlib.decompressobj(31)
        out = unpack.decompress(data)
        yield from _records(out + unpack.flush())
        data = unpack.unused_data.lstrip(b"\0")


def _records(data: bytes) -> Iterator[bytes]:
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        head = data.find(b"\r\n\r\n", start)
        size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", data[start:head] if head > 0 else b"")
        if head < 0 or not size:
            return
        at = head + 4 + int(size[1])
        yield data[start:at]


def parse_record(data: bytes) -> dict:
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    http, payload = "", block
    if fields.get("content-type", "").startswith("application/http"):
        http_bytes, _, payload = block.partition(b"\r\n\r\n")
        http = http_bytes.decode("utf-8", "replace")
    return {"warc_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "http_headers": http, "payload": payload.decode("utf-8", "replace"), "payload_digest": fields.get("warc-payload-digest"), "block_digest": fields.get("warc-block-digest")}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files; files that Spark's binary reader can hold (2 GB)."""
    names = ["warc_type", "record_id", "refers_to", "target_uri", "date", "http_headers", "payload", "payload_digest", "block_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                held = []
                for record in _members(data.as_py() or b""):
                    held.append(parse_record(record))
                    if len(held) == 200:
                        yield pa.RecordBatch.from_pylist(held, pa.schema([(n, pa.string()) for n in names]))
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, pa.schema([(n, pa.string()) for n in names]))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"{n} string" for n in names))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")), ["page_id"])
