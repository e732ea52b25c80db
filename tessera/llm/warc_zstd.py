"""WARC archives as Zstandard frames with a shared dictionary, written and read by Spark.

An archive begins with a skippable frame that holds the dictionary; then follows one frame
per record, each decodable alone. Archives are written by Spark's text writer, one record a
"line", so they go to any file system Spark knows, and a task that is lost or retried leaves
no half archive. Its line separator is an empty skippable frame (eight ASCII bytes), which
Zstandard readers pass over, so the files are plain .warc.zst streams.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import materialize

SKIP_FIRST, SKIP_LAST = 0x184D2A50, 0x184D2A5F
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
#: An empty skippable frame: magic 0x184D2A50, length 0.
SEPARATOR = struct.pack("<II", SKIP_FIRST, 0).decode("ascii")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3
#: The dictionary is trained on at most so many pages of at most so many bytes each.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16_384, 65_536
#: Payloads shorter than this are never written as revisits.
LEAST_REVISIT = 100


class WarcError(ValueError):
    """A frame, header or length of an archive is not what it should be."""


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary; too few samples give raw content, none gives an empty one."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b"".join(samples)[:size]
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def clean(value: str) -> str:
    """A header value on one line: control characters and % are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "%\x7f" else c for c in value)


def restore(value: str) -> str:
    out, rest = [], value
    while "%" in rest:
        head, _, rest = rest.partition("%")
        out += [head, chr(int(rest[:2], 16))]
        rest = rest[2:]
    return "".join([*out, rest])


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[str, dict[str, str], bytes]:
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep:
        raise WarcError("header without an end")
    first, *lines = head.decode().split("\r\n")
    fields = {}
    for line in lines:
        name, sep, value = line.partition(":")
        if not sep or not name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        fields[name.strip().lower()] = value.strip(" \t")
    return first, fields, rest


def parse_record(data: bytes) -> dict:
    """The fields of one record; raises WarcError where a header or length does not hold."""
    version, head, rest = _headers(data)
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"bad version {version[:40]!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in head:
            raise WarcError(f"no {name}")
    if not head["content-length"].isdigit() or int(head["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"content-length {head['content-length']!r} but {len(rest) - 4} bytes")
    status, http, payload = _headers(rest[:-4])
    if not status.startswith("HTTP/") or not http.get("content-length", "").isdigit():
        raise WarcError("no HTTP head")
    kind, n, digest = head["warc-type"], int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        if n != len(payload) or hashlib.sha256(payload).hexdigest() != digest:
            raise WarcError("payload differs from its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in head:
        raise WarcError(f"bad {kind} record")

    def page(name: str) -> int | None:
        value = head[name].removeprefix("<urn:page:").removesuffix(">") if name in head else ""
        return int(value) if value else None
    return {"page_id": page("warc-record-id"), "url": restore(head["warc-target-uri"]) if "warc-target-uri" in head else None, "payload_bytes": n, "payload_digest": digest,
            "record_type": kind, "refers_to": page("warc-refers-to"), "payload": payload if kind == "response" else None}


def read_archive(data: bytes):
    """The parsed records of an archive, in order; one frame is in memory at a time."""
    view, at, n = memoryview(data), 0, len(data)
    if n < 8 or struct.unpack_from("<I", view)[0] != DICTIONARY_FRAME:
        raise WarcError("no leading dictionary frame")
    decoder = None
    while at < n:
        if n - at < 8:
            raise WarcError(f"truncated frame at byte {at}")
        magic, size = struct.unpack_from("<II", view, at)
        if SKIP_FIRST <= magic <= SKIP_LAST:
            if at + 8 + size > n:
                raise WarcError("truncated skippable frame")
            if not at:
                body = bytes(view[8:8 + size])
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)) if body else zstandard.ZstdDecompressor()
            at += 8 + size
        elif magic == ZSTD_FRAME:
            one = decoder.decompressobj()
            out = []
            while not one.eof and at < n:
                out.append(one.decompress(view[at:at + (1 << 16)]))
                at += min(1 << 16, n - at)
            if not one.eof:
                raise WarcError("truncated record frame")
            at -= len(one.unused_data)
            yield parse_record(b"".join(out))
        else:
            raise WarcError(f"no frame at byte {at}")


def dictionary_of(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample, the first ``SAMPLE_PAGES`` pages that a scan meets.

    It only affects how well the archives compress, so no second scan is spent on it.
    """
    sample = pages.filter("html is not null").select(F.substring("html", 1, SAMPLE_BYTES)).limit(SAMPLE_PAGES)
    return train_dictionary([r[0].encode() for r in sample.collect()])


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, dictionary: bytes | None = None) -> None:
    """Writes ``pages`` (page_id, url, html) as archives into a new ``folder``.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest page_id
    becomes the response and the others revisits of it; a row without page_id is always a
    response and rows that repeat the smallest page_id are all responses. Null html is an
    empty payload; an empty table gives a folder without records.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    shared = dictionary_of(pages) if dictionary is None else dictionary
    digest = F.sha2("html", 256)
    long = pages.filter((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", F.unhex(digest).alias("digest"))
    long = materialize(long, "warc-digests")
    first = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to < last").drop("last")
    again = long.join(materialize(first, "warc-firsts"), "digest").filter("page_id > refers_to").dropDuplicates(["page_id", "digest"])
    rows = pages.withColumn("digest", digest).join(materialize(again.select("page_id", F.lower(F.hex("digest")).alias("digest"), "refers_to"), "warc-revisits"), ["page_id", "digest"], "left")

    def run(batches):
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared)) if shared else zstandard.ZstdCompressor(level=LEVEL)
        begun = False
        for batch in batches:
            if not begun and batch.num_rows:
                begun = True
                yield pa.RecordBatch.from_arrays([pa.array([struct.pack("<II", DICTIONARY_FRAME, len(shared)) + shared], pa.binary())], names=["value"])
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512).to_pylist()
                out = [coder.compress(make_record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"])) for r in part]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
    records = rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).text(folder)


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of all archives in ``folder``: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to (and payload, null for revisits).

    Fails with WarcError where a frame, header, length or digest does not hold.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + [("payload", pa.binary())] * payloads)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in read_archive(content.as_buffer()) if content.as_buffer().size else ():
                    rows.append({k: r[k] for k in schema.names})
                    if len(rows) >= 512:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").mapInArrow(run, kind)
