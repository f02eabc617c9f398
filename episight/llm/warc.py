"""Seekable Zstandard bundles of WARC records.

Records are grouped into independent Zstandard frames.  A bundle is its
frames, a skippable frame with the record index (record id, frame, offset and
length inside the frame's data), and a seek table in the seekable format's
layout, last, so that a reader finds it from the end.  One record is read by
decompressing one frame; a plain decoder still reads the whole.

Bundles travel as rows (bundle, content), one for each, so that Spark's own
writers and readers carry them to and from any store; ``content`` is the file,
byte for byte.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, shared_dir

#: Fixed values of the Zstandard and seekable formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def clean(value: str) -> str:
    """A header value: control characters would end the header."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(rid: str, kind: str, uri: str | None, digest: str, payload: bytes, size: int, refers_to: str | None = None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response, or a revisit without the payload but with its length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {clean(uri)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload)"""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def bundle(records: Iterable[tuple[str, bytes]], frame_bytes: int = 256 << 10, level: int = 3) -> bytes:
    """Records as (id, bytes) to one seekable file."""
    import zstandard
    from xxhash import xxh64_intdigest

    packer = zstandard.ZstdCompressor(level=level)
    out, seek, index = [], [], []
    data, held = [], 0

    def end_frame() -> None:
        nonlocal data, held
        if data:
            whole = b"".join(data)
            out.append(packer.compress(whole))
            seek.append((len(out[-1]), len(whole), xxh64_intdigest(whole) & 0xFFFFFFFF))
            data, held = [], 0

    for rid, raw in records:
        if held and held + len(raw) > frame_bytes:
            end_frame()
        key = rid.encode()
        index.append(struct.pack("<IIIH", len(out), held, len(raw), len(key)) + key)
        data.append(raw)
        held += len(raw)
    end_frame()
    table = packer.compress(struct.pack("<I", len(index)) + b"".join(index))
    out.append(struct.pack("<II", SKIPPABLE_INDEX, len(table)) + table)
    seek.append((len(out[-1]), 0, 0))
    body = b"".join(struct.pack("<III", *x) for x in seek) + struct.pack("<IBI", len(seek), CHECKSUM_FLAG, SEEKABLE_MAGIC)
    return b"".join(out) + struct.pack("<II", SKIPPABLE_SEEK, len(body)) + body


class Bundle:
    """Random access to a bundle through its seek table and record index."""

    def __init__(self, content: bytes):
        import zstandard

        self.content, self.unpack = content, zstandard.ZstdDecompressor().decompress
        n, flags, magic = struct.unpack("<IBI", content[-9:])
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        width = 12 if flags & CHECKSUM_FLAG else 8
        start = len(content) - 9 - n * width
        self.frames, at = [], 0
        for k in range(n):
            size, plain, check = struct.unpack_from("<III", content, start + k * width)
            self.frames.append((at, size, plain, check))
            at += size
        first, size = self.frames[-1][:2]
        table = self.unpack(content[first + 8 : first + size])
        self.index: dict[str, tuple[int, int, int]] = {}
        at = 4
        for _ in range(struct.unpack_from("<I", table)[0]):
            frame, offset, length, key = struct.unpack_from("<IIIH", table, at)
            at += 14
            self.index[table[at : at + key].decode()] = (frame, offset, length)
            at += key
        self._held: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        from xxhash import xxh64_intdigest

        if self._held[0] != k:
            at, size, plain, check = self.frames[k]
            data = self.unpack(self.content[at : at + size])
            if len(data) != plain or xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self._held = (k, data)
        return self._held[1]

    def read(self, rid: str) -> bytes:
        k, offset, length = self.index[rid]
        return self.frame(k)[offset : offset + length]


def record_id(page_id: int | None, nth: str) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}:{nth}"


def plan_records(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, payload, digest, size, response_id): response_id is the
    page whose response holds the payload, null where a page holds its own.

    Digests are counted before they are shuffled, and only those that occur
    twice or more are joined back.
    """
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    large = rows.where(F.col("size") >= min_bytes)
    same = large.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1")
    from .common import cut_lineage

    met = join_skewed(rows, cut_lineage(same), "digest")
    own = (F.col("size") < min_bytes) | (F.col("page_id") == F.col("response_id"))
    return met.withColumn("response_id", F.when(~F.coalesce(own, F.lit(False)), F.col("response_id")))


def write_bundles(records: DataFrame, path: str, bundle_bytes: int = 4 << 20, frame_bytes: int = 256 << 10) -> None:
    """Write the rows of ``plan_records`` as bundles of about ``bundle_bytes``
    of plain records below ``path``; each task makes its own bundles."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{k:06d}"]), pa.array([len(held)], pa.int64()), pa.array([bundle(held, frame_bytes)], pa.binary())], names=["bundle", "n_records", "content"])

        nth, names = 0, set()
        for b in batches:
            for at in range(0, b.num_rows, 100):
                for row in b.slice(at, 100).to_pylist():
                    target = row["response_id"]
                    # the name that revisits refer to; a repeated row's second record gets another
                    rid = record_id(row["page_id"], "response" if target is None else f"{part}.{nth}")
                    if rid in names or row["page_id"] is None:
                        rid = record_id(row["page_id"], f"{part}.{nth}")
                    names.add(rid)
                    nth += 1
                    refers = None if target is None else record_id(target, "response")
                    raw = record(rid, "response" if target is None else "revisit", row["url"], row["digest"], bytes(row["payload"]), row["size"], refers)
                    held.append((rid, raw))
                    size += len(raw)
                    if size >= bundle_bytes:
                        yield done()
                        k, held, size, names = k + 1, [], 0, set()
        if held:
            yield done()

    cols = records.select("page_id", "url", "payload", "digest", "size", "response_id")
    cols.mapInArrow(run, "bundle string, n_records long, content binary").write.option("compression", "none").parquet(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """The records of all bundles below ``path``, each fetched by its id
    through the index and checked against its digest.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to, bundle.
    """
    import pyarrow as pa

    def page(rid: str) -> int | None:
        n = rid.split(":")[2]
        return None if n == "null" else int(n)

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                file = Bundle(content.as_py())
                rows = []
                for rid in file.index:
                    warc, http, payload = parse_record(file.read(rid))
                    digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    n = int(http["Content-Length"])
                    if warc["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"record {rid} doesn't hold its payload")
                    refers = page(warc["WARC-Refers-To"].strip("<>")) if "WARC-Refers-To" in warc else None
                    rows.append((page(rid), warc.get("WARC-Target-URI"), n, digest, warc["WARC-Type"], refers, name.as_py()))
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle"])

    return spark.read.parquet(path).select("bundle", "content").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string")


def warc_round_trip(pages: DataFrame, min_bytes: int = 1000, path: str | None = None) -> DataFrame:
    """Write a record for every page, then read the archives back.

    Of pages with equal payloads of at least ``min_bytes``, that with the
    largest page_id is the response and the others revisit it.  Null html is an
    empty payload.  Rows that share the largest id and the payload are all
    responses; a null id never is the largest, and if no equal page has an id
    all are responses.  A null url has no header; an empty table gives no bundles
    and no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_bundles(plan_records(pages, min_bytes), path)
    return read_bundles(spark, path)
