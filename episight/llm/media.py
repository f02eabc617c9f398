"""Media columns: interleaved sequences of text and media.

HTML is parsed into an ordered sequence of text and media elements; a media
element names its payload by digest and keeps the caption that stands with
it.  Payloads live once each in a media store, as 8-bit greyscale PNG images of
64 samples a row, which are lossless.  A join on the digest, not on order,
brings elements and payloads together, so positions and captions stay aligned
however the rows are dealt.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, shared_dir

WIDTH = 64
#: The PNG signature, elements without text, elements that end a text, and media elements.
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
SILENT = {"script", "style", "template", "noscript", "title"}
BLOCKS = {"address", "article", "aside", "blockquote", "br", "div", "dd", "dl", "dt", "figure", "figcaption", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
MEDIA = {"img", "video", "audio", "source", "embed"}


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent: list[str] = []
        self.caption: list[str] | None = None
        self.figure: int | None = None  # where the open figure's items start

    def flush(self) -> None:
        text = "".join(self.words).strip(" \t\n\r\x0b\x0c")
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent.append(tag)
        if self.silent:
            return
        if tag in BLOCKS or tag in MEDIA:
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA:
            a = dict(attrs)
            if a.get("src"):
                self.items.append({"kind": tag, "text": None, "ref": a["src"], "caption": a.get("alt") or None})

    def handle_endtag(self, tag):
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            return
        if tag == "figcaption" and self.caption is not None:
            text = "".join(self.caption).strip(" \t\n\r\x0b\x0c")
            self.caption = None
            for x in self.items[self.figure or 0 :]:
                if x["ref"] is not None and text:
                    x["caption"] = text
        elif tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parse_sequence(html: str) -> list[dict]:
    """The elements of a document in order: kind, text, ref, caption."""
    p = _Sequence()
    p.feed(html)
    p.close()
    p.flush()
    return p.items


ITEM = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"


def interleaved_sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *carry, sequence): each row's elements with positions from 0.

    A null html gives an empty sequence; every row gives a row.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    cols = [F.col(id_col), *[F.col(c) for c in carry], F.coalesce(F.col(html_col), F.lit("")).alias("html")]
    rows = pages.select(*cols)
    item = _parse_datatype_string(ITEM)

    def run(batches: Iterator) -> Iterator:
        kind = to_arrow_type(item)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                seqs = [[{"pos": k, **x} for k, x in enumerate(parse_sequence(h))] for h in b.column(b.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seqs, kind)], names=[*b.schema.names[:-1], "sequence"])

    from pyspark.sql.types import StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("sequence", item)]))


def padded(text: Column) -> Column:
    """A text's UTF-8 bytes, zeros appended up to a positive multiple of 64."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.greatest(F.ceil(F.octet_length(raw) / WIDTH), F.lit(1)).cast("int") * WIDTH
    return F.rpad(raw, size, F.lit(b"\x00"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """8-bit greyscale, 64 samples a row, no filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    plain = np.zeros((len(rows), WIDTH + 1), np.uint8)
    plain[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(plain.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(raw: bytes) -> bytes:
    """The samples of an image that ``encode_png`` wrote."""
    if raw[:8] != PNG_MAGIC:
        raise ValueError("not a PNG image")
    at, data, size = 8, [], (0, 0)
    while at < len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", raw, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    plain = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if plain[:, 0].any():
        raise ValueError("rows with filters")
    return plain[:, 1:].tobytes()


def store_payloads(payloads: DataFrame, path: str) -> None:
    """Write the media store: (digest, media) of ``payloads`` (payload
    binary).  A task writes each of its payloads once; tasks may repeat each
    other's, with equal bytes."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        seen: set[bytes] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                names, media = [], []
                for p in whole.column(0).slice(at, 500).to_pylist():
                    d = hashlib.sha256(p)
                    if d.digest() not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(d.digest())
                        names.append(d.hexdigest())
                        media.append(encode_png(p))
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(media, pa.binary())], names=["digest", "media"])

    payloads.mapInArrow(run, "digest string, media binary").write.option("compression", "none").parquet(path)


def feature(payload: bytes) -> str:
    """Rows, mean, deviation and entropy of the samples, and shares of eight brightness ranges."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = n / len(payload)
    v = np.arange(256)
    mean = float((p * v).sum())
    dev = float(np.sqrt((p * (v - mean) ** 2).sum()))
    h = float(-(p[n > 0] * np.log2(p[n > 0])).sum()) + 0.0
    shares = ",".join(f"{x:.4f}" for x in p.reshape(8, 32).sum(1))
    return f"rows={len(payload) // WIDTH};mean={mean:.4f};dev={dev:.4f};entropy={h:.4f};hist={shares}"


def media_facts(spark: SparkSession, path: str) -> DataFrame:
    """What reading the store back gives, a row for each digest: payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    import pyarrow as pa

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            rows = []
            for digest, media in zip(b.column(0), b.column(1)):
                m = media.as_py()
                p = decode_png(m)
                rows.append((digest.as_py(), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    facts = spark.read.parquet(path).mapInArrow(run, schema)
    return facts.groupBy("digest").agg(*[F.first(c).alias(c) for c in names[1:]])  # repeats are equal


def resolve(sequences: DataFrame, facts: DataFrame, scheme: str = "sha256:") -> DataFrame:
    """One row for each media element of ``sequences`` (with all its other
    columns), with pos, kind, caption and what ``facts`` (digest, ...) says of
    its payload, or nulls if the store doesn't have it."""
    from .common import cut_lineage

    keep = [F.col(f"`{c}`") for c in sequences.columns if c != "sequence"]
    items = sequences.select(*keep, F.explode(F.filter("sequence", lambda x: x["ref"].isNotNull())).alias("x"))
    items = items.select(*keep, "x.pos", "x.kind", "x.caption", F.when(F.col("x.ref").startswith(scheme), F.substring("x.ref", len(scheme) + 1, 128)).alias("digest"))
    items = cut_lineage(items)
    counts = items.groupBy("digest").agg(F.count("*").alias("n"))
    return join_skewed(items, cut_lineage(facts.join(counts, "digest")), "digest")


def carrier(text: Column, digest: Column, caption: Column) -> Column:
    """An HTML page that shows a text, and a figure with the payload named ``digest`` after it."""
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit("<article><p>"), safe, F.lit('</p><figure><img src="sha256:'), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure></article>"))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Store every text's padded bytes as media, read them back, and join them
    to the document's sequence.

    Returns doc_id, n_bytes (UTF-8, without padding), payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and pos
    and caption of the media element; a row for each row of ``docs``.  Null
    texts count as empty (64 zero bytes); null ids have the caption "document
    null"; repeated rows come out each and equal texts get equal values; an empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    payload = padded(F.col(text_col))
    store_payloads(docs.select(payload.alias("payload")), path)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    pages = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), carrier(F.col(text_col), F.sha2(payload, 256), F.concat(F.lit("document "), ident)).alias("html"))
    met = resolve(interleaved_sequences(pages, "doc_id", "html", ("n_bytes",)), media_facts(spark, path))
    return met.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
