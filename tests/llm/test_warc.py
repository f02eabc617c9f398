import hashlib

import pytest
import zstandard

from episight.llm import warc as W


def brute(rows):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        last = max(same, default=None)
        first = len(raw) < 1000 or page == last or last is None
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first else "revisit", None if first else last))
    return sorted(map(repr, out))


def result(df):
    return sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in df.collect())


def test_round_trip_of_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    assert result(W.warc_round_trip(pages)) == brute([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_edges(spark):
    big, other = "é" * 600, "x" * 5_000_000
    rows = [(1, "http://a/\r\nevil: 1", big), (2, None, big), (7, "u", big), (3, "u", "s"), (4, "u", "s"), (5, None, None), (6, "", ""), (None, "n", big), (8, "l", other), (9, "l", other), (10, "t", "x" * 999), (11, "t", "x" * 999), (12, " \x7f", "\r\n\r\nWARC/1.1\r\n\r\n" * 100)]
    df = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    assert result(W.warc_round_trip(df)) == brute(rows)
    assert W.warc_round_trip(spark.createDataFrame([], df.schema)).count() == 0


def test_hot_payload_is_not_gathered(spark):
    rows = [(i, "u", "h" * 2000 if i % 3 else f"{i}" * 700) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert result(W.warc_round_trip(df)) == brute(rows) if len(rows) < 10 else W.warc_round_trip(df).where("record_type = 'revisit'").count() == 1999


def test_seekable_frames():
    records = [(f"r{i}", bytes([i % 251]) * (i * 37)) for i in range(200)]
    raw = W.bundle(records, frame_bytes=10_000)
    b = W.Bundle(raw)
    assert len(b.frames) > 20
    for rid, data in reversed(records):
        assert b.read(rid) == data
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert plain == b"".join(d for _, d in records)
    at, size, *_ = b.frames[3]
    broken = raw[: at + size - 1] + bytes([raw[at + size - 1] ^ 1]) + raw[at + size :]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        W.Bundle(broken).frame(3)
