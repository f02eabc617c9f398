import hashlib
import struct
import zlib

import numpy as np
import pytest
from conftest_llm import rows_of, same_ids

from episight.llm import media as M


def padded(text):
    raw = text.encode()
    return raw + b"\0" * (-len(raw) % 64 if raw else 64)


@pytest.mark.parametrize("which", ["documents", "edge", "empty"])
def test_round_trip_equals_brute_force(request, which):
    docs = request.getfixturevalue(which)
    got = M.media_columns(docs).collect()
    assert same_ids(got, docs)
    want = []
    for i, t in rows_of(docs):
        p = padded(t)
        want.append(repr((i, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), M.feature(p))))
    assert sorted(repr((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature)) for r in got) == sorted(want)
    by = {}
    stored = {hashlib.sha256(M.encode_png(padded(t))).hexdigest() for _, t in rows_of(docs)}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
        assert r.media_sha256 in stored
        assert r.caption == f"document {'null' if r.doc_id is None else r.doc_id}"
    assert all(len(x) == 1 for x in by.values())


def test_png_is_lossless_and_damage_is_seen():
    raw = np.random.default_rng(0).integers(0, 256, 64 * 30, dtype=np.uint8).tobytes()
    png = M.encode_png(raw)
    assert M.decode_png(png) == raw
    assert struct.unpack(">II", png[16:24]) == (64, 30)
    bad = bytearray(png)
    bad[60] ^= 1
    with pytest.raises(ValueError):
        M.decode_png(bytes(bad))


def test_sequences_keep_order_and_captions():
    html = "<title>no</title><p>one &amp; two<br>three<script>x</script><figure><img src=a alt=alt><figcaption>cap <b>c</b></figcaption></figure><img src='b' alt='B'>tail<img>"
    got = [(x["kind"], x["text"], x["ref"], x["caption"]) for x in M.parse_sequence(html)]
    assert got == [("text", "one & two", None, None), ("text", "three", None, None), ("img", None, "a", "cap c"), ("img", None, "b", "B"), ("text", "tail", None, None)]
    assert M.parse_sequence("") == [] and M.parse_sequence("<p") == M.parse_sequence("<p")


def test_elements_without_payload_stay(spark):
    pages = spark.createDataFrame([(1, '<img src="sha256:aa"><p>t</p><img src="http://x/y.png">'), (2, None)], "page_id long, html string")
    seqs = M.interleaved_sequences(pages)
    assert {r.page_id: len(r.sequence) for r in seqs.collect()} == {1: 3, 2: 0}
    facts = spark.createDataFrame([("aa", 64)], "digest string, payload_bytes long")
    got = {(r.pos, r.payload_bytes) for r in M.resolve(seqs, facts).collect()}
    assert got == {(0, 64), (2, None)}


def test_many_elements_without_a_digest_are_not_gathered(spark):
    pages = spark.createDataFrame([(i, f'<img src="http://x/{i}.png">' if i % 3 else '<img src="sha256:aa">') for i in range(3000)], "page_id long, html string")
    facts = spark.createDataFrame([("aa", 64)], "digest string, payload_bytes long")
    out = M.resolve(M.interleaved_sequences(pages), facts)
    got = out.groupBy("payload_bytes").count().collect()
    assert {(r.payload_bytes, r["count"]) for r in got} == {(64, 1000), (None, 2000)}
