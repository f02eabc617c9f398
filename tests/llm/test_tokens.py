"""Encoding, decoding and counting against the library on whole texts."""

import hashlib

import public_tokenizers
import pytest
from conftest_llm import rows_of, same_ids
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from episight.llm import bpe, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["\x1f", "a\x1cb \x1d", "<|endoftext|>", "a<|endoftext|> b", "<|startoftext|><|endoftext|>", "x y　z w", "é ́a", "İSTANBUL ΣΑΣ ſ ﬀ", "don't I'LL we've 12'3", "‍👩‍👩", " \u0085 .  ", "a" * 3000, "ab " * 2000, "\x00\x01 \x7f", "x" * 255 + " " + "y" * 257, "<|endoftext|"]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def summed(path):
    """Counts of texts by units and their pre-tokens, without Spark."""
    split, tok = token_counts.Splitter(path), library(path)

    def count(texts):
        out = []
        for special, units in map(split, texts):
            out.append(special + sum(n * len(tok.model.tokenize(p)) for u, n in units.items() for p, _ in tok.pre_tokenizer.pre_tokenize_str(u)))
        return out

    return count


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("which", ["documents", "edge", "empty"])
def test_encoding_equals_the_library(request, which):
    docs = request.getfixturevalue(which)
    got = bpe.encode_documents(docs, WORDS).collect()
    assert same_ids(got, docs)
    tok, want = library(WORDS), []
    for i, text in rows_of(docs):
        ids = tok.encode(text, add_special_tokens=False).ids
        want.append(repr((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))))
    assert sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in got) == sorted(want)


@pytest.mark.parametrize("mean", [16, 64, 512])
def test_odd_texts_at_any_chunk_size(mean):
    tok, codec = library(WORDS), bpe.Codec(WORDS, mean)
    for n, ids, text in [(*x, t) for x, t in zip([(a, b) for a, b, _, _ in codec.encode([t.encode() for t in ODD])], ODD)]:
        want = tok.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want))), text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=200), max_size=5))
def test_any_texts(texts):
    tok, codec, count = library(WORDS), bpe.Codec(WORDS, 16, spelled=True), summed(BYTES)
    wide = library(BYTES)
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    for (n, ids, out, same), t in zip(codec.encode([t.encode() for t in texts]), texts):
        want = tok.encode(t, add_special_tokens=False).ids
        assert (n, ids, out) == (len(want), " ".join(map(str, want)), tok.decode(want, skip_special_tokens=False))
        assert same or not tok.normalizer.normalize_str(t).isascii()
    assert count(texts) == [len(wide.encode(t, add_special_tokens=False).ids) for t in texts]


def test_shared_passages_are_encoded_once():
    codec = bpe.Codec(WORDS, 64)
    shared = b" ".join(b"word%d" % (i * 7919) for i in range(400))
    codec.encode([shared])
    before = len(codec.chunks)
    codec.encode([b"one two three " + shared + b" four"])
    assert len(codec.chunks) - before < before / 4


@pytest.mark.parametrize("frequent", [1_000_000, 50, 0])
@pytest.mark.parametrize("which", ["documents", "edge", "empty"])
def test_counts_equal_the_library(request, which, frequent):
    docs = request.getfixturevalue(which)
    got = token_counts.token_counts(docs, BYTES, frequent=frequent).collect()
    assert same_ids(got, docs)
    tok = library(BYTES)
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    want = [repr((i, len(t.encode()), n(t), n(t) > 512)) for i, t in rows_of(docs)]
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)) for r in got) == sorted(want)


def test_each_unit_is_in_the_table_once(spark):
    docs = spark.createDataFrame([("don't do 12a don't do",), (" do <|endoftext|>don't  do",)], "text string").coalesce(1)
    units = token_counts.frequent_units(docs, BYTES)
    assert {r.unit: r.n for r in units.collect()} == {"don't": 2, " do": 3}
    assert [r.unit for r in token_counts.frequent_units(docs, BYTES, frequent=1).collect()] == [" do"]
    tok = library(BYTES)
    rows = {r.unit: r.tokens for r in token_counts.unit_table(spark.createDataFrame([("don't",), (" 12a",), ("  do",)], "unit string"), BYTES).collect()}
    assert rows == {u: len(tok.encode(u).ids) for u in ("don't", " 12a", "  do")}
    parts = token_counts.pre_tokens(docs.where("text like 'don%'").select(docs.text.alias("unit")), BYTES).collect()
    assert {(r.piece, r.k) for r in parts} >= {("'t", 2), ("don", 1), ("a", 1)}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_a_pre_token_alone_is_itself(text):
    pre = library(BYTES).pre_tokenizer.pre_tokenize_str
    for u in token_counts.UNIT.findall(text.encode("utf-8", "replace").decode()):
        for p, (s, e) in pre(u):
            assert [x for x, _ in pre(u[s:e])] == [p]


def test_counts_of_odd_texts():
    tok, count = library(BYTES), summed(BYTES)
    assert count(ODD) == [len(tok.encode(t, add_special_tokens=False).ids) for t in ODD]


def test_joins_agree_with_the_library_and_wrong_ones_are_encoded_whole():
    codec, tok = bpe.Codec(WORDS, 16), library(WORDS)
    text = " ".join(f"word{i} and\tmore" for i in range(300))
    codec.encode([text.encode()])
    assert codec.agreed and not codec.rejoined
    # were a word's own encoding wrong, no window would agree, and the whole text's encoding would stand
    odd = bpe.Codec(WORDS, 16)
    learn = odd._learn

    def wrong(new):
        learn(new)
        for w in new:
            odd.words[w] = (1, "7", "x", True)

    odd._learn = wrong
    got = odd.encode([text.encode()])[0]
    want = tok.encode(text, add_special_tokens=False).ids
    assert got[3] and odd.rejoined == 1 and odd.repaired > 0 and got[1] == " ".join(map(str, want))


def test_new_words_are_encoded_many_at_a_time():
    codec, tok, given_ = bpe.Codec(WORDS), library(WORDS), []

    class Watched:
        def __getattr__(self, name):
            return getattr(tok, name)

        def encode_batch_fast(self, texts, **how):
            given_.extend(texts)
            return tok.encode_batch_fast(texts, **how)

    codec.tok = Watched()
    plain = [f"Word{i},and-{i}." for i in range(640)]
    codec._learn({w.encode() for w in plain})
    assert len(given_) == 10  # one for each word before
    # words that don't spell as they stand, or that have white space of their own, are encoded alone
    odd = [w for t in ODD for w in t.split(" ") if w] + ["e\u0301", "\u1e9b\u0323", "\u0130", "\u03a3\u03a3", "</w>", "\xff", "\u212b", "a\x00b", "x\u3000y", "\u3000"]
    codec._learn({w.encode() for w in odd})
    for w in plain + odd:
        ids = tok.encode(w, add_special_tokens=False).ids
        assert codec.words[w.encode()] == (len(ids), " ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False), True), w
    broken = b"caf\xe9 \xf0\x9f".split()
    codec._learn(set(broken))
    assert [codec.words[w][1].split() for w in broken] == [list(map(str, tok.encode(w.decode("utf-8", "replace")).ids)) for w in broken]


def test_words_in_use_are_not_forgotten():
    codec = bpe.Codec(WORDS, max_words=100)
    codec.encode([b"the and of"])
    codec.encode([b" ".join(b"w%d" % i for i in range(200))])
    learned, learn = set(), codec._learn
    codec._learn = lambda new: (learned.update(new), learn(new))
    codec.encode([b"the and of one"])
    assert learned == {b"one"} and len(codec.words) <= 100


def test_vocabularies_that_reach_across_white_space_are_refused(tmp_path):
    import json

    plain = json.load(open(WORDS))
    for change in ("added", "pieces"):
        spec = json.loads(json.dumps(plain))
        if change == "added":
            spec["added_tokens"][0]["lstrip"] = True
        else:
            spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        path = tmp_path / f"{change}.json"
        path.write_text(json.dumps(spec))
        with pytest.raises(ValueError):
            bpe.Codec(str(path))
    with pytest.raises(ValueError):
        bpe.Codec(BYTES)


def test_ids_beside_all_columns_and_decoding(spark, edge, empty):
    tok = library(WORDS)
    docs = edge.withColumn("ids", edge.doc_id).withColumn("N_tokens", edge.doc_id)
    got = bpe.encode_beside(docs, WORDS)
    assert set(edge.columns) | {"n_tokens", "ids", "ids_sha256", "decoded_sha256", "round_trips"} == set(got.columns)
    rows = bpe.decode_ids(got, WORDS).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), tok.decode(ids, skip_special_tokens=False))
        assert r.round_trips and sha(r.decoded) == r.decoded_sha256
    assert bpe.encode_beside(empty, WORDS).count() == 0
    few = spark.createDataFrame([(None,), ([],), ([49407, -1, 10**6],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode_ids(few, WORDS).collect()] == [None, "", "<|endoftext|>"]
