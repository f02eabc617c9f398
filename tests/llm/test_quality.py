import random
import re

import public_tokenizers
import pytest
from conftest_llm import rows_of, same_ids

from episight.llm import quality as Q

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = set()
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    for at in seen.values():
        if len(at) > 1:
            inside.update(j for i in at for j in range(i, i + 5))
    lines, before, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in before
            before.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


@pytest.mark.parametrize("which", ["documents", "edge", "empty"])
def test_counts_equal_brute_force(request, which):
    docs = request.getfixturevalue(which)
    got = Q.quality_rules(docs, VOCABULARY).collect()
    assert same_ids(got, docs)
    want = []
    for i, t in rows_of(docs):
        n = brute(t)
        want.append(repr((i, *n, n[0] < 10 or 100 * n[4] > 20 * n[0])))
    assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == sorted(want)
    assert not any(r.kept and r.base_failed for r in got)


def test_tokens_equal_the_library_word_by_word(documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    for r in Q.quality_figures(documents.limit(40), VOCABULARY).collect():
        text = dict(rows_of(documents))[r.doc_id]
        ids = [x for w in WORD.findall(text) for x in sp.encode(w)]
        assert r.n_tokens == len(ids) and r.n_fallback == sum(sp.is_byte(x) for x in ids)


@pytest.mark.parametrize("ids", [[], [0], [0, 1, 2, 3, 4, 0, 1, 2, 3, 4], [0] * 9, [5, 0, 1, 2, 3, 4, 9, 0, 1, 2, 3, 4]])
def test_repeated_windows(ids):
    import numpy as np

    own = np.unique(np.array(ids, int), return_inverse=True)[1] if ids else np.array([], int)
    assert Q.repeated_window_words(own) == brute(" ".join(map(str, ids)))[4]


def test_bands_reject_junk_and_keep_prose(spark):
    prose = "The committee met on a cold morning to discuss how the new bridge should be paid for, and nobody could agree on the price of steel or the wages of the builders."
    junk = {"symbols": "# * $ % & | < > ## ** $$ %% && || << >>", "same": "spam " * 60, "random": " ".join(f"{chr(0x1F600 + i)}{chr(0x1F300 + i)}" * 4 for i in range(40))}
    rows = [(0, prose), *[(k + 1, v) for k, v in enumerate(junk.values())]]
    kept = {r.doc_id: r.kept for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False}


def test_stage_keeps_whole_rows(documents, edge):
    for docs in (documents, edge):
        kept = Q.keep_good(docs, VOCABULARY)
        assert kept.columns == docs.columns
        good = sorted(repr(r.doc_id) for r in Q.quality_rules(docs, VOCABULARY).collect() if r.kept)
        assert sorted(repr(r.doc_id) for r in kept.collect()) == good


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es"])
def test_length_alone_refuses_no_clean_text(spark, lang):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = [r.text for r in docs.join(Q.quality_rules(docs, VOCABULARY).where("kept").select("doc_id"), "doc_id").where(f"lang = '{lang}'").orderBy("doc_id").collect()]
    words = [w for t in clean for w in WORD.findall(t)]
    rng = random.Random(1)
    long = " ".join(rng.choice(words) for _ in range(1_000_000))
    few = " ".join(rng.choice(words[:8]) for _ in range(100_000))
    rows = spark.createDataFrame([(1, long, lang), (2, few, lang)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in Q.quality_rules(rows, VOCABULARY).collect()}
    assert got[1].n_tokens >= 1_000_000 and got[1].kept and got[1].reasons == []
    assert got[2].reasons == ["token_entropy"]


@pytest.mark.parametrize("which", ["documents", "edge"])
def test_verdicts_equal_a_slow_version(request, which):
    import math
    from collections import Counter

    import sentencepiece

    docs = request.getfixturevalue(which)
    sp = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]
    want = []
    for i, text, lang in rows:
        n = brute(text)
        ids = [x for w in WORD.findall(text) for x in sp.encode(w)]
        entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids).values()) if ids else 0.0
        name = Q.script(len(text), len(text.encode()), text)
        name = lang if name == "latin" and lang in Q.BANDS else name
        b, chars, fallback = Q.BANDS[name], n[1] / max(1, len(ids)), sum(sp.is_byte(x) for x in ids) / max(1, len(ids))
        good = b.min_chars <= chars <= b.max_chars and fallback <= b.max_fallback and n[2] <= b.max_symbols * n[1]
        good = good and entropy >= b.min_entropy_share * min(math.log2(max(1, len(ids))), b.full_entropy) - 1e-9
        want.append((i, name, round(entropy, 6) + 0.0, good and not (n[0] < 10 or 100 * n[4] > 20 * n[0])))
    got = [(r.doc_id, r.band, round(r.token_entropy, 6) + 0.0, r.kept) for r in Q.quality_rules(docs, VOCABULARY).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
