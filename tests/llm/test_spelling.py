"""Near words, forms and roots against plain code over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from conftest_llm import rows_of

from episight.llm import spelling


def counts(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(words):
    near = {w: [] for w in words}
    names = sorted(words)
    for x, a in enumerate(names):
        for b in names[x + 1 :]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def answer(docs):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs).collect()), key=repr)


@pytest.mark.parametrize("which", ["edge", "empty"])
def test_edge_tables(request, which):
    docs = request.getfixturevalue(which)
    assert answer(docs) == brute(counts(rows_of(docs)))


def planted(spark):
    rng = random.Random(5)
    stem = ["abcdefg", "hijklmno", "élancée", "aaaaaaa", "andthen", "aaaabbbb", "ÀÿÀÿÀÿÀ"]
    words = set(stem)
    for w in stem:
        for _ in range(60):
            v = w
            for _ in range(rng.randint(1, 3)):
                j, c = rng.randrange(len(v) + 1), rng.choice("abéz")
                v = rng.choice([v[:j] + c + v[j:], v[:j] + v[j + 1 :], v[:j] + c + v[j + 1 :]])
            words.add(v)
    rows = [(i, " ".join([w] * rng.choice([1, 2, 3, 30, 400, 5000]))) for i, w in enumerate(sorted(words))]
    return spark.createDataFrame([*rows, (None, "andthen Andthen"), (3, None), (4, "")], "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("shard, hot", [(40_000, 50_000), (20, 50_000), (50, 7)])
def test_planted_variants_in_any_shards(spark, monkeypatch, shard, hot):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "HOT", hot)
    docs = planted(spark)
    want = brute(counts(rows_of(docs)))
    assert answer(docs) == want and sum(r[4] for r in want) > 300 and any(r[2] not in (r[0], r[1]) for r in want)


def test_given_documents(spark, documents):
    want = brute(counts(rows_of(documents)))
    assert answer(documents) == want and any(r[1] for r in want)


def test_counts_are_flushed(documents):
    got = {r.word: r.n for r in spelling.word_counts(documents, max_words=10).collect()}
    assert {w: n for w, n in got.items() if n >= 2} == counts(rows_of(documents))
