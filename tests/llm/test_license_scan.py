import re

import pytest
from conftest_llm import rows_of, same_ids  # noqa: F401

from episight.llm import license_scan as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall(text.translate(LOWER))
    places = sorted((i, label) for p, label in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize("which", ["documents", "edge", "empty"])
def test_base_equals_brute_force(request, which):
    docs = request.getfixturevalue(which)
    got = L.license_scan(docs).collect()
    assert same_ids(got, docs)
    want = sorted(map(repr, ((i, *brute(t)) for i, t in rows_of(docs))))
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == want
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_overlapping_and_repeated_phrases():
    s = L.Scanner()
    got = s.scan(b"MIT License, mit license; the GNU General Public License. CC BY-NC 4.0 cc by")
    assert (got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (5, 0, 14, "cc-by,gpl,mit")


def test_matching_statistics_equal_the_longest_template_runs():
    seqs = [[1, 2, 3, 1, 2, 4], [2, 3, 5], [1, 2, 4, 4]]
    auto = L.Automaton(seqs)
    runs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [1, 2, 3, 5, 1, 2, 4, 4, 2, 3, 1, 2, 9, 4, 4]
    for i, (_, n) in enumerate(auto.stream(text)):
        assert n == max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in runs), default=0)


def test_templates_are_covered_with_gaps_and_plain_prose_is_not():
    s = L.Scanner()
    text = L.TEMPLATES[0][1].replace("free of charge, ", "").replace("publish, distribute, ", "publish ")
    got = s.scan(f"/* Copyright 2020 someone */ {text} more words".encode())
    assert got["labels"] == "mit" and got["score"] > 0.8
    span = next(x for x in got["spans"] if x["template"] == 0)
    assert span["first_word"] == 3 and span["end_word"] <= got["n_words"] - 2
    assert s.scan(b"permission to park here is granted to any person with a licence")["labels"] == ""


def test_a_whole_short_template_counts_inside_a_longer_partial_match():
    text = 'Licensed under the Apache License, Version 2.0 (the "License") and something else altogether'
    got = L.Scanner().scan(text.encode())
    assert got["labels"] == "apache" and got["score"] == 1.0
    own = L.Scanner(templates=[("long", "a b c d e f g h i j k l"), ("short", "c d e f g"), ("tail", "g h i j")])
    assert own.scan(b"a b c d e f g h x")["labels"] == "long,short"
    assert own.scan(b"x b c d e f g h i j x")["labels"] == "long,short,tail"


def test_phrases_of_one_word(spark):
    got = L.Scanner(phrases={"unlicense": "public"}).scan(b"The UNLICENSE and the unlicense")
    assert (got["n_base"], got["first_word"], got["last_word"], got["labels"]) == (2, 1, 4, "public")


@pytest.mark.parametrize("which", ["documents", "edge"])
def test_labels_and_scores_equal_chained_brute_force_matches(request, which):
    """Each template's own longest matches, found word by word, chained as the operator chains them."""
    docs = request.getfixturevalue(which)
    s = L.Scanner()
    templates = [L.words_of(t.encode()) for _, t in L.TEMPLATES]
    got = {(r.doc_id, r.n_words): (r.labels, r.score) for r in L.license_scan(docs).collect()}
    for i, text in rows_of(docs):
        words = L.words_of(text.encode())
        if len(words) > 3000:
            continue
        by = {}
        for k, t in enumerate(templates):
            where = {}
            for j, w in enumerate(t):
                where.setdefault(w, []).append(j)
            runs, matches = {}, []  # template place: length of the run that ends there
            for end, w in enumerate([*words, None]):
                now = {j: runs.get(j - 1, 0) + 1 for j in where.get(w, [])}
                best, best_now = max(runs.values(), default=0), max(now.values(), default=0)
                if best >= s.min_match and best_now != best + 1:
                    matches += [(end - best, j + 1 - best, best) for j, n in runs.items() if n == best]
                runs = now
            by[k] = matches
        spans = chain(s, by)
        labels = {x for _, x in spans} | set(filter(None, brute(text)[4].split(",")))
        assert got[i, len(words)] == (",".join(sorted(labels)), pytest.approx(max([c for c, _ in spans], default=0.0))), i


def chain(s, by):
    out = []
    for k, found in by.items():
        open_ = []
        for start, at, n in sorted(found):
            best = None
            for c in open_:
                shared = max(0, c[1] - start, c[2] - at)
                if shared < n and start - c[1] <= s.max_gap and at - c[2] <= s.max_gap and start + n > c[1] and at + n > c[2] and (best is None or c[3] > best[0][3]):
                    best = (c, n - shared)
            if best:
                c, more = best
                c[1], c[2], c[3] = start + n, at + n, c[3] + more
            else:
                open_.append([start, start + n, at + n, n])
        out += [(min(1.0, c[3] / s.lengths[k]), s.labels[k]) for c in open_ if c[3] / s.lengths[k] >= s.min_cover]
    return out
