import re

import numpy as np
import pytest
import xxhash
from conftest_llm import rows_of, same_ids

from episight.llm import simhash as S

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius=3):
    fps = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return [(d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("which", ["documents", "edge", "empty"])
def test_components_equal_brute_force(request, which):
    docs = request.getfixturevalue(which)
    got = S.near_duplicates(docs).collect()
    assert same_ids(got, docs)
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got) == sorted(map(repr, brute_components(rows_of(docs))))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_bit_sliced_pairs_equal_popcounts(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.concatenate([base, *[base ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for _ in range(3)]])
    i, j = S.near_pairs(fp, fp, radius)
    want = {(a, b) for a in range(len(fp)) for b in range(len(fp)) if bin(int(fp[a] ^ fp[b])).count("1") <= radius}
    assert set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("n", [10, 10**5, 10**8, 10**11])
def test_any_two_within_the_radius_share_a_bucket(n):
    masks = [sum(1 << b for b in bits) for bits in S.buckets_for(n, 3)]
    rng = np.random.default_rng(0)
    for _ in range(300):
        diff = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(diff & m == 0 for m in masks)


def test_chains_over_many_rounds(spark):
    fps = [(1 << k) - 1 for k in range(0, 61, 3)]  # each links only to its neighbours
    df = spark.createDataFrame([(100 - k, f) for k, f in enumerate(fps)], "doc_id long, fp long")
    got = S.fingerprint_components(df, 3).collect()
    assert {r.component_id for r in got} == {100 - len(fps) + 1}


def test_a_large_tight_group(spark):
    rng = np.random.default_rng(4)
    fps = {int(7 ^ (1 << int(a)) ^ (1 << int(b))) for a, b in rng.integers(0, 62, (3000, 2))}
    df = spark.createDataFrame([(k, f) for k, f in enumerate(sorted(fps))], "doc_id long, fp long")
    assert {r.component_id for r in S.fingerprint_components(df, 3).collect()} == {0}


def test_other_radii():
    rng = np.random.default_rng(9)
    fp = rng.integers(0, 2**63, 200, dtype=np.uint64)
    for radius in (0, 4, 7, 24, 31, 40):
        i, j, d = S.near_pairs(fp, fp, radius, distances=True)
        want = {(a, b): n for a in range(200) for b in range(200) if (n := bin(int(fp[a] ^ fp[b])).count("1")) <= radius}
        assert {(a, b): n for a, b, n in zip(i.tolist(), j.tolist(), d.tolist())} == want
    with pytest.raises(ValueError):
        S.near_pairs(fp, fp, 63)


def test_radii_without_buckets_are_refused(documents):
    for radius in (0, 4):
        with pytest.raises(ValueError):
            S.near_duplicates(documents, radius)


def shingles_of(text, width=5):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_groups(rows, similarity=0.8):
    """The smallest id of each row's group, in the order of the rows."""
    sets = [shingles_of(t) for _, t in rows]
    root, where = list(range(len(rows))), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        where.setdefault(s, []).append(i)
    some = list(where)
    for group in where.values():
        for i in group:
            root[find(i)] = find(group[0])
    by = {}
    for k, s in enumerate(some):
        for x in s:
            by.setdefault(x, []).append(k)
    for a, s in enumerate(some):
        shared = {}
        for x in s:
            for b in by[x]:
                if b < a:
                    shared[b] = shared.get(b, 0) + 1
        for b, n in shared.items():
            if n >= similarity * (len(s) + len(some[b]) - n) - 1e-9:
                root[find(where[s][0])] = find(where[some[b]][0])
    least = {}
    for i, (d, _) in enumerate(rows):
        g = find(i)
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return [least.get(find(i), ("none", find(i))) for i in range(len(rows))]


@pytest.mark.parametrize("square", [8192, 3])
@pytest.mark.parametrize("which", ["documents", "edge", "empty"])
def test_one_of_each_group_stays(request, monkeypatch, which, square):
    monkeypatch.setattr(S, "SET_SQUARE", square)
    docs = request.getfixturevalue(which)
    rows = rows_of(docs)
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    want = set(brute_groups(rows))
    assert {r.doc_id for r in got} - {None} == {w for w in want if not isinstance(w, tuple)}
    assert len(got) == len(want)
    have = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    assert all((r.doc_id, r.text) in have for r in got)


def test_near_copies_link_and_chains_are_whole(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 6))
    base = [word() for _ in range(200)]
    texts = []
    for k in range(60):  # each has one more word changed than the one before: neighbours link, far ones don't
        base = base.copy()
        base[(k * 3) % 200] = word()
        texts.append(" ".join(base))
    texts += [" ".join(word() for _ in range(100)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(brute_groups(list(enumerate(texts))))
    assert len(want) == 41
    assert {r.doc_id for r in S.keep_first(docs).collect()} == want


def repeated_passages(pairs=6):
    """Pairs alike in their sets of shingles, with different passages repeated many times."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 7))
    out = []
    for _ in range(pairs):
        text = [word() for _ in range(200)]
        out += [" ".join(text + [word() for _ in range(6)] * 200) for _ in range(2)]
    return out


@pytest.mark.parametrize("square", [8192, 2])
def test_passages_repeated_many_times_hide_no_copies(spark, monkeypatch, square):
    monkeypatch.setattr(S, "SET_SQUARE", square)
    texts = repeated_passages()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(brute_groups(list(enumerate(texts))))
    assert want == {0, 2, 4, 6, 8, 10}
    assert {r.doc_id for r in S.keep_first(docs).collect()} == want


@pytest.mark.parametrize("square, leaders", [(8192, 8), (7, 2), (4, 1)])
def test_families_that_leaders_do_not_reach(spark, monkeypatch, square, leaders):
    """Copies of copies at 0.7 to 0.95 of each other: buckets hold several components, and chains link them."""
    monkeypatch.setattr(S, "SET_SQUARE", square)
    monkeypatch.setattr(S, "LEADERS", leaders)
    rng = np.random.default_rng(12)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 6))
    texts = []
    for _ in range(4):
        base = [word() for _ in range(150)]
        for k in range(30):
            copy = (texts[-rng.integers(1, min(k, 9) + 1)].split() if k and k % 3 else base).copy()
            for at in rng.integers(0, 150, rng.integers(1, 7)):
                copy[at] = word()
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(brute_groups(list(enumerate(texts))))
    assert 4 < len(want) < 60
    assert {r.doc_id for r in S.keep_first(docs).collect()} == want


def test_similarities_that_cannot_be_counted_are_refused(documents):
    for similarity in (0.4, 0.85):
        with pytest.raises(ValueError):
            S.keep_first(documents, similarity)
