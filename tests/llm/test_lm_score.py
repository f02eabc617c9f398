import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import rows_of, same_ids

from episight.llm import lm_score as L

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall(text.translate(LOWER)), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("which", ["documents", "edge"])
def test_base_equals_brute_force_and_the_model_is_a_probability(request, which):
    docs = request.getfixturevalue(which)
    got = L.lm_scores(docs, max_table_bits=16, hot_parts=50, hot_chunk_parts=20).collect()  # few hot words, so that most are joined
    assert same_ids(got, docs)
    data = rows_of(docs)
    c = Counter(t for i, text in data if not held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    want = []
    for i, text in data:
        ts = tokens(text)
        want.append((i, held(i), len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    rows = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got]
    for a, b in zip(sorted(rows, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r.score < 0 for r in got)


def test_held_out_texts_take_fewer_bits_than_by_single_letters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in L.lm_scores(docs).collect() if r.held_out}
    raw = [t.encode() + b" " for i, t in rows_of(docs) if i in got]
    n = np.bincount(np.frombuffer(b"".join(raw), np.uint8))
    p = n[n > 0] / n.sum()
    letters = -(p * np.log2(p)).sum() * n.sum()
    assert -sum(r.score for r in got.values()) / math.log10(2) < 0.65 * letters


def test_a_score_does_not_depend_on_the_texts_beside_it(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a = {r.doc_id: r.score for r in L.lm_scores(docs.repartition(2)).collect()}
    b = {r.doc_id: r.score for r in L.lm_scores(docs.repartition(13, "lang", "doc_id")).collect()}
    assert a == pytest.approx(b, rel=1e-9)


def test_decisions_of_a_symbol_sum_to_one():
    code = L.Code.of_pairs(np.random.default_rng(0).integers(0, 9, (256, 257)))
    p = np.exp(-np.log1p(np.exp(code.odds.astype(float) / 16)))  # of bit 0, as tables would have it
    for prev in (32, 97):
        total = 0.0
        for s in range(257):
            at = slice(code.start[prev * 257 + s], code.start[prev * 257 + s] + code.size[prev * 257 + s])
            q = p[code.nodes[at]]
            total += np.prod(np.where(code.bits[at] == 0, q, 1 - q))
        assert total == pytest.approx(1)


def test_empty_table_and_no_training_rows(spark, empty):
    assert L.lm_scores(empty).count() == 0
    only = next(i for i in range(100) if held(i))
    got = L.lm_scores(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(True, 3, 0, 0, 0.0)]
    assert got[0].bits_per_byte == pytest.approx(-got[0].score / math.log10(2) / 3)


def model_of(spark, docs):
    """The parts of the model of the rows ``docs`` (text), as plain numbers."""
    words = L.cut_lineage(L.gather(docs).where("substring(key, 1, 1) <> cast(' ' as binary)"))
    code = spark.sparkContext.broadcast(L.Code.of_pairs(L.pair_counts(words)).arrays)
    counts = L.count_tables(words, code, 16)
    weights, scale = L.learn(L.count_patterns(words, code, spark.sparkContext.broadcast(counts), 16))
    tables = np.stack([L.entries(t[:, 0], t[:, 1]) for t in counts])
    return L.Model(L.Code(*code.value), tables, weights, scale, 16), counts, {bytes(r.key): r.n for r in words.collect()}


def slow_word(m, word):
    """Log-probability of a word by each mixer, one decision after another."""
    node, bit, slots, late, _ = L.spell(m.code, [word], m.table_bits)
    out = [0.0] * L.MIXERS
    for d in range(len(node)):
        sign = 1 if bit[d] else -1
        entries = [int(t[s[d]]) for t, s in zip(m.tables, slots)]
        x = [sign * int(m.code.odds[node[d]]) / 16, *(sign * ((e & 255) - 256 * (e & 255 > 127)) / 16 for e in entries)]
        gate = (entries[-1] >> 8) * 2 + int(late[d])
        for k in range(L.MIXERS):
            s = sum(a * float(w) for a, w in zip(x, m.weights[k, gate]))
            z = s * float(m.scale[k, min(int(abs(np.float32(s)) * np.float32(1.5)), L.SCALES - 1)])
            out[k] -= math.log1p(math.exp(-max(-15, min(15, z))))
    return out


def test_scores_equal_a_slow_model(spark, documents):
    from pyspark.sql import functions as F
    import pyarrow as pa

    from episight.llm.common import hash_words

    hashed = {}

    def hash_of(w):
        if w not in hashed:
            hashed[w] = int(hash_words(pa.array([w], pa.large_binary()))[0])
        return hashed[w]

    docs = documents.where("doc_id < 40").union(spark.createDataFrame([(1000, "again and again " * 40, "en", "s", 1), (1001, "x" * 20_000, "en", "s", 1)], documents.schema))
    train = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~L.is_held_out(F.col("doc_id")))
    m, counts, words = model_of(spark, train)
    bits = min(21, max(12, (16 * len(words)).bit_length()))
    if bits != m.table_bits:
        m.table_bits = bits
        code = spark.sparkContext.broadcast(L.Code.of_pairs(L.pair_counts(table := L.cut_lineage(L.gather(train).where("substring(key, 1, 1) <> cast(' ' as binary)")))).arrays)
        counts = L.count_tables(table, code, bits)
        m.weights, m.scale = L.learn(L.count_patterns(table, code, spark.sparkContext.broadcast(counts), bits))
        m.tables = np.stack([L.entries(t[:, 0], t[:, 1]) for t in counts])
    n, v = sum(words.values()), len(words)
    known, texts = {}, {}

    def chunks(ws):
        out, at, before = [], [], 0
        for k, w in enumerate(ws):
            h = hash_of(w)
            at.append(w)
            if k == len(ws) - 1 or ((h ^ before * 0xC2B2AE3D27D4EB4F % 2**64) * 0x9E3779B97F4A7C15 % 2**64) >> 60 == 0:
                out.append(tuple(at))
                at = []
            before = h
        return out

    rows = rows_of(docs)
    for i, text in rows:
        texts[i] = [*(w.encode() for w in WORD.findall(text.translate(LOWER))), b""]
    memory = Counter(c for i, ws in texts.items() if not held(i) for c in chunks(ws))
    got = {r.doc_id: r.score for r in L.lm_scores(docs).collect()}
    for i, ws in texts.items():
        tally, total = [x * L.PRIOR for x in L.SHARES], 0.0
        log, add = [], [0.0] * len(tally)
        for k, w in enumerate(ws):
            if k % L.BLOCK == 0:
                tally = [a + b for a, b in zip(tally, add)]
                share, add = [x / (L.PRIOR + k) for x in tally], [0.0] * len(tally)
            if w not in known:
                known[w] = [math.exp(x) for x in slow_word(m, w)] + [max(words.get(w, 0) - 1, 0) / max(1, n - v)] if len(w) < 50 else None
            if known[w] is None:  # its probability is too small for a float
                lp = slow_word(m, w)
                p = [math.exp(x - max(lp)) for x in lp] + [0.0]
                extra = max(lp)
            else:
                p, extra = known[w], 0.0
            mix = sum(a * b for a, b in zip(share, p))
            add = [x + a * b / mix for x, a, b in zip(add, share, p)]
            log.append(math.log(mix) + extra)
        own, before, at = Counter(chunks(ws)), Counter(), 0
        held_chunks = sum(memory.values()) - (0 if held(i) else sum(own.values()))
        for j, c in enumerate(chunks(ws)):
            spelled = sum(log[at : at + len(c)])
            at += len(c)
            seen = memory[c] - (0 if held(i) else own[c]) + before[c]
            before[c] += 1
            a = spelled + math.log(1 - L.COPY)
            if seen > 0:
                b = math.log(L.COPY * seen / max(1, held_chunks + j))
                a = max(a, b) + math.log1p(math.exp(-abs(a - b)))
            total += a
        assert got[i] == pytest.approx(total / math.log(10), rel=2e-4), i


def test_every_training_text_is_counted_and_a_copy_scores_apart(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9)))
    texts = [" ".join(word() for _ in range(120)) for _ in range(60)]
    ids = [i for i in range(200) if not held(i)][:60]
    docs = spark.createDataFrame([*zip(ids, texts), (next(i for i in range(200, 300) if held(i)), texts[3]), (next(i for i in range(300, 400) if not held(i)), texts[5])], "doc_id long, text string")
    got = {r.doc_id: r for r in L.lm_scores(docs).collect()}
    apart = {i for i, r in got.items() if r.bits_per_byte < 1.5}
    assert apart == {ids[5], *(i for i in got if i >= 200)}
    m, counts, words = model_of(spark, docs.where(~L.is_held_out(docs.doc_id)).select("text"))
    decisions = sum(n * len(L.spell(m.code, [w], 16)[0]) for w, n in words.items())
    assert all(t.sum() == decisions for t in counts)


def test_long_words_are_spelled_whole():
    code = L.Code.of_pairs(np.random.default_rng(0).integers(0, 9, (256, 257)))
    rng = np.random.default_rng(1)
    long = bytes(rng.integers(97, 123, 3 * L.PIECE + 17, dtype=np.uint8))
    node, bit, _, late, per_word = L.spell(code, [b"ab", long, b""], 14)
    assert len(per_word) == 3 and per_word.sum() == len(node)
    symbols = [32, *long]  # a byte after the one before it, then the terminator
    want = sum(int(code.size[a * 257 + b]) for a, b in zip(symbols, [*long, 32]))
    assert per_word[1] == want
    # contexts of a piece are those of the whole
    piece = L.PIECE
    try:
        L.PIECE = 1 << 20
        whole = L.spell(code, [b"ab", long, b""], 14)
    finally:
        L.PIECE = piece
    for a, b in zip([node, bit, *L.spell(code, [b"ab", long, b""], 14)[2], late], [whole[0], whole[1], *whole[2], whole[3]]):
        assert (a == b).all()


def slow_refined(weights, scale, words):
    """Log-probability of each word (rows of five log-odds in sixteenths and a gate), one decision after another."""
    w, sc, out = [[float(a) for a in g] for g in weights], [float(a) for a in scale], []
    at, step, ends = 0, L.FIRST_STEP, L.FIRST_STEP
    moves, drawn = [[0.0] * L.PREDICTORS for _ in w], [0.0] * L.SCALES
    bound = lambda a: max(-L.MOST, min(L.MOST, a))
    for rows in words:
        total = 0.0
        for *x, gate in rows:
            if at == ends:
                w = [[a + bound(L.RATE * b) for a, b in zip(g, m)] for g, m in zip(w, moves)]
                sc = [max(0.05, a + bound(L.SCALE_RATE * b)) for a, b in zip(sc, drawn)]
                moves, drawn = [[0.0] * L.PREDICTORS for _ in w], [0.0] * L.SCALES
                step = min(L.STEP, ends)
                ends += step
            s = sum(a / 16 * b for a, b in zip(x, w[gate]))
            rank = min(int(abs(s) * 1.5), L.SCALES - 1)
            z = max(-15, min(15, s * sc[rank]))
            total -= math.log1p(math.exp(-z))
            err = 1 / (1 + math.exp(z))
            moves[gate] = [a + err * sc[rank] * b / 16 for a, b in zip(moves[gate], x)]
            drawn[rank] += err * s
            at += 1
        out.append(total)
    return out


def test_online_mixing_equals_a_slow_mixer():
    rng = np.random.default_rng(3)
    many = rng.integers(1, 40, 300)
    many[7] = 3000  # a word of several steps
    rows = np.zeros((int(many.sum()), 8), np.int8)
    rows[:, : L.PREDICTORS] = rng.integers(-60, 127, (len(rows), L.PREDICTORS))
    rows[:, L.PREDICTORS] = rng.integers(0, L.GATES, len(rows))
    start = np.cumsum(many) - many
    size = np.array([1, 900, 3, 40, *rng.integers(1, 60, 200)])
    flat = rng.integers(0, 300, int(size.sum()))
    weights, scale = np.tile(L.START, (L.GATES, 1)), np.linspace(0.8, 1.3, L.SCALES)
    got = L.refined(weights, scale, rows.view(np.uint64).ravel(), start, many, flat, size)
    at = 0
    for n in size:
        want = slow_refined(weights, scale, [rows[start[k] : start[k] + many[k], : L.PREDICTORS + 1].tolist() for k in flat[at : at + n]])
        assert got[at : at + n] == pytest.approx(want, rel=2e-3, abs=2e-3)
        assert got[at : at + n].sum() == pytest.approx(sum(want), rel=1e-4)
        at += n


def test_odd_decisions_leave_the_weights_finite():
    for x in (-127, 127):
        rows = np.full((5000, 8), x, np.int8)
        rows[:, L.PREDICTORS] = 3
        got = L.refined(np.tile(L.START, (L.GATES, 1)), np.ones(L.SCALES), rows.view(np.uint64).ravel(), np.array([0]), np.array([5000]), np.zeros(20, np.int64), np.array([20]))
        assert np.isfinite(got).all() and (got < 0).all()


def test_the_query_mixes_online(spark):
    from episight.llm import queries

    rows = {r.doc_id: r for r in queries.op2_lm_score(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fixed = {r.doc_id: r for r in L.lm_scores(docs).collect()}
    assert {i: r.base_score for i, r in rows.items()} == pytest.approx({i: r.base_score for i, r in fixed.items()}, rel=1e-9)
    held_out = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].score for i in held_out) > sum(fixed[i].score for i in held_out)  # fewer bits: weights fit each text
    other = {r.doc_id: r.score for r in L.lm_scores(docs.repartition(13, "lang", "doc_id"), online=True).collect()}
    assert other == pytest.approx({i: r.score for i, r in rows.items()}, rel=1e-9)


@pytest.mark.parametrize("which", ["edge", "empty"])
def test_online_scores_of_odd_texts(request, which):
    docs = request.getfixturevalue(which)
    got = L.lm_scores(docs, online=True).collect()
    assert same_ids(got, docs) and all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_slot_and_bit_say_what_a_decision_remembers():
    rng = np.random.default_rng(4)
    t = np.concatenate([rng.integers(0, 5, (70_000, 2)), rng.integers(0, 2**32, (1000, 2)), [[0, 0], [2**32 - 1, 2**32 - 1]]]).astype(np.uint32)
    got = L.remembered(t)
    for k in [*range(0, 70_000, 701), *range(70_000, len(t), 37), len(t) - 2, len(t) - 1]:
        for bit in (0, 1):
            did, did_not = max(int(t[k, bit]) - 1, 0), int(t[k, 1 - bit])
            odds = L.quantise(np.log(np.float32((did + 0.4) / (did_not + 0.4)))) / 16
            assert got[k, bit] & 15 == np.abs(odds - L.LEVELS).argmin()
            assert got[k, bit] >> 4 == sum(did + did_not > x for x in (0, 4, 64))


def test_keys_meet_in_hash_tables_where_they_fit(spark, documents, monkeypatch):
    """A part of few keys isn't sorted; with more of them the join is sorted as before, with equal results."""
    def run():
        out = L.lm_scores(documents, max_table_bits=14, online=True)
        return out._jdf.queryExecution().executedPlan().toString(), {r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in out.collect()}

    plan, few = run()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(L, "KEYS", 0)
    plan, many = run()
    assert "ShuffledHashJoin" not in plan and few == many
