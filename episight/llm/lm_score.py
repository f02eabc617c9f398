"""Language-model scores by online logistic context mixing.

A text is its lower-cased words and an end.  A word is spelled in bytes and a
terminator, and a byte is a path of binary decisions in a code tree that
depends on the byte before it (frequent bytes have short paths).  For each
decision several predictors look up what the training texts did in a context:
the byte before; two, three and five bytes; all of the word so far.  All but
the first are hashed into tables.  Their log-odds are combined by weights that
a gate selects (how often training saw the longest context, and where in the
word the decision is), and a last stage rescales the result by how sure it is.

Mixing is online: a text starts with weights and scales that training teaches,
and while it is read each of its decisions moves them along the gradient of its
log-probability.  With fixed weights instead there are several mixers, each
learnt from words of another frequency.  Besides mixers there is a memory of the
frequent words.  A text starts with the same share for each, and the shares are
refined too, after every ``BLOCK`` words, by how well each has predicted the words so far.
So each word's probability comes from what stands before it, and decisions add up to bits.

Long-range repetition has a predictor of its own: texts are cut by content
into chunks of some 16 words, and a chunk that other training texts hold, or
this text has had, is coded as a copy.  A training text's own chunks are taken
off the counts, so it is scored by what the other texts teach.

Training is counting, over all training texts: words and chunks are counted in
one pass over the texts, tables and mixers then come from each distinct word,
weighted by its count.  What depends on a word alone (its decisions and the
predictors' log-odds) is worked out once a task for each distinct word; mixing
and shares run over every occurrence.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut_lineage, shared_dir, texts

END = 256
STOP = 32
PREDICTORS = 5
GATES = 8
#: Mixers by the count of the words that they are learnt from: up to 1, 8, 64, and more.
FREQUENT = np.array([1, 8, 64])
MIXERS = len(FREQUENT) + 1
#: Log-odds to which a mixer's inputs are rounded while it is learnt.
LEVELS = np.array([-4.5, -3, -2, -1.2, -0.5, 0, 0.5, 1.2, 2, 3, 4.5])
CELLS = MIXERS * GATES * len(LEVELS) ** PREDICTORS
SCALES = 12
BLOCK = 32  # words between two refinements of the shares
#: First shares of the mixers and of the memory of frequent words, and the words that they count for.
SHARES = np.array([0.15] * MIXERS + [0.4])
PRIOR = 16
START = np.array([0.05, 0.3, 0.25, 0.3, 0.3])  # of the weights, where nothing was learnt
COPY = 0.125  # share of the chunk memory
#: Online mixing: how far a decision's gradient moves weights and scales, the most that a step of decisions moves one, and the
#: first shares of the mixer and of the memory.
RATE, SCALE_RATE, MOST = 0.01, 0.004, 0.25
ONLINE_SHARES = np.array([0.6, 0.4])
#: Decisions between two refinements of the weights, at first and at most, and texts that are read side by side.
FIRST_STEP, STEP, LANES = 16, 512, 128
KEYS = 500_000  # words and chunks of a part of the shuffle up to which they are joined by a hash table
ROW = 1 << 16  # counters in a row of the exchanged tables
PIECE, OVERLAP, PREFIX = 8192, 32, 24  # bytes of a word that are spelled at once, looked back to, and hashed from its start
MULT = np.uint64(0x9E3779B97F4A7C15)


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


# --- words and chunks ---------------------------------------------------------


def chunks(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the chunks of texts, given the hashes of their
    words.  A chunk ends after a word that, with the one before, hashes to 0
    mod 16, and with its text."""
    ends = np.cumsum(size) - 1
    before = np.concatenate([[np.uint64(0)], h[:-1]])
    before[ends[:-1] + 1] = 0
    last = ((h ^ before * np.uint64(0xC2B2AE3D27D4EB4F)) * MULT) >> np.uint64(60) == 0
    last[ends] = True
    stop = np.flatnonzero(last)
    first = np.concatenate([[0], stop[:-1] + 1])
    width = stop - first + 1
    power = np.cumprod(np.full(int(width.max(initial=1)), 0x9FB21C651E98DF25, np.uint64), dtype=np.uint64)
    place = np.arange(len(h)) - np.repeat(first, width)
    x = np.add.reduceat((h ^ h >> np.uint64(31)) * power[place], first, dtype=np.uint64) * MULT
    return first, (x ^ x >> np.uint64(29)).view(np.int64)


def chunk_keys(h: np.ndarray):
    """Chunks as keys beside words: a space, which no word has, and eight bytes."""
    import pyarrow as pa

    raw = np.empty((len(h), 9), np.uint8)
    raw[:, 0] = STOP
    raw[:, 1:] = h.astype(">i8").view(np.uint8).reshape(-1, 8)
    return pa.Array.from_buffers(pa.binary(9), len(h), [None, pa.py_buffer(raw)]).cast(pa.binary())


def gather(train: DataFrame, max_words: int = 250_000, max_chunks: int = 500_000) -> DataFrame:
    """(key, n): each word of the texts (the end being the empty word) and each chunk, with its count."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        def packed(keys, n):
            return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64())], names=["key", "n"])

        words, n, held = Words(), np.zeros(1, np.int64), []

        def flush():
            keys = words.all.cast(pa.binary())
            for s in range(0, len(keys), 50_000):
                yield packed(keys[s : s + 50_000], n[s : s + 50_000])
            if held:
                some, times = np.unique(np.concatenate(held), return_counts=True)
                for s in range(0, len(some), 50_000):
                    yield packed(chunk_keys(some[s : s + 50_000]), times[s : s + 50_000])

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                flat, size, _ = words.read(whole.column(0).slice(at, 1000))
                n = np.concatenate([n, np.zeros(words.known - len(n), np.int64)]) + np.bincount(flat, minlength=words.known)
                held.append(chunks(words.hash[flat], size)[1])
                if words.known > max_words or sum(map(len, held)) > max_chunks:
                    yield from flush()
                    words, n, held = Words(), np.zeros(1, np.int64), []
        yield from flush()

    # no partial sums: what a task sends is summed already, and few keys of a task occur twice
    return train.select("text").mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0")


# --- the code: a tree of decisions for each preceding byte -----------------


def pair_counts(words: DataFrame) -> np.ndarray:
    """How often each byte (or the end) follows each byte, the terminator being
    a space; 256 * 257 numbers, whatever the input."""

    def add(keys: list[bytes], n: np.ndarray, sums: np.ndarray) -> None:
        flat = np.frombuffer(b" " + b" ".join(keys) + b" ", np.uint8).astype(np.int64)
        width = np.fromiter(map(len, keys), np.int64, len(keys)) + 1
        empty = width == 1  # the empty word: nothing but the end
        sums[STOP * 257 + END] += n[empty].sum()
        np.add.at(sums, flat[:-1] * 257 + flat[1:], np.repeat(np.where(empty, 0, n), width))

    return summed(words, lambda: add, 256 * 257).reshape(256, 257)


class Code:
    """Paths of (node, bit) for each symbol after each byte, as flat arrays,
    and the log-odds of each node from the pair counts alone."""

    def __init__(self, mass: np.ndarray, start: np.ndarray, nodes: np.ndarray, bits: np.ndarray):
        self.arrays = mass, start, nodes, bits
        self.odds = quantise(np.log(mass[:, 1] / mass[:, 0]))
        self.start, self.size, self.nodes, self.bits = start, np.diff(start), nodes, bits

    @classmethod
    def of_pairs(cls, pairs: np.ndarray) -> Code:
        start, nodes, bits = [0], [], []
        masses = np.zeros((256 * 256, 2))
        for prev in range(256):
            weight = [float(x) + 0.05 for x in pairs[prev]]
            heap = [(w, s, s) for s, w in enumerate(weight)]
            heapq.heapify(heap)
            up: dict[int, tuple[int, int]] = {}
            mass = dict(enumerate(weight))
            for k in range(256):
                a, b = heapq.heappop(heap), heapq.heappop(heap)
                new = 257 + k
                up[a[2]], up[b[2]] = (new, 0), (new, 1)
                mass[new] = a[0] + b[0]
                masses[prev * 256 + k] = a[0], b[0]
                heapq.heappush(heap, (mass[new], new, new))
            for s in range(257):
                path, at = [], s
                while at in up:
                    at, bit = up[at]
                    path.append((prev * 256 + at - 257, bit))
                nodes += [x for x, _ in reversed(path)]
                bits += [x for _, x in reversed(path)]
                start.append(len(nodes))
        return cls(masses, np.array(start, np.int32), np.array(nodes, np.uint32), np.array(bits, np.uint8))


def quantise(odds) -> np.ndarray:
    return np.clip(np.rint(np.asarray(odds) * 16), -127, 127).astype(np.int8)


def level(n: np.ndarray) -> np.ndarray:
    """How often a slot was seen, in four levels."""
    return (n > 0).astype(np.int16) + (n > 4) + (n > 64)


def entries(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Table entries of two bytes: the log-odds below, how often the slot was seen above."""
    return level(n0 + n1) << np.int16(8) | quantise(np.log((n1 + 0.4) / (n0 + 0.4))).view(np.uint8).astype(np.int16)


def items_of(words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """What is spelled at once: words, or pieces of long ones, each with the
    number of its word, the bytes that it only looks back to, and whether the
    word ends with it."""
    if max(map(len, words), default=0) <= PIECE:
        n = len(words)
        return words, np.arange(n), np.zeros(n, np.int64), np.ones(n, bool)
    out, of, skip, last = [], [], [], []
    for k, w in enumerate(words):
        for s in range(0, max(1, len(w)), PIECE):
            back = OVERLAP if s else 0
            out.append(w[s - back : s + PIECE])
            of.append(k)
            skip.append(back)
            last.append(s + PIECE >= len(w))
    return out, np.array(of), np.array(skip), np.array(last)


def parts(words: list[bytes], most: int = 1 << 14) -> Iterator[slice]:
    """Slices of ``words`` that have some ``most`` bytes together, or one word."""
    at, held = 0, 0
    for k, w in enumerate(words):
        held += len(w) + 1
        if held >= most:
            yield slice(at, k + 1)
            at, held = k + 1, 0
    if at < len(words):
        yield slice(at, len(words))


def spell(code: Code, words: list[bytes], table_bits: int) -> tuple[np.ndarray, ...]:
    """The decisions of all words in order: (node, bit, the slot in each hashed
    table, whether late in its word), and the number of decisions of each word."""
    items, of, skip, last = items_of(words)
    raw = np.frombuffer(b" ".join(items) + b" ", np.uint8)
    width = np.fromiter(map(len, items), np.int64, len(items)) + 1  # bytes and terminator
    first = np.cumsum(width) - width
    j = np.arange(len(raw)) - np.repeat(first, width)
    sym = raw.astype(np.int32)
    sym[first[(width == 1) & (skip == 0)]] = END
    prev = np.where(j > 0, np.concatenate([[STOP], raw[:-1]]), STOP).astype(np.int32)
    back = [np.zeros(len(raw), np.uint64)]  # the d bytes before inside the word, as one number, for d = 0, 1, ...
    for d in range(1, 9):
        shifted = np.zeros(len(raw), np.uint64)
        shifted[d:] = raw[:-d]
        shifted[j < d] = 0
        back.append(back[-1] | shifted << np.uint64(8 * (d - 1)))
    power = np.cumprod(np.full(PREFIX + 1, 0x100000001B3, np.uint64), dtype=np.uint64)
    run = np.cumsum(np.where(j < PREFIX, (raw.astype(np.uint64) + np.uint64(1)) * power[np.minimum(j, PREFIX)], np.uint64(0)), dtype=np.uint64)
    run = np.concatenate([[np.uint64(0)], run[:-1]])
    place = np.minimum(j, 7).astype(np.uint64)
    hashes = [
        back[2] << np.uint64(8) | np.minimum(place, 2),
        (back[3] << np.uint64(8) | np.minimum(place, 3)) * MULT,
        back[5] << np.uint64(8) | np.minimum(place, 5) | np.uint64(32),
        np.where(j <= PREFIX, run - np.repeat(run[first], width), back[8] * MULT) ^ np.uint64(48),
    ]
    if skip.any() or not last.all():
        own = np.flatnonzero((j >= np.repeat(skip, width)) & ((j < np.repeat(width, width) - 1) | np.repeat(last, width)))
        prev, sym = prev[own], sym[own]
        hashes, j, of = [h[own] for h in hashes], j[own], np.repeat(of, width)[own]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    cell = prev * 257 + sym
    n = code.size[cell]
    at = np.repeat(code.start[cell] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    node, bit = code.nodes[at], code.bits[at]
    mixed = node * np.uint32(0x85EBCA6B)
    shift = np.uint32(32 - table_bits)
    slots = [(np.repeat(((h * MULT) >> np.uint64(32)).astype(np.uint32), n) ^ mixed) * np.uint32(0x9E3779B1) >> shift for h in hashes]
    return node, bit, slots, np.repeat((j > 2).astype(np.uint8), n), np.add.reduceat(n, first)


# --- training ----------------------------------------------------------------


def summed(words: DataFrame, make, length: int) -> np.ndarray:
    """What ``make()(words, their counts, sums)`` adds up over all words, as one
    array: ``length`` numbers at most come from a task and to the driver."""
    import pyarrow as pa

    names, schema = ["block", "data"], "block int, data binary"

    def packed(blocks, data):
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], names=names)

    def count_up(batches: Iterator) -> Iterator:
        import zstandard

        sums, add = np.zeros(-(-length // ROW) * ROW, np.int64), make()
        for b in batches:
            keys, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            for s in parts(keys):
                add(keys[s], n[s], sums[:length])
        pack = zstandard.ZstdCompressor(level=1).compress
        rows = sums.reshape(-1, ROW)
        some = np.flatnonzero(rows.any(1))
        for s in range(0, len(some), 256):
            yield packed(some[s : s + 256], [pack(rows[i].tobytes()) for i in some[s : s + 256]])

    def add_up(batches: Iterator) -> Iterator:
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        key, total = None, None
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key != k:
                    if key is not None:
                        yield packed([key], [pack(total.tobytes())])
                    key, total = k, np.zeros(ROW, np.int64)
                total += np.frombuffer(unpack(data), np.int64)
        if key is not None:
            yield packed([key], [pack(total.tobytes())])

    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    out = np.zeros(-(-length // ROW) * ROW, np.int64)
    rows = words.mapInArrow(count_up, schema).repartition("block").sortWithinPartitions("block").mapInArrow(add_up, schema)
    for k, data in rows.toLocalIterator():
        out[k * ROW : (k + 1) * ROW] = np.frombuffer(unpack(data), np.int64)
    return out[:length]


def count_tables(words: DataFrame, code, table_bits: int) -> np.ndarray:
    """Counts of both bits by slot for each hashed table, over all words."""
    length = 2 << table_bits

    def make():
        c = Code(*code.value)

        def add(keys: list[bytes], n: np.ndarray, sums: np.ndarray) -> None:
            _, bit, slots, _, per_word = spell(c, keys, table_bits)
            times = np.repeat(n, per_word)
            for k, slot in enumerate(slots):
                np.add.at(sums[k * length : (k + 1) * length], slot * np.uint32(2) + bit, times)

        return add

    return summed(words, make, (PREDICTORS - 1) * length).reshape(PREDICTORS - 1, -1, 2)


def gate_of(seen: np.ndarray, late: np.ndarray) -> np.ndarray:
    return seen * 2 + late


def remembered(t: np.ndarray) -> np.ndarray:
    """For each slot and bit of a table's counts, if that bit is what happened and its
    own occurrence is taken off: the nearest of LEVELS to the signed log-odds, and from bit 4 on how often the slot was seen."""
    nearest = np.abs(np.arange(-128, 128)[:, None] / 16 - LEVELS).argmin(1).astype(np.uint8)
    out = np.empty(t.shape, np.uint8)
    for s in range(0, len(t), ROW):
        pair = t[s : s + ROW].astype(np.int64)
        did, did_not = np.maximum(pair - 1, 0), pair[:, ::-1]
        odds = np.log(((did + 0.4) / (did_not + 0.4)).astype(np.float32))
        out[s : s + ROW] = nearest[quantise(odds).astype(np.int64) + 128] | level(did + did_not).astype(np.uint8) << 4
    return out


def count_patterns(words: DataFrame, code, counts, table_bits: int) -> np.ndarray:
    """How often the predictors' log-odds, rounded to LEVELS and signed so that
    positive favours what happened, occur together, by mixer and gate.  Each
    occurrence of a word is predicted without its own counts, which slot and bit
    determine: a byte for each travels in place of the counts."""
    nearest = np.abs(np.arange(-128, 128)[:, None] / 16 - LEVELS).argmin(1)
    base = len(LEVELS)
    bytes_ = words.sparkSession.sparkContext.broadcast([remembered(t).ravel() for t in counts.value])

    def make():
        c = Code(*code.value)

        def add(keys: list[bytes], n: np.ndarray, sums: np.ndarray) -> None:
            node, bit, slots, late, per_word = spell(c, keys, table_bits)
            sign = np.where(bit == 1, 1, -1)
            cell = nearest[c.odds[node].astype(np.int64) * sign + 128]
            for t, slot in zip(bytes_.value, slots):
                got = t[slot * np.uint32(2) + bit]
                cell = cell * base + (got & 15)
            mixer = np.repeat(np.searchsorted(FREQUENT, n), per_word)
            cell += (mixer * GATES + gate_of(got >> 4, late)) * base**PREDICTORS
            np.add.at(sums, cell, np.repeat(n, per_word))

        return add

    out = summed(words, make, CELLS)
    bytes_.destroy()
    return out


def newton(x: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Weights that minimise the bits of decisions with favourable log-odds x @ weights, drawn a little to ``start``."""
    w = start.astype(np.float64)
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * miss) - 4 * (w - start)
        bend = (x * (n * miss * (1 - miss))[:, None]).T @ x + 4 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + np.clip(step, -0.5, 0.5)
        if np.abs(step).max() < 1e-4:
            break
    return w


def rank_of(s: np.ndarray) -> np.ndarray:
    return np.minimum(np.abs(s) * np.float32(1.5), SCALES - 1).astype(np.int32)


def learn(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (mixer, gate, predictor) and scales (mixer, rank) from all patterns."""
    rows = patterns.reshape(-1, GATES, len(LEVELS) ** PREDICTORS)
    weights, scale = np.tile(START, (len(rows), GATES, 1)), np.ones((len(rows), SCALES))
    for k in range(len(rows)):
        odds, times = [], []
        for g in range(GATES):
            cell = np.flatnonzero(rows[k, g])
            if not len(cell):
                continue
            x = np.stack([LEVELS[cell // len(LEVELS) ** p % len(LEVELS)] for p in range(PREDICTORS - 1, -1, -1)], 1)
            n = rows[k, g, cell].astype(np.float64)
            weights[k, g] = newton(x, n, START)
            odds.append(x @ weights[k, g])
            times.append(n)
        if odds:
            s, n = np.concatenate(odds), np.concatenate(times)
            rank = rank_of(s)
            for r in range(SCALES):
                scale[k, r] = newton(s[rank == r, None], n[rank == r], np.ones(1))[0] if (rank == r).any() else 1
    return weights.astype(np.float32), np.maximum(scale, 0.05).astype(np.float32)


# --- scoring ---------------------------------------------------------------


class Model:
    """Code, tables and mixers; made in a task from the arrays that were broadcast."""

    def __init__(self, code: Code, tables: np.ndarray, weights: np.ndarray, scale: np.ndarray, table_bits: int):
        self.code, self.tables, self.weights, self.scale, self.table_bits = code, tables, weights, scale, table_bits

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each decision the predictors' log-odds, signed so that positive
        favours what happened, and the gate; and the decisions of each word."""
        node, bit, slots, late, per_word = spell(self.code, words, self.table_bits)
        x = np.empty((len(node), PREDICTORS), np.float32)
        x[:, 0] = self.code.odds[node]
        for k, (t, slot) in enumerate(zip(self.tables, slots)):
            entry = t[slot]
            x[:, k + 1] = entry.astype(np.int8)  # the lower byte
        x *= np.where(bit == 1, np.float32(1 / 16), np.float32(-1 / 16))[:, None]
        return x, gate_of((entry >> 8).astype(np.uint8), late), per_word

    def packed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same in eight bytes a decision: the log-odds in sixteenths, the gate, and zeros."""
        node, bit, slots, late, per_word = spell(self.code, words, self.table_bits)
        out = np.zeros((len(node), 8), np.int8)
        sign = (bit << 1).view(np.int8) - np.int8(1)
        np.multiply(self.code.odds[node], sign, out=out[:, 0])
        for k, (t, slot) in enumerate(zip(self.tables, slots)):
            entry = np.take(t, slot)
            np.multiply(entry.view(np.int8)[:: entry.itemsize], sign, out=out[:, k + 1])  # the lower byte
        np.add(entry.view(np.int8)[1 :: entry.itemsize] << np.int8(1), late.view(np.int8), out=out[:, PREDICTORS])  # gate_of
        return out.view(np.uint64).ravel(), per_word

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """Natural log-probability of each word by each mixer."""
        out = np.zeros((len(words), MIXERS))
        for s in parts(words):
            x, gate, per_word = self.inputs(words[s])
            order = np.argsort(gate, kind="stable")  # a gate's decisions side by side
            x = x[order]
            odds = np.empty((len(x), MIXERS), np.float32)
            edge = np.searchsorted(gate[order], np.arange(GATES + 1))
            for g, (a, b) in enumerate(zip(edge, edge[1:])):
                np.matmul(x[a:b], self.weights[:, g].T, out=odds[a:b])
            z = odds * np.take(self.scale.ravel(), rank_of(odds) + np.arange(MIXERS, dtype=np.int32) * SCALES)
            np.clip(z, -15, 15, out=z)
            lost = np.empty_like(z)
            lost[order] = np.log(1 + np.exp(-z))
            out[s] = -np.add.reduceat(lost, np.cumsum(per_word) - per_word, axis=0, dtype=np.float64)
        return out


def refined(weights: np.ndarray, scale: np.ndarray, rows: np.ndarray, start: np.ndarray, many: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Natural log-probability of each word of texts that stand one after
    another, by online logistic mixing.  Word k has the decisions
    rows[start[k] : start[k] + many[k]] as ``Model.packed`` gives them.

    A text starts with ``weights`` (gate, predictor) and ``scale``.  Every decision
    is mixed with the weights as they are then, and teaches: after each step (of
    ``FIRST_STEP`` decisions twice, then twice as many up to ``STEP``) weights and
    scales go along the gradient of its log-probability.  Texts are read side by
    side, each with its own weights."""
    n = many[flat]
    ends = np.cumsum(n)
    begins = ends - n
    head = np.cumsum(size) - size  # the texts' first words
    total = np.add.reduceat(n, head) if len(size) else n
    order = np.argsort(-total, kind="stable")
    out = np.zeros(len(flat))
    count = np.arange(LANES * STEP)
    eighth = count * 8
    for g in range(0, len(order), LANES):
        a = begins[head[order[g : g + LANES]]]
        stop = a + total[order[g : g + LANES]]
        w = np.zeros((len(a), GATES, 8), np.float32)  # for log-odds in sixteenths; of a decision's eight bytes only the predictors weigh
        w[:, :, :PREDICTORS] = weights / 16
        scales = np.tile(scale.astype(np.float32), (len(a), 1))
        step, taken = FIRST_STEP, 0
        while len(a):
            last = np.minimum(a + step, stop)
            lanes = len(a)
            i = np.searchsorted(ends, a, "right")
            k = np.searchsorted(ends, last, "left") - i + 1  # words that the step touches
            word = np.repeat(i - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            low = np.maximum(begins[word], np.repeat(a, k))
            c = np.minimum(ends[word], np.repeat(last, k)) - low
            seg = np.cumsum(c) - c
            at = np.repeat(start[flat[word]] + low - begins[word] - seg, c)
            at += count[: len(at)]
            x = np.take(rows, at)
            own = last - a
            if full := bool((own == step).all()):
                x = x.reshape(lanes, step)
            else:  # a text's last step is filled up with zeros
                place = np.repeat(np.arange(lanes) * step - (np.cumsum(own) - own), own) + np.arange(len(x))
                held = np.zeros((lanes, step), np.uint64)
                held.ravel()[place] = x
                x = held
            x = x.view(np.int8).reshape(lanes, step, 8)
            f = x.astype(np.float32)
            at = eighth[: x.size // 8] + x[:, :, PREDICTORS].ravel()
            s = np.take(np.matmul(f, np.ascontiguousarray(w.transpose(0, 2, 1))), at)
            rank = (rank_of(s).reshape(lanes, step) + np.arange(0, lanes * SCALES, SCALES, dtype=np.int32)[:, None]).ravel()
            sure = np.take(scales, rank)
            e = np.exp(-np.clip(s * sure, -15, 15))
            lost = np.log(1 + e)
            out[word] -= np.add.reduceat(lost if full else lost[place], seg, dtype=np.float64)
            err = e / (1 + e)
            slope = np.zeros(x.size, np.float32)
            slope[at] = err * sure
            slope = np.matmul(slope.reshape(x.shape).transpose(0, 2, 1), f)[:, :, :PREDICTORS]
            w[:, :, :PREDICTORS] += np.clip(slope * np.float32(RATE / 16), -MOST, MOST) / 16
            drawn = np.bincount(rank, err * s, lanes * SCALES).reshape(lanes, SCALES)
            scales = np.maximum(scales + np.clip(SCALE_RATE * drawn, -MOST, MOST).astype(np.float32), np.float32(0.05))
            taken += step
            step = min(STEP, taken)
            if len(live := np.flatnonzero(last < stop)) < lanes:
                w, scales = w[live], scales[live]
            a, stop = last[live], stop[live]
    return out


def shared(best: np.ndarray, ratio: np.ndarray, flat: np.ndarray, size: np.ndarray, shares: np.ndarray = SHARES) -> np.ndarray:
    """Natural log-probability of each word of texts that stand one after
    another.  Word k has probability exp(best[k]) * ratio[k, m] by predictor m;
    row 0 belongs to no word.  Shares are refined after every BLOCK words."""
    order = np.argsort(-size, kind="stable")
    blocks = -(-size[order] // BLOCK)
    first = np.cumsum(blocks) - blocks
    padded = np.zeros((int(blocks.sum()), BLOCK), np.int64)
    start = (np.cumsum(size) - size)[order]
    size = size[order]
    place = np.repeat(first * BLOCK - (np.cumsum(size) - size), size) + np.arange(len(flat))
    source = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(flat))
    padded.ravel()[place] = flat[source]
    got = np.empty(padded.shape, np.float32)
    tally = np.tile(shares * PRIOR, (len(size), 1))
    for t in range(int(blocks.max(initial=0))):
        live = int(np.searchsorted(-blocks, -t, "left"))
        rows = first[:live] + t
        r = ratio[padded[rows]]
        share = (tally[:live] / (PRIOR + t * BLOCK)).astype(np.float32)
        mix = np.matmul(r, share[:, :, None])[:, :, 0]
        got[rows] = mix
        tally[:live] += np.matmul((1 / mix)[:, None, :], r)[:, 0, :] * share
    out = np.empty(len(flat))
    out[source] = np.log(got.ravel()[place])
    return out + best[flat]


def within(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each chunk is in its text, and how often before."""
    order = np.lexsort((h, text))
    t, x = text[order], h[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (x[1:] != x[:-1])]) if len(t) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    times = np.diff(np.concatenate([at, [len(t)]]))
    own, before = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
    own[order] = np.repeat(times, times)
    before[order] = np.arange(len(t)) - np.repeat(at, times)
    return own, before


def with_memory(spelled: np.ndarray, seen: np.ndarray, of: np.ndarray) -> np.ndarray:
    """log10-probability of chunks, from that of their words and from the memory's ``seen`` of ``of`` chunks."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(spelled * np.log(10) + np.log(1 - COPY), np.log(COPY) + np.log(seen) - np.log(np.maximum(of, 1))) / np.log(10)


class Spelled:
    """Words as a task has met them: their decisions, or with fixed weights their log-probabilities, and what the memory gives them."""

    def __init__(self, model: Model, online: bool, decisions: int):
        self.model, self.online = model, online
        self.best, self.ratio, self.memory = np.zeros(0), np.zeros((0, MIXERS + 1), np.float32), np.zeros(0)
        self.rows, self.n_rows, self.start, self.many = np.zeros(decisions if online else 0, np.uint64), 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, words: list[bytes], memory: np.ndarray) -> None:
        if not self.online:
            lp = np.concatenate([self.model.spelled(words), memory[:, None]], 1)
            top = lp.max(1)
            self.best, self.ratio = np.concatenate([self.best, top]), np.concatenate([self.ratio, np.exp(lp - top[:, None]).astype(np.float32)])
            return
        per_word = [np.zeros(0, np.int64)]
        for s in parts(words):
            got, many = self.model.packed(words[s])
            if self.n_rows + len(got) > len(self.rows):
                self.rows = np.concatenate([self.rows[: self.n_rows], np.zeros(max(len(got), len(self.rows) // 2), np.uint64)])
            self.rows[self.n_rows : self.n_rows + len(got)] = got
            self.n_rows += len(got)
            per_word.append(many.astype(np.int64))
        self.many = np.concatenate([self.many, *per_word])
        self.start = np.cumsum(self.many) - self.many
        self.memory = np.concatenate([self.memory, memory])

    def score(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Natural log-probability of each word of texts one after another."""
        if not self.online:
            return shared(np.concatenate([[0], self.best]), np.concatenate([np.ones((1, MIXERS + 1), np.float32), self.ratio]), flat + 1, size)
        lp = np.stack([refined(self.model.weights[0], self.model.scale[0], self.rows, self.start, self.many, flat, size), self.memory[flat]], 1)
        top = lp.max(1)
        ratio = np.ones((len(flat) + 1, 2), np.float32)
        np.exp(lp - top[:, None], out=ratio[1:], casting="same_kind")
        return shared(np.concatenate([[0], top]), ratio, np.arange(1, len(flat) + 1), size, ONLINE_SHARES)


def score_texts(docs: DataFrame, code, model, hot, totals: dict, online: bool = False, max_words: int = 250_000, max_decisions: int = 8_000_000) -> DataFrame:
    """A row (key null) for each text with its score as far as hot words and
    chunks go, and a row for each other word (``times`` how often) and chunk of it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    # most rows are words and have none of the two structs
    own = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    copy = {"before": pa.int64(), "place": pa.int64(), "spelled": pa.float64()}
    fields = lambda kinds: ", ".join(f"{c}: {({pa.int64(): 'long', pa.bool_(): 'boolean'}).get(k, 'double')}" for c, k in kinds.items())
    schema = f"row_id long, key binary, times long, own struct<{fields(own)}>, copy struct<{fields(copy)}>"

    def batch_of(rows: int, **have):
        def one(c, k):
            return pa.nulls(rows, k) if c not in have else have[c].cast(k) if isinstance(have[c], pa.Array) else pa.array(have[c], k)

        def packed(kinds):
            if not have.keys() & kinds.keys():
                return pa.nulls(rows, pa.struct(list(kinds.items())))
            return pa.StructArray.from_arrays([one(c, k) for c, k in kinds.items()], fields=[pa.field(c, k) for c, k in kinds.items()])

        columns = [one("row_id", pa.int64()), one("key", pa.binary()), one("times", pa.int64()), packed(own), packed(copy)]
        return pa.RecordBatch.from_arrays(columns, names=["row_id", "key", "times", "own", "copy"])

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        m = Model(Code(*code.value), *model.value)
        hot_words, hot_chunks, hot_times = hot.value
        row_id = TaskContext.get().partitionId() << 40

        def fresh():
            return Words(), Spelled(m, online, max_decisions * 5 // 4), np.zeros(0)

        words, spelled_words, base = fresh()
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                b = whole.slice(s, 1000)
                n = b.num_rows
                if words.known > max_words or spelled_words.n_rows > max_decisions:
                    words, spelled_words, base = fresh()
                flat, size, _ = words.read(b.column(2))
                if first_time := words.known - len(base):
                    fresh_words = words.all[-first_time:].to_pylist()  # with the end, at first
                    c = np.fromiter((hot_words.get(w, 0) for w in fresh_words), np.float64, first_time)
                    with np.errstate(divide="ignore"):
                        spelled_words.add(fresh_words, np.log(np.maximum(c - 1, 0) / max(1, totals["n"] - totals["v"])))
                    base = np.concatenate([base, np.where(c > 0, np.log10(c + 1) - totals["down"], np.nan)])
                text = np.repeat(np.arange(n), size)
                lp = spelled_words.score(flat, size) / np.log(10)
                # chunks
                first, h = chunks(words.hash[flat], size)
                of = text[first]
                spelled = np.add.reduceat(lp, first)
                times, before = within(of, h)
                held = b.column(1).to_numpy(zero_copy_only=False)
                times = np.where(held[of], 0, times)
                own_chunks = np.bincount(of, minlength=n)
                place = np.arange(len(of)) - np.repeat(np.cumsum(own_chunks) - own_chunks, own_chunks)
                place = place + totals["chunks"] - np.where(held, 0, own_chunks)[of]  # chunks that the memory has at this point
                at = np.minimum(np.searchsorted(hot_chunks, h), max(0, len(hot_chunks) - 1))
                known = hot_chunks[at] == h if len(hot_chunks) else np.zeros(len(h), bool)
                score = np.bincount(of[known], with_memory(spelled[known], hot_times[at[known]] - times[known] + before[known], place[known]), n)
                # words
                add = base[flat]
                cold = np.isnan(add)
                ids = row_id + np.arange(1, n + 1)
                row_id += n
                yield batch_of(
                    n, row_id=ids, doc_id=b.column(0).cast(pa.int64()), held_out=b.column(1), n_bytes=pc.binary_length(b.column(2)), n_tokens=size,
                    n_known=np.bincount(text[~cold], minlength=n), base_score=np.bincount(text[~cold], add[~cold], n), score=score,
                )
                if cold.any():
                    pair, many = np.unique(text[cold] << 32 | flat[cold], return_counts=True)
                    yield batch_of(len(pair), row_id=ids[pair >> 32], key=words.all.take(pa.array(pair & (2**32 - 1))), times=many)
                if not known.all():
                    new_ = ~known
                    yield batch_of(int(new_.sum()), row_id=ids[of[new_]], key=chunk_keys(h[new_]), times=times[new_], before=before[new_], place=place[new_], spelled=spelled[new_])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def lm_scores(docs: DataFrame, max_table_bits: int = 21, hot_parts: int = 1_000_000, hot_chunk_parts: int = 100_000, id_col: str = "doc_id", text_col: str = "text", online: bool = False) -> DataFrame:
    """Score every whole text, learning from those that aren't held out.

    Returns doc_id, held_out (crc32 of the id as text mod 7 is 2), n_bytes,
    n_tokens (words and one end), n_known (tokens that training has),
    train_tokens, base_score (add-one unigram log10 probability), score (the
    mixing model's) and bits_per_byte (the score's, null for an empty text); a row for each row of ``docs``.

    A null text counts as empty (one token, the end); a null id counts as
    trained on and stays null; repeated rows are scored each; an empty table
    gives an empty result; other columns are ignored.  Without any training
    texts the tables are empty and the base score is 0 for each token.

    Words and chunks are counted without a bound and joined.  ``hot_parts``:
    words with at least this part of all tokens, at most so many, are broadcast
    with their counts; ``hot_chunk_parts``: chunks likewise; no other key has
    many rows.  The hashed tables grow with the distinct words, up to 2 to the
    ``max_table_bits`` slots each, as they are broadcast (two bytes a slot).
    ``online``: weights and scales are refined while a text is read; without it
    they stay as training left them, and only the shares of several mixers move.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    rows = texts(docs, id_col, text_col).withColumn("held_out", is_held_out(F.col("doc_id")))
    gathered = cut_lineage(gather(rows.where("not held_out")))
    is_chunk = F.substring("key", 1, 1) == F.lit(b" ")
    words = gathered.where(~is_chunk)
    n, v, all_chunks, all_keys = gathered.agg(F.coalesce(F.sum(F.when(~is_chunk, F.col("n"))), F.lit(0)), F.count(F.when(~is_chunk, 1)), F.coalesce(F.sum(F.when(is_chunk, F.col("n"))), F.lit(0)), F.count("*")).first()
    totals = {"n": n, "v": v, "chunks": all_chunks, "down": float(np.log10(n + v + 1))}
    table_bits = min(max_table_bits, max(12, (16 * v).bit_length()))
    share = spark.sparkContext.broadcast
    # plain arrays travel, as workers need not have this package on their path
    code = share(Code.of_pairs(pair_counts(words)).arrays)
    counts = share(np.minimum(count_tables(words, code, table_bits), 2**32 - 1).astype(np.uint32))
    patterns = count_patterns(words, code, counts, table_bits)
    weights, scale = learn(patterns.reshape(MIXERS, -1).sum(0) if online else patterns)
    tables = np.stack([entries(t[:, 0].astype(np.int64), t[:, 1].astype(np.int64)) for t in counts.value])
    counts.destroy()
    is_hot = F.when(is_chunk, F.col("n") * hot_chunk_parts >= all_chunks).otherwise(F.col("n") * hot_parts >= n)
    hot_words: dict[bytes, int] = {}
    hot_chunks = []
    for key, times in gathered.where(is_hot).toLocalIterator():
        if key[:1] == b" ":
            hot_chunks.append((int.from_bytes(key[1:], "big", signed=True), times))
        else:
            hot_words[bytes(key)] = times
    hot_chunks = np.array(sorted(hot_chunks), np.int64).reshape(-1, 2)
    scored = score_texts(rows, code, share((tables, weights, scale, table_bits)), share((hot_words, hot_chunks[:, 0].copy(), hot_chunks[:, 1].copy())), totals, online)
    # the texts' own rows get a key that nothing else can have (two spaces), so that they spread and match nothing
    own = F.concat(F.lit(b"  "), F.col("row_id").cast("string").cast("binary"))
    cold = gathered.where(~is_hot)
    if all_keys <= KEYS * int(spark.conf.get("spark.sql.shuffle.partitions")):
        cold = cold.hint("shuffle_hash")  # a part's keys fit a hash table, so that nothing has to be sorted
    met = scored.withColumn("key", F.coalesce("key", own)).join(cold, "key", "left")
    c = F.coalesce("n", F.lit(0))
    log = F.log10((c + 1).cast("double")) - F.lit(totals["down"])
    seen = (F.greatest(c - F.col("times"), F.lit(0)) + F.col("copy.before")).cast("double")
    a = F.col("copy.spelled") + F.lit(float(np.log10(1 - COPY)))
    b = F.log10(F.lit(COPY) * seen / F.greatest("copy.place", F.lit(1)))
    copied = F.when(seen > 0, F.greatest(a, b) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(a - b)))).otherwise(a)
    is_text, is_word = F.col("own").isNotNull(), F.col("copy").isNull()
    met = met.select(
        "row_id", "own.doc_id", "own.held_out", "own.n_bytes", "own.n_tokens",
        F.when(is_text, F.col("own.n_known")).when(is_word & (c > 0), F.col("times")).otherwise(0).alias("n_known"),
        F.when(is_text, F.col("own.base_score")).when(is_word, F.col("times") * log).otherwise(0.0).alias("base_score"),
        F.when(is_text, F.col("own.score")).when(is_word, 0.0).otherwise(copied).alias("score"),
    )
    out = met.groupBy("row_id").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
    )
    return out.drop("row_id").withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")))
