"""Spelling variants: words that differ by one inserted, deleted or replaced character.

Of two words one edit apart, one half of each stands unchanged in the other: its
first half at the other's start, or its second half at the other's end.  The
halves of all words lie in Aho-Corasick automata, one for each *shard*; a half
is in the shard that its hash names, so a word is scanned by at most four
automata: those of the heads and tails that a near word may share with it.  A match counts if it stands
at the right end and the lengths differ by at most one.

A half that many words have would make a quadratic number of candidates, so a
matched half's words aren't tried one by one: inside the half, words meet
on the hash of what is left when the edited character is taken out, and each
pair that meets is compared character by character.  Each shard gives a word's
number of near words and the most frequent one, never the pairs.  Halves of
more than ``HOT`` words are cut into blocks, each a shard of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ODD, cut_lineage

#: Maximal runs of these characters are words.
LETTERS = "A-Za-zÀ-ÿ"
#: Halves of a shard on average, and words of one half in one shard.
SHARD, HOT = 40_000, 50_000
BASE = np.uint64(0x5851F42D4C957F2D)
BACK = np.uint64(pow(int(BASE), -1, 2**64))
GAP = np.uint64(0xD6E8FEB86659FD93)


def word_counts(docs: DataFrame, min_length: int = 7, modulus: int = 31, max_words: int = 300_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least ``min_length`` code points over all texts.

    A word is a run of letters with A-Z lower-cased; with h the unsigned CRC-32
    of ``<doc_id>:<run>``, a run whose h is a multiple of ``modulus`` loses its
    code point h % length.  Counts are added up in each task first
    (``max_words`` bounds its table, not the result).
    """
    runs = re.compile(f"[{LETTERS}]{{{max(1, min_length)},}}")  # shorter ones only get shorter
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})

    def tally(counts: Counter, doc: str, text: str) -> None:
        start = zlib.crc32(f"{doc}:".encode())
        for word, n in Counter(runs.findall(text.translate(lower))).items():
            h = zlib.crc32(word.encode(), start)
            if h % modulus == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < min_length:
                    continue
            counts[word] += n

    def flush(counts: Counter):
        for at in range(0, len(counts), 50_000) if (words := list(counts)) else ():
            part = words[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"])
        counts.clear()

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                tally(counts, doc, text.as_py())
                if len(counts) > max_words:
                    yield from flush(counts)
        yield from flush(counts)

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Flat:
    """Words one after another, with hashes of all their beginnings."""

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.at = np.cumsum(self.size) - self.size
        self.code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        x = (self.code.astype(np.uint64) + np.uint64(1)) * ODD
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        self.mixed = x ^ x >> np.uint64(32)
        place = np.arange(len(self.code)) - np.repeat(self.at, self.size)
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(self.size.max(initial=0)), BASE, np.uint64), dtype=np.uint64)])
        self.run = np.concatenate([[np.uint64(0)], np.cumsum(self.mixed * self.power[place], dtype=np.uint64)])

    def whole(self, w: np.ndarray) -> np.ndarray:
        return self.run[self.at[w] + self.size[w]] - self.run[self.at[w]]

    def without(self, w: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hashes of the words w without their character j."""
        a, z = self.at[w], self.at[w] + self.size[w]
        return self.run[a + j] - self.run[a] + (self.run[z] - self.run[a + j + 1]) * BACK

    def masked(self, w: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hashes of the words w with a gap for their character j."""
        return self.whole(w) + (GAP - self.mixed[self.at[w] + j]) * self.power[j]


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for each value from first up to last, row by row."""
    many = np.maximum(0, last - first)
    row = np.repeat(np.arange(len(first)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]


def meet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) with a[i] == b[j]."""
    order = np.argsort(b, kind="stable")
    sorted_b = b[order]
    row, at = spread(np.searchsorted(sorted_b, a, "left"), np.searchsorted(sorted_b, a, "right"))
    return row, order[at]


class Shard:
    """The halves of some words in an automaton: ``head[k]`` and ``tail[k]`` say which halves of word k are here."""

    def __init__(self, words: list[str], n: np.ndarray, head: np.ndarray, tail: np.ndarray):
        import ahocorasick

        self.words, self.n = words, n
        self.flat = Flat(words)
        node: dict[str, int] = {}
        owner = []  # (node, side, word)
        for side, here in ((0, head), (1, tail)):
            for k in np.flatnonzero(here).tolist():
                w = words[k]
                half = w[: len(w) // 2] if side == 0 else w[len(w) // 2 :]
                owner.append((node.setdefault(half, len(node)), side, k))
        self.half = list(node)
        self.automaton = ahocorasick.Automaton()
        for half, i in node.items():
            self.automaton.add_word(half, (i, len(half)))
        if node:
            self.automaton.make_automaton()
        node_of, side_of, word_of = np.array(owner, np.int64).reshape(-1, 3).T
        self.group, self.own = 2 * node_of + side_of, word_of
        self.has = np.zeros(2 * len(node), bool)
        self.has[self.group] = True
        half_size = np.where(side_of == 0, self.flat.size[word_of] // 2, self.flat.size[word_of] - self.flat.size[word_of] // 2)
        # where the edited character of the word can be: after its head, or before its tail
        self.lo = np.where(side_of == 0, half_size, 0)
        self.hi = np.where(side_of == 0, self.flat.size[word_of], self.flat.size[word_of] - half_size)
        row, j = spread(self.lo, self.hi)
        salt = self.salt(self.group[row])
        self.gaps = row, j, self.flat.masked(self.own[row], j) + salt
        self.cuts = row, j, self.flat.without(self.own[row], j) + salt
        self.wholes = self.flat.whole(self.own) + self.salt(self.group)

    @classmethod
    def of(cls, held: list[tuple[list[str], np.ndarray, np.ndarray]]) -> Shard:
        """From rows (word, n, side) in batches; a word with both halves here comes twice."""
        number: dict[str, int] = {}
        count, here = [], []
        for words, n, side in held:
            for w, x, s in zip(words, n.tolist(), side.tolist()):
                if number.setdefault(w, len(number)) == len(count):
                    count.append(x)
                    here.append([False, False])
                here[number[w]][s] = True
        sides = np.array(here, bool).reshape(-1, 2)
        return cls(list(number), np.array(count, np.int64), sides[:, 0], sides[:, 1])

    def answer(self, words: list[str]) -> pa.RecordBatch:
        """word, n_near, best_n and best (the most frequent near word) of those that have any."""
        i, k = self.scan(words)
        rank = np.argsort(np.array(self.words, object), kind="stable") if len(i) else i
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        order = np.lexsort((place[k], -self.n[k], i)) if len(i) else i
        i, k = i[order], k[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        many = np.diff(np.append(first, len(i)))
        return pa.RecordBatch.from_arrays(
            [pa.array([words[x] for x in i[first]], pa.string()), pa.array(many, pa.int64()), pa.array(self.n[k[first]], pa.int64()), pa.array([self.words[x] for x in k[first]], pa.string())],
            names=["word", "n_near", "best_n", "best"],
        )

    @staticmethod
    def salt(group: np.ndarray) -> np.ndarray:
        x = (group.astype(np.uint64) + np.uint64(1)) * ODD
        return x ^ x >> np.uint64(31)

    def scan(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(i, k): word i of ``words`` is one edit from this shard's word k.

        A pair that shares the head of word k is left to the shard of that
        head, so that each pair comes once over all shards."""
        found = []
        if len(self.half):
            for i, w in enumerate(words):
                size = len(w)
                for end, (node, long) in self.automaton.iter(w):
                    if end + 1 == long and self.has[2 * node]:
                        found.append((i, 2 * node, long))
                    if end + 1 == size and self.has[2 * node + 1]:
                        found.append((i, 2 * node + 1, long))
        if not found:
            return (np.zeros(0, np.int64),) * 2
        flat = Flat(words)
        i, group, long = np.array(found, np.int64).T
        lo = np.where(group % 2 == 0, long, 0)
        hi = np.where(group % 2 == 0, flat.size[i], flat.size[i] - long)
        row, j = spread(lo, hi)
        salt = self.salt(group[row])
        pairs = []
        x, y = meet(flat.masked(i[row], j) + salt, self.gaps[2])  # replaced
        pairs.append((i[row[x]], self.own[self.gaps[0][y]], j[x], self.gaps[1][y], 1, 1, group[row[x]] % 2))
        x, y = meet(flat.without(i[row], j) + salt, self.wholes)  # the scanned word has one more
        pairs.append((i[row[x]], self.own[y], j[x], j[x], 1, 0, group[row[x]] % 2))
        x, y = meet(flat.whole(i) + self.salt(group), self.cuts[2])  # the shard's word has one more
        pairs.append((i[x], self.own[self.cuts[0][y]], self.cuts[1][y], self.cuts[1][y], 0, 1, group[x] % 2))
        a, b = [], []
        for w, k, p, q, skip_w, skip_k, side in pairs:
            ok = (p == q) & (flat.size[w] - skip_w == self.flat.size[k] - skip_k)
            w, k, p, side = w[ok], k[ok], p[ok], side[ok]
            # every character but the edited one is compared
            r, at = spread(np.zeros_like(w), flat.size[w] - skip_w)
            after = at >= p[r]
            same = flat.code[flat.at[w[r]] + at + skip_w * after] == self.flat.code[self.flat.at[k[r]] + at + skip_k * after]
            bad = np.zeros(len(w), bool)
            bad[r[~same]] = True
            if skip_w and skip_k:
                bad |= flat.code[flat.at[w] + p] == self.flat.code[self.flat.at[k] + p]
            long = self.flat.size[k] // 2
            tails = np.flatnonzero((side == 1) & (flat.size[w] >= long))
            r, at = spread(np.zeros_like(tails), long[tails])
            same = flat.code[flat.at[w[tails[r]]] + at] == self.flat.code[self.flat.at[k[tails[r]]] + at]
            shared = np.ones(len(tails), bool)
            shared[r[~same]] = False
            bad[tails[shared]] = True
            a.append(w[~bad])
            b.append(k[~bad])
        both = np.unique(np.concatenate(a) * np.int64(len(self.words)) + np.concatenate(b))
        return both // len(self.words), both % len(self.words)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): for each word of ``words`` (word, n; words distinct)
    that has any, how many others are one edit away, and (-n, word) of the most frequent of
    them (of those, the smallest)."""
    total = 2 * words.count()
    n_shards = max(1, total // SHARD)
    size = F.length("word")

    def head(a: Column) -> Column:
        return F.substring("word", F.lit(1), a)

    def tail(b: Column) -> Column:
        return F.substring("word", size - b + 1, b)

    half = lambda x: F.floor(x / 2).cast("int")
    own = F.array(F.struct(F.lit(0).alias("side"), head(half(size)).alias("half")), F.struct(F.lit(1).alias("side"), tail(size - half(size)).alias("half")))
    near = F.array_distinct(
        F.array(*[F.struct(F.lit(0).alias("side"), head(half(size + k)).alias("half")) for k in (-1, 0, 1)], *[F.struct(F.lit(1).alias("side"), tail(size + k - half(size + k)).alias("half")) for k in (-1, 0, 1)])
    )
    holders = words.select("word", "n", F.explode(own).alias("h")).select("word", "n", "h.side", "h.half")
    # at most total / HOT halves have so many words
    hot = holders.groupBy("side", "half").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("side", "half", F.ceil(F.col("c") / HOT).cast("int").alias("blocks"))
    hot = cut_lineage(hot)
    place = F.pmod(F.xxhash64("side", "half"), F.lit(n_shards))

    def blocks(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(hot), ["side", "half"], "left")

    # a block's shard has a number of its own, beyond the others
    block_of = lambda b: F.lit(n_shards) + F.pmod(F.xxhash64("side", "half", b), F.lit(1 << 40))
    own_block = block_of(F.pmod(F.xxhash64("word"), F.col("blocks").cast("long")))
    kept = blocks(holders).select(F.when(F.col("blocks").isNull(), place).otherwise(own_block).alias("shard"), F.col("side").cast("long").alias("kind"), "word", "n")
    all_blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1), block_of)
    asks = blocks(words.select("word", F.explode(near).alias("h")).select("word", "h.side", "h.half"))
    asks = asks.select(F.explode(F.when(F.col("blocks").isNull(), F.array(place)).otherwise(all_blocks)).alias("shard"), F.lit(2).cast("long").alias("kind"), "word", F.lit(0).cast("long").alias("n"))

    def run(batches):
        at, held, shard = None, [], None
        for b in batches:
            number, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            asked = kind == 2
            edges = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(asked.astype(np.int8)) != 0)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for s, e in zip(edges, edges[1:]):
                if number[s] != at:
                    at, held, shard = number[s], [], None
                if not asked[s]:
                    held.append((b.column(2)[s:e].to_pylist(), b.column(3)[s:e].to_numpy(), kind[s:e]))
                    continue
                if shard is None:
                    shard, held = Shard.of(held), []
                asking = list(dict.fromkeys(b.column(2)[s:e].to_pylist()))
                for part in range(0, len(asking), 20_000):
                    yield shard.answer(asking[part : part + 20_000])

    n_parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the same word may ask a shard by two routes and stands in one batch or two: it is asked once
    dealt = kept.unionByName(asks.dropDuplicates(["shard", "word"])).repartition(n_parts, "shard").sortWithinPartitions("shard", "kind", "word")
    found = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))


def spelling_variants(
    docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, modulus: int = 31, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Group words with their more frequent spellings.

    The words are those of ``word_counts`` with at least ``min_count``
    occurrences.  Two are near if they differ by exactly one inserted, deleted or
    replaced code point.  A word's form is its near word of largest n (ties: the
    smallest in code-point order) if that n is at least ``ratio`` times its own; its root is what
    following forms ends in, the word itself if it has none.

    Returns word, form, root, n, n_near and form_n, one row for each word.  Null and empty texts
    have no words; a null doc_id is hashed as ``null``; repeated rows are
    counted each; an empty table gives an empty result; other columns are ignored.
    """
    words = cut_lineage(word_counts(docs, min_length, modulus, id_col=id_col, text_col=text_col).where(F.col("n") >= min_count))
    formed = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best"))
    table = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), formed.alias("f"))
    table = cut_lineage(table.select("word", "n", "n_near", F.col("f.word").alias("form"), (-F.col("f.n")).alias("form_n")))
    # a form is ``ratio`` times as frequent as its word, so chains are as short as the logarithm of the largest count
    step = table.where("form is not null").select(F.col("word").alias("from"), F.col("form").alias("to"))
    roots = step.select("to").distinct().select("to", F.col("to").alias("root"))
    while True:
        ahead = roots.join(step.withColumnRenamed("to", "next"), F.col("root") == F.col("from"), "left")
        roots = cut_lineage(ahead.select("to", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not roots.where("moved").limit(1).count():
            break
        roots = roots.drop("moved")
    named = table.join(roots.select(F.col("to").alias("form"), "root"), "form", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
