"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put in another order.

Cuts stand between *units*: code points, words or lines.  Where a unit starts is
a predicate on two adjacent bytes (for code points: the second is no UTF-8
continuation byte), so a text falls into chunks that overlap by one byte and
each chunk counts its starts alone, all chunks of a batch at once.  Prefix sums
over a text's chunks say which chunk owns a cut's rank, and only the (at most
two) owning chunks of a text are scanned again for the place.

A map without a shuffle; where a text is cut depends on its id alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes of a chunk, and bytes looked at in one go.
CHUNK, SLAB = 4096, 1 << 22
SENTINELS = ("<P>", "<S>", "<M>")
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

#: unit -> whether one starts at a byte (the second), from the byte before it
STARTS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "char": lambda before, at: (at & 0xC0) != 0x80,
    "word": lambda before, at: SPACE[before] & ~SPACE[at],
    "line": lambda before, at: before == 10,
}

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def chunk_counts(raw: np.ndarray, first: np.ndarray, end: np.ndarray, starts: Callable) -> np.ndarray:
    """How many units start in each chunk raw[first:end].  ``raw`` has one byte
    before the first chunk; chunks lie one behind the other and each sees the byte before it."""
    out = np.zeros(len(first), np.int64)
    some = np.flatnonzero(end > first)
    at = 0
    while at < len(some):  # slabs of whole chunks
        upto = max(at + 1, int(np.searchsorted(end[some], first[some[at]] + SLAB, "right")))
        part = some[at:upto]
        s, e = int(first[part[0]]), int(end[part[-1]])
        flags = starts(raw[s - 1 : e - 1], raw[s:e])
        out[part] = np.add.reduceat(flags, first[part] - s, dtype=np.int64)
        at = upto
    return out


class Cutter:
    """Counts units of texts and finds the byte at which the unit of a rank starts."""

    def __init__(self, texts: pa.Array, unit: str, chunk: int = CHUNK):
        self.starts = STARTS[unit]
        texts = texts.cast(pa.large_binary())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(texts) else np.zeros(0, np.uint8)
        self.raw = np.concatenate([np.array([10], np.uint8), data])  # one byte to stand before the first
        self.begin, self.end = at[:-1] - at[0] + 1, at[1:] - at[0] + 1
        many = -(-(self.end - self.begin) // chunk)
        self.chunk0 = np.concatenate([[0], np.cumsum(many)])
        number = np.arange(self.chunk0[-1]) - np.repeat(self.chunk0[:-1], many)
        self.first = np.repeat(self.begin, many) + number * chunk
        self.stop = np.minimum(self.first + chunk, np.repeat(self.end, many))
        counts = chunk_counts(self.raw, self.first, self.stop, self.starts)
        # a text's first byte starts a unit, whatever the text before it ends with
        head = self.chunk0[:-1][many > 0]
        b = self.begin[many > 0]
        counts[head] += ~self.starts(self.raw[b - 1], self.raw[b])
        self.before = np.concatenate([[0], np.cumsum(counts)])  # units of all chunks before
        self.n = self.before[self.chunk0[1:]] - self.before[self.chunk0[:-1]]

    def place(self, text: int, rank: int) -> int:
        """The byte in the text at which its unit of this rank (from 0) starts; its end for a rank of n."""
        if rank >= self.n[text]:
            return int(self.end[text] - self.begin[text])
        lo, hi = self.chunk0[text], self.chunk0[text + 1]
        rank = rank + int(self.before[lo])
        own = int(np.searchsorted(self.before[lo + 1 : hi + 1], rank, "right") + lo)
        s, e = int(self.first[own]), int(self.stop[own])
        flags = self.starts(self.raw[s - 1 : e - 1], self.raw[s:e])
        if own == lo:
            flags[0] = True
        return s + int(np.flatnonzero(flags)[rank - int(self.before[own])]) - int(self.begin[text])

    def bytes(self, text: int) -> bytes:
        return self.raw[self.begin[text] : self.end[text]].tobytes()


def transform(
    docs: DataFrame,
    seed: str = "1",
    unit: str = "char",
    plain_from: int = 90,
    spm_below: int = 20,
    sentinels: tuple[str, str, str] = SENTINELS,
    chunk: int = CHUNK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Cut every text at two places and put its parts in another order.

    h1 to h4 are the first four 8-digit groups of the hex sha256 of ``seed:id``.
    The text's n units are cut at h1 % (n + 1) and h2 % (n + 1).  It stays
    ``plain`` if it is empty, contains a sentinel, or h3 % 100 >= ``plain_from``;
    otherwise it is ``spm`` (suffix, prefix, middle) if h4 % 100 < ``spm_below``, else ``psm``.

    Returns doc_id, n, form, prefix_chars and middle_chars (units; null if
    plain) and output, one row for each row of ``docs``.  A null text counts as
    empty, a null id is hashed as ``null`` and stays null, repeated rows come out
    each, an empty table gives an empty result, other columns are ignored.
    """
    if unit not in STARTS:
        raise ValueError(f"unit is one of {', '.join(STARTS)}")
    if len(set(sentinels)) < 3 or not all(sentinels) or any(a in b for a in sentinels for b in sentinels if a != b):
        raise ValueError("three sentinels, none of them part of another")
    if any(s[:k] == t[-k:] for s in sentinels for t in sentinels for k in range(1, min(len(s), len(t)) + (s != t))):
        raise ValueError("no sentinel may begin as one ends, so that each is found where it was put")
    p, s, m = (x.encode() for x in sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    hashes = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                cut = Cutter(b.column(1), unit, chunk)
                h1, h2, h3, h4 = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5))
                one, two = h1 % (cut.n + 1), h2 % (cut.n + 1)
                low, high = np.minimum(one, two), np.maximum(one, two)
                form, out = [], []
                for i in range(b.num_rows):
                    t = cut.bytes(i)
                    if not t or h3[i] % 100 >= plain_from or p in t or s in t or m in t:
                        form.append("plain")
                        out.append(t)
                        continue
                    x, y = cut.place(i, int(low[i])), cut.place(i, int(high[i]))
                    form.append("spm" if h4[i] % 100 < spm_below else "psm")
                    out.append(s + t[y:] + p + t[:x] + m + t[x:y] if form[-1] == "spm" else p + t[:x] + s + t[y:] + m + t[x:y])
                plain = np.array([f == "plain" for f in form], bool)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(cut.n), pa.array(form, pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return rows.select("doc_id", "text", *hashes).mapInArrow(run, SCHEMA)


def rebuild(output: bytes, form: str, sentinels: tuple[bytes, bytes, bytes]) -> bytes:
    """The text from its output and form alone."""
    p, s, m = sentinels
    if form == "plain":
        return output
    first, second = (s, p) if form == "spm" else (p, s)
    a, rest = output[len(first) :].split(second, 1)
    b, middle = rest.split(m, 1)
    prefix, suffix = (b, a) if form == "spm" else (a, b)
    return prefix + middle + suffix


def restore(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``made`` (of ``transform``) with a column ``restored``: each text rebuilt from
    output and form.  Null outputs or forms give null; a column of that name is replaced."""
    marks = tuple(x.encode() for x in sentinels)
    kept = [c for c in made.columns if c.lower() != "restored"]
    rows = made.select(*kept)
    o, f = kept.index("output"), kept.index("form")

    def run(batches):
        for b in batches:
            done = [None if x is None or k is None else rebuild(x, k, marks) for x, k in zip(b.column(o).cast(pa.binary()).to_pylist(), b.column(f).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.binary()).cast(pa.string())], names=[*kept, "restored"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("restored", StringType())]))
