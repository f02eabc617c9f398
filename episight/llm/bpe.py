"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes decides where a text is cut, so passages that
documents share fall into the same chunks wherever they start.  A chunk's
inside (from its first to its last white space) is encoded once a task and
kept.  What a cut splits, from the last white space before it to the first
one after it, is put together again.  Each join is repaired by re-encoding: a
window that reaches into the chunks on both sides is encoded and compared with
what its parts give; where they differ the window grows, until both agree or
it is the whole text, whose encoding then stands.

The inside of a new chunk is encoded from a dictionary of its white-space
separated words, so a word is given to the tokenizer once a task as well, many
new words in one text.  Its ids are dealt to the words by what they spell; where
they don't spell the words, these are encoded one by one.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import defaultdict
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, per_batch, texts

WINDOW = 16
SPACE = b" \t\n\r\x0b\x0c"
BLANK = bytes.maketrans(SPACE, b" " * len(SPACE))
#: Takes Unicode's white space away, as the tokenizers library knows it.
NO_SPACE = dict.fromkeys([*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: One pseudo-random number for each byte, from a fixed seed: any numbers do, they only place the cuts.
GEAR = np.random.default_rng(1).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(raw: bytes, mean: int) -> list[int]:
    """Offsets after which a chunk ends, about one in ``mean`` bytes (a power
    of two), each a function of the ``WINDOW`` bytes before it."""
    if len(raw) <= WINDOW:
        return []
    h = GEAR[np.frombuffer(raw, np.uint8)]
    step = 1
    while step < WINDOW:  # the sum of 2^j * gear(byte j places before), by doubling
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    hit = np.flatnonzero(h[WINDOW - 1 :] >> np.uint32(32 - mean.bit_length() + 1) == 0) + WINDOW
    return [int(x) for x in hit if x < len(raw)]


def split_chunk(chunk: bytes) -> tuple[bytes, list[bytes], bytes] | None:
    """(before the first white space, words between, after the last); None if there is none."""
    words = chunk.split()
    if not words:
        return (b"", [], b"") if chunk else None
    head = words[0] if chunk[0] not in SPACE else b""
    tail = words[-1] if chunk[-1] not in SPACE else b""
    if len(words) == 1 and head and tail:
        return None
    return head, words[bool(head) : len(words) - bool(tail)], tail


class Codec:
    """Encodes texts to (number of ids, decimal ids joined by a space, decoded text)."""

    def __init__(self, vocabulary: str, mean_chunk: int = 1024, max_words: int = 300_000, max_chunk_bytes: int = 32 << 20, spelled: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(vocabulary)
        self.tok.no_truncation()
        self.tok.no_padding()
        self._check()
        self.names = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.decimal = [str(i) for i in range(len(self.names))]
        self.columns = [pa.array(x, pa.string()) for x in (self.decimal, self.names)]
        self.letter, self.spelled = byte_letters(), spelled
        suffix, byte = self.suffix, defaultdict(lambda: 255, {ord(c): b[0] for c, b in self.letter.items()})  # 255 is in no text
        self.spell = [(t or "").removesuffix(suffix).translate(byte).encode("latin-1") or b"\xff" for t in self.names]
        self.width = np.array([len(x) for x in self.spell])
        self.lowers = self.tok.normalizer is not None and self.tok.normalizer.normalize_str("A") == "a"
        self.agreed: dict[bytes, None] = {}  # windows whose encoding is that of their parts
        self.repaired = self.rejoined = 0  # windows that had to grow; texts that were encoded whole
        self.mean, self.max_words, self.max_bytes = mean_chunk, max_words, max_chunk_bytes
        self.words: dict[bytes, tuple[int, str, str]] = {}
        self.chunks: dict[bytes, tuple | None] = {}
        self.held = 0

    def _check(self) -> None:
        """Refuse vocabularies whose pieces reach across white space, or whose tokens aren't joined by spaces when decoded."""
        if self.tok.decoder is not None:
            raise ValueError("decoding by parts needs a vocabulary without a decoder, whose tokens are joined by spaces")
        for t in self.tok.get_added_tokens_decoder().values():
            if t.lstrip or t.rstrip or t.single_word or t.content.strip() != t.content or len(t.content.split()) > 1:
                raise ValueError(f"the added token {t.content!r} looks at or across white space")
        probes = ["a", "The", "it's", "don", "'t", "12", "3.5", "(x)", "é", "e\u0301", "漢字", "...", "_", "🙂", "<|endoftext|>", "ÀB"]
        alone = {p: self._ids(p) for p in probes}
        for p in probes:
            for q in probes:
                for space in (" ", "\n", "  ", "\t\r\n", " \x0b\x0c "):
                    if self._ids(f"{space}{p}{space}{q}{space}") != alone[p] + alone[q]:
                        raise ValueError("the vocabulary has pieces that reach across white space")

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _spells(self, text: str, ids: list[int]) -> bool:
        """Whether the tokens spell the normalised text, white space apart."""
        normal = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        back = "".join([self.names[i].removesuffix(self.suffix) for i in ids])
        return normal.translate(NO_SPACE).encode() == b"".join([self.letter.get(c) or c.encode() for c in back])

    def _learn(self, new: set[bytes], together: int = 64) -> None:
        raw = list(new)
        words = [w.decode("utf-8", "replace") for w in raw]
        order, ids, widths, alone = [], [], [], []
        texts = [" ".join(words[s : s + together]) for s in range(0, len(words), together)]
        for k, (text, e) in enumerate(zip(texts, self.tok.encode_batch_fast(texts, add_special_tokens=False))):
            group, got = raw[k * together : (k + 1) * together], e.ids
            normal = unicodedata.normalize("NFC", text.lower() if self.lowers else text).encode().split(b" ")
            if len(normal) == len(group) and all(normal) and b"".join([self.spell[i] for i in got]) == b"".join(normal):
                order += group
                ids += got
                widths += map(len, normal)
            else:
                alone += group
        reach, ends = np.cumsum(self.width[np.array(ids, np.int64)]), np.cumsum(widths)
        last = np.searchsorted(reach, ends)  # the id with which each word ends
        sizes = np.diff(last, prepend=-1).tolist()
        if not np.array_equal(reach[last], ends):
            order, ids, sizes, alone = [], [], [], raw
        for e in self.tok.encode_batch_fast([w.decode("utf-8", "replace") for w in alone], add_special_tokens=False):
            ids += e.ids
            sizes.append(len(e.ids))
        start = np.cumsum([0, *sizes])
        order += alone
        flat = pa.array(ids, pa.int64())
        lists = [pa.ListArray.from_arrays(start.astype(np.int32), c.take(flat)) for c in self.columns]
        spelled = [pc.binary_join(x, " ").to_numpy(zero_copy_only=False).tolist() for x in lists]
        same = [True] * len(order)
        if self.spelled:
            at = start.tolist()
            same = [self._spells(w.decode("utf-8", "replace"), ids[a:b]) for w, a, b in zip(order, at, at[1:])]
        self.words.update(zip(order, zip(sizes, *spelled, same)))

    @property
    def suffix(self) -> str:
        return self.tok.model.end_of_word_suffix or "\0"

    def _window(self, raw: bytes, start: int, end: int, reach: int) -> bytes:
        """The bytes from some word before ``start`` to some word after ``end``, with at most ``reach`` bytes on each side."""
        left, right = raw[max(0, start - reach) : start].translate(BLANK), raw[end : end + reach].translate(BLANK)
        first, last = start - len(left), end + len(right)
        if first:  # from the first white space on
            at = left.find(b" ")
            first = start if at < 0 else first + at
        if last < len(raw):
            last = end + right.rfind(b" ") + 1
        return raw[first:last]

    def _repair(self, batch: list[bytes], joins: list[tuple[int, int, int]], reach: int = 14) -> set[int]:
        """Re-encode around each join (text, start, end), wider and wider, until
        it agrees with its parts; the texts where it never does."""
        whole_texts: set[int] = set()
        while joins:
            windows = [self._window(batch[k], start, end, reach) for k, start, end in joins]
            parts = {w: w.split() for w in windows if w not in self.agreed}
            self._learn({x for ws in parts.values() for x in ws if x not in self.words})
            bad = set()
            for (whole, ws), e in zip(parts.items(), self.tok.encode_batch_fast([w.decode("utf-8", "replace") for w in parts], add_special_tokens=False)):
                if " ".join([self.decimal[i] for i in e.ids]) == " ".join([x[1] for x in map(self.words.__getitem__, ws) if x[0]]):
                    self.agreed[whole] = None
                else:
                    bad.add(whole)
            if not bad:
                break
            joins = [j for j, w in zip(joins, windows) if w in bad]
            whole_texts |= {k for k, _, _ in joins if reach >= len(batch[k])}
            joins = [j for j in joins if j[0] not in whole_texts]
            self.repaired += len(joins)
            reach *= 2
        return whole_texts

    def _join(self, words: list[bytes]) -> tuple[int, str, str, bool]:
        return joined(map(self.words.__getitem__, words))

    def encode(self, batch: list[bytes]) -> list[tuple[int, str, str, bool]]:
        """For each text its number of ids, the ids and the token names, both
        joined by spaces, and if asked whether the tokens spell the normalised text (but for white space)."""
        # the oldest go first; what is needed again is encoded again
        if self.held > self.max_bytes:
            for chunk in list(islice(self.chunks, len(self.chunks) // 2)):
                del self.chunks[chunk]
                self.held -= 4 * len(chunk) + 300
        if len(self.agreed) > self.max_words:
            self.agreed.clear()
        joins: list[tuple[int, int, int]] = []
        plans, need, fresh = [], set(), {}
        for k, raw in enumerate(batch):
            plan, rest = [], b""  # chunks and joins in order; rest: what stands since the last white space
            at = 0
            for end in [*cuts(raw, self.mean), len(raw)]:
                chunk = raw[at:end]
                at = end
                if chunk in self.chunks:
                    parts = self.chunks[chunk]
                else:
                    parts = fresh[chunk] if chunk in fresh else fresh.setdefault(chunk, split_chunk(chunk))
                if parts is None:
                    rest += chunk
                    continue
                if rest or parts[0]:
                    plan.append((rest + parts[0], None))
                    need.add(rest + parts[0])
                if end > len(chunk):  # what the cut before this chunk has split, or the cut alone
                    joins.append((k, end - len(chunk) - len(rest), end - len(chunk) + len(parts[0])))
                plan.append((None, chunk))
                rest = parts[2]
            if rest:
                plan.append((rest, None))
                need.add(rest)
                if len(rest) < len(raw):
                    joins.append((k, len(raw) - len(rest), len(raw)))
            plans.append(plan)
        for parts in fresh.values():
            if parts is not None:
                need.update(parts[1])
        if len(self.words) > self.max_words:
            for w in list(islice(self.words, len(self.words) - self.max_words * 3 // 4)):
                x = self.words.pop(w)
                if w in need:
                    self.words[w] = x
        self._learn(need.difference(self.words))
        for chunk, parts in fresh.items():
            self.chunks[chunk] = None if parts is None else (parts[0], self._join(parts[1]), parts[2])
            self.held += 4 * len(chunk) + 300
        out = [joined(self.words[w] if c is None else self.chunks[c][1] for w, c in plan) for plan in plans]
        for k in self._repair(batch, joins):
            self.rejoined += 1
            text = batch[k].decode("utf-8", "replace")
            ids = self._ids(text)
            out[k] = (len(ids), " ".join([self.decimal[i] for i in ids]), " ".join([self.names[i] for i in ids]), not self.spelled or self._spells(text, ids))
        return out


def joined(parts) -> tuple[int, str, str, bool]:
    """Encodings one after another; those without ids only count for the last figure."""
    n, ids, names, same = list(zip(*parts)) or [()] * 4
    if 0 in n:
        ids, names = [x for x, k in zip(ids, n) if k], [x for x, k in zip(names, n) if k]
    return sum(n), " ".join(ids), " ".join(names), all(same)


def byte_letters() -> dict[str, bytes]:
    """The byte that each letter of a byte-level vocabulary stands for: printable
    ones stand for themselves, the others for those from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): bytes([b]) for b in plain} | {chr(256 + k): bytes([b]) for k, b in enumerate(rest)}


def decode_ids(df: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with a column ``decoded``: the tokens of ``ids_col`` (array of int)
    as the tokenizers library decodes them, special ones included.

    A null array gives a null, an empty one an empty text; an id that the
    vocabulary doesn't have is left out; a column named decoded is replaced.
    """

    def make() -> Callable:
        codec = Codec(vocabulary)
        known = len(codec.names)

        def work(ids) -> dict[str, list]:
            return {"decoded": [None if x is None else " ".join([codec.names[i] for i in x if i is not None and 0 <= i < known and codec.names[i] is not None]) for x in ids.to_pylist()]}

        return work

    return beside(df, F.col(ids_col), make, "decoded string")


def encode_beside(docs: DataFrame, vocabulary: str, text_col: str = "text", mean_chunk: int = 1024) -> DataFrame:
    """All columns of ``docs`` with n_tokens, ids (array of int), ids_sha256,
    decoded_sha256 and round_trips (whether the tokens spell the normalised text,
    white space apart).  Own names win over clashing columns; a null text counts as empty."""

    def make() -> Callable:
        codec = Codec(vocabulary, mean_chunk, max_words=100_000, max_chunk_bytes=16 << 20, spelled=True)

        def work(column) -> dict[str, list]:
            out = {"n_tokens": [], "ids_text": [], "ids_sha256": [], "decoded_sha256": [], "round_trips": []}
            raw = column.to_pylist()
            for at in range(0, len(raw), 250):
                for row in codec.encode(raw[at : at + 250]):
                    for values, x in zip(out.values(), (row[0], row[1], hashlib.sha256(row[1].encode()).hexdigest(), hashlib.sha256(row[2].encode()).hexdigest(), row[3])):
                        values.append(x)
            return out

        return work

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    out = beside(docs, text, make, "n_tokens long, ids_text string, ids_sha256 string, decoded_sha256 string, round_trips boolean", hides=("ids",))
    ids = F.when(F.col("n_tokens") > 0, F.split("ids_text", " ").cast("array<int>")).otherwise(F.array().cast("array<int>"))
    return out.withColumn("ids", ids).drop("ids_text")


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, mean_chunk: int = 1024) -> DataFrame:
    """Encode every text and decode it again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one
    space), decoded_sha256 (of the decoded text), and with ``keep`` also ids
    (array of int) and decoded; one row for each row of ``docs``, without a
    shuffle.  A null text counts as empty (0 tokens, the digest of nothing), a
    null id stays null, repeated rows come out each, an empty table gives an
    empty result, and other columns are ignored.
    """

    def make() -> Callable:
        codec = Codec(vocabulary, mean_chunk)

        def work(ids: list, raw: list[bytes]) -> dict[str, list]:
            got = codec.encode(raw)
            return {
                "doc_id": ids,
                "n_tokens": [x[0] for x in got],
                "ids_sha256": [hashlib.sha256(x[1].encode()).hexdigest() for x in got],
                "decoded_sha256": [hashlib.sha256(x[2].encode()).hexdigest() for x in got],
                "ids": [[int(i) for i in x[1].split()] for x in got] if keep else [],
                "decoded": [x[2] for x in got] if keep else [],
            }

        return work

    return per_batch(texts(docs, id_col, text_col), make, SCHEMA + ", ids array<int>, decoded string" * keep, rows=500)
