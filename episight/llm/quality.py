"""Quality rules from a tokenizer's view of a text.

A public vocabulary is spent on ordinary text at a steady rate: so many
characters a token, hardly any byte fall-back, tokens spread over many ids.
Text far from that is broken: repeated, shouted, strewn with symbols, or in an
encoding that the vocabulary doesn't know.  Beside these figures stand the
plain counts (short texts, repeated five-word windows, repeated lines).

A word is tokenised once a task: pieces don't span words, so a document's
figures are sums over its words.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from types import MappingProxyType

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\r\x0b\x0c"
WINDOW = 5


@dataclass(frozen=True)
class Band:
    """A text is kept if each figure lies in its band.

    The entropy band grows with the text only as far as a language's own
    entropy lets it: ``min_entropy_share`` is a share of log2(number of tokens),
    the most that so many tokens can have, and of ``full_entropy`` bits at most.
    """

    min_chars: float = 1.2
    max_chars: float = 8.0
    max_fallback: float = 0.15
    min_entropy_share: float = 0.45
    full_entropy: float = 12.0
    max_symbols: float = 0.25


#: For Latin script in general, for languages with their own figures, and for
#: scripts that the vocabulary covers by few pieces or by bytes only, whose
#: tokens are letters or bytes and so have less entropy at any length.
BANDS: Mapping[str, Band] = {
    "latin": Band(),
    "en": Band(min_chars=1.4),
    "de": Band(min_chars=1.3),
    "fr": Band(min_chars=1.2),
    "es": Band(min_chars=1.3),
    "cyrillic": Band(min_chars=0.9, max_fallback=0.2, full_entropy=8.0),
    "cjk": Band(min_chars=0.25, max_chars=3.0, max_fallback=0.95, full_entropy=9.0),
    "other": Band(min_chars=0.2, max_fallback=0.98, full_entropy=8.8),
}


def script(n_chars: int, n_bytes: int, text: str) -> str:
    """The script of most letters beyond ASCII, or latin."""
    if n_bytes < 1.5 * n_chars:
        return "latin"
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    n = {
        "latin": ((code >= 0x41) & (code < 0x250)).sum(),
        "cyrillic": ((code >= 0x400) & (code < 0x530)).sum(),
        "cjk": ((code >= 0x2E80) & (code < 0xA000) | (code >= 0xAC00) & (code < 0xD7B0)).sum(),
    }
    n["other"] = (code >= 0x250).sum() - n["cyrillic"] - n["cjk"]
    return max(n, key=n.get)


def repeated_window_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the
    first occurrence included.  ``ids``: the words as numbers from 0."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    k = int(ids.max()) + 1
    if k == len(ids):  # no word occurs twice, so no window does
        return 0
    bits = max(1, (k - 1).bit_length())
    if bits * width <= 64:
        key = np.zeros(n, np.uint64)
        for j in range(width):
            key = (key << np.uint64(bits)) | ids[j : n + j].astype(np.uint64)
    else:  # pairs as numbers, then pairs of pairs, so that equal keys mean equal windows
        key = ids[:n].astype(np.int64)
        for j in range(1, width):
            key = np.unique(key * k + ids[j : n + j], return_inverse=True)[1].astype(np.int64)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(n + width, np.int32)
    np.add.at(step, np.flatnonzero(twice), 1)
    np.add.at(step, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(step) > 0).sum())


def repeated_lines(text: str) -> int:
    """\\n-split lines that hold a word and equal an earlier line."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip(SPACE)]
    return len(lines) - len(set(lines))


class Fertility:
    """Words to pieces: a growing table of distinct words, of bounded size."""

    def __init__(self, vocabulary: str, max_words: int = 600_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.max_words = max_words
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.vocab_size())])
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.n_ids = 0
        self.start = np.zeros(1, np.int64)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]
        if not new:
            return
        pieces = self.sp.encode(new, num_threads=1)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        flat = np.fromiter((i for p in pieces for i in p), np.int32)
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        ends = self.n_ids + np.cumsum([len(p) for p in pieces], dtype=np.int64)
        self.start = np.concatenate([self.start, ends])
        self.n_ids += len(flat)

    def pieces(self, at: np.ndarray) -> np.ndarray:
        """The piece ids of words, in order."""
        first, size = self.start[at], self.start[at + 1] - self.start[at]
        if not len(at):
            return np.empty(0, np.int32)
        before = np.cumsum(size) - size
        return self.ids[np.repeat(first - before, size) + np.arange(int(size.sum()))]


def figures(fert: Fertility, batch: list[str]) -> list[tuple]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_tokens,
    n_fallback, entropy, script) of each text."""
    if len(fert.index) > fert.max_words:
        fert.clear()
    split = [[w.decode("utf-8", "replace") for w in t.encode("utf-8", "replace").split()] for t in batch]
    fert.learn(set().union(*split) if split else set())
    out = []
    for text, words in zip(batch, split):
        at = np.fromiter(map(fert.index.__getitem__, words), np.int64, len(words))
        chars = len(text) - sum(map(text.count, SPACE))
        symbols = sum(map(text.count, SYMBOLS))
        own = np.unique(at, return_inverse=True)[1] if len(at) else at
        ids = np.sort(fert.pieces(at))
        n = len(ids)
        entropy = 0.0
        if n:
            edge = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            count = np.diff(np.append(edge, n))
            entropy = float(np.log2(n) - (count * np.log2(count)).sum() / n)
        out.append(
            (len(words), chars, symbols, repeated_lines(text), repeated_window_words(own), n, int(fert.is_byte[ids].sum()), max(0.0, entropy), script(len(text), len(text.encode("utf-8", "replace")), text))
        )
    return out


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, n_fallback long, token_entropy double, script string"
)


def quality_figures(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", carry: Mapping[str, str] = MappingProxyType({})) -> DataFrame:
    """The figures of every text; ``carry`` has the names of string columns to keep, by the names that they get."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(f"`{c}`").cast("string").alias(name) for name, c in carry.items()])

    def run(batches):
        import pyarrow as pa

        fert = Fertility(vocabulary)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                got = list(zip(*figures(fert, b.column(1).to_pylist()))) or [()] * 9
                kinds = [pa.int64()] * 7 + [pa.float64(), pa.string()]
                cols = [b.column(0).cast(pa.int64()), *[pa.array(x, k) for x, k in zip(got, kinds)], *[b.column(2 + j).cast(pa.string()) for j in range(len(carry))]]
                yield pa.RecordBatch.from_arrays(cols, names=[*NAMES, *carry])

    return base.mapInArrow(run, SCHEMA + "".join(f", `{c}` string" for c in carry))


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def verdicts(figs: DataFrame, bands: Mapping[str, Band] = BANDS, lang_col: str | None = None) -> DataFrame:
    """Add chars_per_token, fallback_share, band, reasons, base_failed, kept.

    A language with a band of its own counts if the text's script is Latin;
    else the script's band holds.
    """
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    band = F.col("script")
    if lang_col:
        band = F.when((band == "latin") & F.col(lang_col).isin(*bands), F.col(lang_col)).otherwise(band)

    def of(field: str):
        out = F.lit(getattr(bands["other"], field))
        for k, b in bands.items():
            out = F.when(F.col("band") == k, F.lit(getattr(b, field))).otherwise(out)
        return out

    df = figs.withColumns({"chars_per_token": F.col("word_chars") / n, "fallback_share": F.col("n_fallback") / n, "band": band})
    tests = {
        "chars_per_token": (F.col("chars_per_token") < of("min_chars")) | (F.col("chars_per_token") > of("max_chars")),
        "byte_fallback": F.col("fallback_share") > of("max_fallback"),
        "token_entropy": F.col("token_entropy") < of("min_entropy_share") * F.least(F.log2(n.cast("double")), of("full_entropy")),
        "symbols": F.col("n_symbols") > of("max_symbols") * F.col("word_chars"),
    }
    df = df.withColumn("reasons", F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()])))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))


def quality_rules(docs: DataFrame, vocabulary: str, bands: Mapping[str, Band] = BANDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Judge every text; one row for each row of ``docs``, without a shuffle.

    Null and empty texts have no words and fail the base rule.  A null id or
    language is kept as null (the script's band then holds).  Repeated rows
    are judged each; an empty table gives an empty result; other columns are
    ignored.
    """
    lang = lang_col if lang_col in docs.columns else None
    figs = quality_figures(docs, vocabulary, id_col, text_col, {"doc_lang": lang} if lang else {})
    return verdicts(figs, bands, "doc_lang" if lang else None)


def keep_good(docs: DataFrame, vocabulary: str, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns.

    The verdict is computed next to the row, so nothing is joined and rows
    with equal or null ids are judged each on its own.
    """
    figs = figs_iterator(vocabulary)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), lang.alias("doc_lang"), figs(F.coalesce(F.col("text"), F.lit(""))).alias("f"))
    judged = judged.select("row", "doc_lang", "f.*")
    return verdicts(judged, bands, "doc_lang").where("kept").select("row.*")


def figs_iterator(vocabulary: str):
    """The figures as a struct column, from a vectorised function over texts."""
    from pyspark.sql.functions import pandas_udf

    def read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fert = Fertility(vocabulary, max_words=200_000)
        for s in parts:
            got = [x for i in range(0, len(s), 250) for x in figures(fert, s.iloc[i : i + 250].tolist())]
            yield pd.DataFrame(got, columns=NAMES[1:])

    @pandas_udf(SCHEMA.split(", ", 1)[1])
    def figs(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidied(read)(parts)

    return figs
