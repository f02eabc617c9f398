"""Token counts without token ids, from distinct pre-tokens.

Pieces never cross a pre-token, so a pre-token has the same number of them
wherever it stands.  Pre-tokens never reach past a change from a visible
character to white space, so texts are cut there first, into *units* (white space and
the visible run after it), which is quick.  Then

1. units are counted over all texts, in each task first; the most frequent ones
   (``FREQUENT`` short ones and ``LONG`` long ones: a proven size) fall into pre-tokens, and the
   pieces of each distinct pre-token are counted once and summed for the units,
2. that table is broadcast, and a document's frequencies are summed with it where the document stands,
3. what is left of a document, its rare units, falls into pre-tokens as well;
   (document, pre-token, frequency) rows are shuffled by pre-token, so that each distinct
   one is counted once, and the sums go back to the documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, texts

#: Unicode's White_Space, which is what \s means to the tokenizers library.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"
UNIT = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
#: Units of at most ``SHORT`` bytes that are broadcast, and longer ones of at most ``MOST`` bytes.
FREQUENT, SHORT, LONG, MOST = 1_000_000, 64, 1000, 1 << 16


def _tokenizer(vocabulary: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Splitter:
    """Cuts texts into units; a special string is one token and cuts the text."""

    def __init__(self, vocabulary: str):
        self.special = [t.content for t in _tokenizer(vocabulary).get_added_tokens_decoder().values()]
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def __call__(self, text: str) -> tuple[int, Counter]:
        parts = [text]
        if self.split is not None and any(s in text for s in self.special):
            parts = self.split.split(text)
        units = Counter(UNIT.findall(parts[0]))
        for p in parts[1:]:
            units.update(UNIT.findall(p))
        return len(parts) - 1, units


def _rows(names: list[str], types: list[pa.DataType], values: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)


def frequent_units(docs: DataFrame, vocabulary: str, frequent: int = FREQUENT, max_units: int = 400_000) -> DataFrame:
    """(unit, n): the units that occur most often, ``frequent`` short ones and ``LONG`` long ones at most.

    A task sends the units that it has met twice or more since it last emptied
    its table (at ``max_units``): which ones are broadcast decides where they are summed, not whether."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        split, counts = Splitter(vocabulary), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            units = [u for u, n in counts.items() if n > 1]
            for at in range(0, len(units), 50_000):
                part = units[at : at + 50_000]
                yield _rows(["unit", "n"], [pa.string(), pa.int64()], [part, [counts[u] for u in part]])
            counts.clear()

        for b in batches:
            for text in b.column(0):
                counts.update(split(text.as_py())[1])
                if len(counts) > max_units:
                    yield from flush()
        yield from flush()

    units = cut_lineage(docs.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")))
    size = F.octet_length("unit")
    top = lambda df, k: df.orderBy(F.desc("n"), "unit").limit(k)
    return top(units.where(size <= SHORT), frequent).unionByName(top(units.where((size > SHORT) & (size <= MOST)), min(LONG, frequent)))


def pre_tokens(units: DataFrame, vocabulary: str) -> DataFrame:
    """(unit, piece, k) of (unit): how often each pre-token (in the vocabulary's letters) stands in a unit."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        pre, normal = _tokenizer(vocabulary).pre_tokenizer, _tokenizer(vocabulary).normalizer
        for b in batches:
            unit, piece, k = [], [], []
            for u in b.column(0).to_pylist():
                for p, n in Counter(w for w, _ in pre.pre_tokenize_str(normal.normalize_str(u) if normal else u)).items():
                    unit.append(u)
                    piece.append(p)
                    k.append(n)
            yield _rows(["unit", "piece", "k"], [pa.string(), pa.string(), pa.int64()], [unit, piece, k])

    return units.select("unit").mapInArrow(run, "unit string, piece string, k long")


def pieces(distinct: DataFrame, vocabulary: str) -> DataFrame:
    """(piece, tokens) of (piece): each distinct pre-token is given to the model once."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        model = _tokenizer(vocabulary).model
        for b in batches:
            own = b.column(0).to_pylist()
            yield _rows(["piece", "tokens"], [pa.string(), pa.int64()], [own, [len(model.tokenize(p)) for p in own]])

    return distinct.select("piece").mapInArrow(run, "piece string, tokens long")


def unit_table(units: DataFrame, vocabulary: str) -> DataFrame:
    """(unit, tokens) of distinct units."""
    parts = cut_lineage(pre_tokens(units, vocabulary))
    counted = pieces(parts.select("piece").distinct(), vocabulary)
    return parts.join(counted, "piece").groupBy("unit").agg(F.sum(F.col("k") * F.col("tokens")).alias("tokens"))


def rare_sums(rare: DataFrame, vocabulary: str) -> DataFrame:
    """(row, rest) of (row, piece, n): each distinct pre-token (as text) is counted once, where its rows meet."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        tok, last, tokens = _tokenizer(vocabulary), None, 0
        for b in batches:
            got = []
            for p in b.column(1).to_pylist():
                if p != last:
                    last, tokens = p, sum(len(tok.model.tokenize(w)) for w, _ in tok.pre_tokenizer.pre_tokenize_str(p))
                got.append(tokens)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int64()), b.column(2)], names=["row", "tokens", "n"])

    n = int(rare.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rare.select("row", "piece", "n").repartition(n, "piece").sortWithinPartitions("piece").mapInArrow(run, "row long, tokens long, n long")
    return met.groupBy("row").agg(F.sum(F.col("n") * F.col("tokens")).alias("rest"))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Count the tokens of every text as the tokenizers library does.

    ``vocabulary``: a file of that library (``.json``) whose pre-tokenizer is the
    byte-level one.  Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit
    (n_tokens > limit), one row for each row of ``docs``.  A null text counts as empty (0
    tokens), a null id stays null, repeated rows are counted each, an empty table
    gives an empty result, and other columns are ignored.
    """
    plain = texts(docs, id_col, text_col)
    common = unit_table(cut_lineage(frequent_units(plain, vocabulary, frequent)), vocabulary).toArrow()
    known = plain.sparkSession.sparkContext.broadcast((common.column(0).to_pylist(), common.column(1).to_pylist()))

    def run(batches) -> Iterator[pa.RecordBatch]:
        split, tokens = Splitter(vocabulary), dict(zip(*known.value))
        pre = _tokenizer(vocabulary).pre_tokenizer.pre_tokenize_str
        names = ["doc_id", "n_bytes", "sure", "pieces", "counts", "row"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64()]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                out: list[list] = [[] for _ in names]
                for i, text, row in zip(*(c.to_pylist() for c in b.columns)):
                    sure, units = split(text)
                    rest: Counter = Counter()
                    for u, n in units.items():
                        t = tokens.get(u)
                        if t is not None:
                            sure += t * n
                            continue
                        for _, (s, e) in pre(u):
                            t = tokens.get(u[s:e])
                            if t is None:
                                rest[u[s:e]] += n
                            else:
                                sure += t * n
                    for values, x in zip(out, (i, len(text.encode()), sure, list(rest), list(rest.values()), row)):
                        values.append(x)
                yield _rows(names, types, out)

    # written down, as rows are numbered by their place in a partition
    met = cut_lineage(plain.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "doc_id long, n_bytes long, sure long, pieces array<string>, counts array<long>, row long"))
    rare = met.select("row", F.explode(F.arrays_zip("pieces", "counts")).alias("u")).select("row", F.col("u.pieces").alias("piece"), F.col("u.counts").alias("n"))
    out = met.select("doc_id", "n_bytes", "sure", "row").join(rare_sums(rare, vocabulary), "row", "left").withColumn("n_tokens", F.col("sure") + F.coalesce("rest", F.lit(0)))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
