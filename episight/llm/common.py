"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage, shared_dir  # noqa: F401

#: Keys with at least this share of all rows count as hot.  There can be at
#: most ``HOT_PARTS`` of them, however large the input, so a table of the hot
#: keys has a proven size and may be broadcast.
HOT_PARTS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns are pruned."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def give_back() -> None:
    """Memory that is free goes back to the system, as far as its libraries let it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches.  Its worker waits for further tasks then, so what it has freed is given back."""

    def tidy(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidy


def per_batch(
    df: DataFrame, make: Callable[[], Callable[[list, list[bytes]], dict[str, list]]], schema: str, rows: int = 2000
) -> DataFrame:
    """Run ``make()(ids, texts as UTF-8)`` over (doc_id, text) batches.

    ``make`` is called once a task, so what it builds (automata, caches) is
    shared by the task's batches; a batch has at most ``rows`` documents.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(struct)
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                got = work(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, struct)


def beside(df: DataFrame, value, make: Callable[[], Callable[[pa.Array], dict[str, list]]], schema: str, hides: tuple[str, ...] = (), rows: int = 500) -> DataFrame:
    """All columns of ``df`` and those of ``schema``, which ``make()(values)``
    gives for each batch (of at most ``rows``) of the column ``value``; new names, and those in
    ``hides``, win over clashing columns."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = _parse_datatype_string(schema)
    new = {f.name.lower() for f in struct} | set(hides)
    packed = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in df.columns if c.lower() not in new]).alias("row"), value.alias("value"))
    all_ = StructType([StructField("row", packed.schema["row"].dataType), *struct.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(all_)
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                got = work(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(out.field(0).type), *[pa.array(got[f.name], f.type) for f in list(out)[1:]]], schema=out)

    return packed.mapInArrow(tidied(run), all_).select("row.*", *struct.names).drop("_")


def join_skewed(left: DataFrame, right: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join ``left`` with ``right``, whose ``on`` is unique and whose column
    ``n`` says how many rows of ``left`` have that key (the rows of ``left``
    are counted from it, so ``n`` must be there for each key of ``left`` that
    occurs more than once in a thousand rows).

    The rows of hot keys meet a broadcast of at most ``HOT_PARTS`` rows and
    stay where they are; the rest is shuffled, and no key there has more than
    a thousandth of the rows.  Null keys match nothing; for a left join their
    rows stay where they are.
    """
    if how == "left":
        none = right.drop("n", on).schema.fields
        bare = left.where(F.col(on).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in none])
        return join_skewed(left.where(F.col(on).isNotNull()), right.where(F.col(on).isNotNull()), on, "keyed left").select(bare.columns).unionByName(bare)
    how = how.removeprefix("keyed ")
    total = right.agg(F.sum("n")).first()[0] or 0
    hot = right.where((F.col("n") * HOT_PARTS >= total) & (F.col("n") > 1))
    keys = [r[0] for r in hot.select(on).collect()]
    if not keys:
        return left.join(right.drop("n"), on, how)
    # isin on at most HOT_PARTS literals; null keys match nothing and go with the rest
    is_hot = F.coalesce(F.col(on).isin(keys), F.lit(False))
    some = left.where(is_hot).join(F.broadcast(hot.drop("n")), on, how)
    rest = left.where(~is_hot).join(right.where(~is_hot).drop("n"), on, how)
    return some.unionByName(rest)


#: A pseudo-random number for each byte, from a fixed seed.
BYTE = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes of binary values, from their bytes and places."""
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    width = np.diff(at)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(words) else np.zeros(0, np.uint8)
    power = np.cumprod(np.full(int(width.max(initial=0)) + 1, 0x5851F42D4C957F2D, np.uint64), dtype=np.uint64)
    place = np.arange(len(raw)) - np.repeat(at[:-1] - at[0] if len(words) else at[:0], width)
    run = np.concatenate([[np.uint64(0)], np.cumsum((BYTE[raw] ^ power[place]) * power[place], dtype=np.uint64)])
    x = (run[at[1:] - at[0]] - run[at[:-1] - at[0]] + width.astype(np.uint64)) * ODD if len(words) else np.zeros(0, np.uint64)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


class Words:
    """Numbers for words, in the order in which they are met, and their hashes; number 0 is the empty word."""

    def __init__(self):
        self.all = pa.array([b""], pa.large_binary())
        self.hash = hash_words(self.all)
        self.known = 1

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Word numbers of the texts one after another, each with its end (the
        empty word); how many each text has; and the words that are new.

        Only A-Z change and only ASCII white space splits.
        """
        import pyarrow.compute as pc

        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.take(pa.array(np.arange(len(texts))))))  # a copy: slices keep an offset
        size = np.diff(parts.offsets.to_numpy())
        coded = pc.dictionary_encode(parts.flatten())
        words = coded.dictionary.cast(pa.large_binary())
        own = pc.index_in(words, value_set=self.all)
        new = words.filter(own.is_null())
        number = own.fill_null(0).to_numpy().astype(np.int64)
        number[own.is_null().to_numpy(zero_copy_only=False)] = self.known + np.arange(len(new))
        flat = number[coded.indices.to_numpy()]
        if len(new):
            self.all = pa.concat_arrays([self.all, new])
            self.hash = np.concatenate([self.hash, hash_words(new)])
            self.known += len(new)
        # white space at either side of a text, and a text without words, give empty words: all go, then one end a text
        text = np.repeat(np.arange(len(size)), size)
        real = flat != 0
        size = np.bincount(text[real], minlength=len(size)) + 1
        out = np.zeros(int(size.sum()), np.int64)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(size) - 1] = False
        out[keep] = flat[real]
        return out, size, new
