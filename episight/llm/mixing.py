"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its share of the wanted mix over its
share of the bytes.  A document's number of copies is the inverse of the
Poisson distribution with that mean at a uniform number hashed from its id and
a seed, so it doesn't hang on partitions, order or retries.  The copies are
dealt out by a hash of id and copy number, which is a global shuffle.

Only DataFrame functions; the uniform numbers come from MD5, as any SQL engine
has it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: A table of sources is broadcast only up to this many rows, which are counted first.
MAX_BROADCAST_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double")
    return (h + 0.5) / F.lit(float(2**52))


def poisson_table(rate: Column) -> Column:
    """The cumulative Poisson distribution with mean ``rate`` from 0 up to
    where the rest is below 2^-52, as an array.

    The logarithm of each term comes from the one before, so no mean is too
    large for it.
    """
    top = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(a: Column, k: Column) -> Column:
        log = a["log"] + F.log(rate) - F.log(k.cast("double"))
        total = a["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(a["all"], F.array(total)).alias("all"))

    table = F.aggregate(F.sequence(F.lit(1), top), start, step)["all"]
    return F.when(rate > 0, table).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, temperature: float, budget: float, source_col: str, text_col: str) -> DataFrame:
    """(source, rate): mean copies of each source's documents.

    ``weights``: wanted shares (any scale; sources that it leaves out get 0).
    Without it the shares go as bytes to the power ``temperature``.  ``budget``:
    bytes wanted over bytes there are.  The bytes are summed before the shuffle.
    """
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1
    stats = cut_lineage(docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size.cast("long")).alias("bytes")))
    if weights is None:
        want = F.pow(F.col("bytes").cast("double"), F.lit(float(temperature)))
    else:
        want = F.lit(0.0)
        for name, w in sorted(weights.items()):
            want = F.when(F.col("source") == name, F.lit(float(w))).otherwise(want)
    stats = stats.withColumn("want", want)
    wants, total = stats.agg(F.sum("want"), F.sum("bytes")).first()  # two numbers
    rate = F.col("want") / F.lit(wants) * F.lit(total) * F.lit(float(budget)) / F.col("bytes")
    return stats.select("source", F.coalesce(F.round(rate, 6), F.lit(0.0)).alias("rate"))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.7,
    budget: float = 1.0,
    seed: int = 17,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
    extras: bool = True,
) -> DataFrame:
    """Replicate the rows of ``docs`` to the wanted mix and shuffle them.

    Returns all columns of ``docs`` and, with ``extras``, rate, n_copies, copy
    (from 0) and mix_key: rows are dealt to partitions by its hash and stand in
    its order there.  Own names win over clashing columns.  A null source is a source of its own, a
    null text has one byte, a row without an id is hashed by its text; rows with equal ids
    get equal numbers of copies; an empty table gives an empty result.
    """
    rates = source_rates(docs, weights, temperature, budget, source_col, text_col)
    few = rates.count() <= MAX_BROADCAST_SOURCES
    rates = rates.select("source", "rate", poisson_table(F.col("rate")).alias("table"))
    own = {"rate", "n_copies", "copy", "mix_key"}
    names = [c for c in docs.columns if not extras or c.lower() not in own]
    ident = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null|"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(source_col).alias("from"), ident.alias("ident"))
    rows = rows.join(F.broadcast(rates) if few else rates, F.col("from").eqNullSafe(F.col("source")), "left")
    rows = rows.withColumn("u", uniform(F.lit(str(seed)), F.lit("count"), F.col("ident")))
    rows = rows.withColumn("n_copies", F.size(F.filter("table", lambda c: c <= F.col("u"))))
    copies = rows.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), F.col("ident"), F.col("copy").cast("string")))
    copies = copies.select("row", "rate", "n_copies", "copy", F.substring(key, 1, 16).alias("mix_key"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = copies.repartition(n, "mix_key").sortWithinPartitions("mix_key")
    return dealt.select("row.*", "rate", "n_copies", "copy", "mix_key") if extras else dealt.select("row.*")
