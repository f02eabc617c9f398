"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fim, license_scan, lm_score, media, mixing, quality, sharding, simhash, spelling, token_counts, warc
from .common import read

QUALITY_VOCABULARY = "piece_bpe_32k.model"
ENCODE_VOCABULARY = "word_bpe_49k.json"
COUNT_VOCABULARY = "byte_bpe_50k.json"
MIX = {"temperature": 0.7, "budget": 1.0, "seed": 17}


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents")).drop("spans")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(read(spark, sf_dir, "documents"), online=True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(read(spark, sf_dir, "documents"), public_tokenizers.path(QUALITY_VOCABULARY))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "chars_per_token", "fallback_share", "token_entropy", "band", F.concat_ws(",", "reasons").alias("reasons"),
    )


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.warc_round_trip(read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(ENCODE_VOCABULARY))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(COUNT_VOCABULARY))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), **MIX)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.histogram_shards(read(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.restore(fim.transform(read(spark, sf_dir, "documents")))
    sha = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sha)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_license_scan, op2_lm_score, op3_quality_rules, op4_warc_bundles, op5_simhash, op6_bpe_round_trip, op7_token_counts, op8_mixing, op9_media_columns, op10_sharding, op11_fill_in_middle, op12_spelling_variants, op13_nearest_neighbours, pipeline]
    return {f.__name__: f for f in named}


OP4_SQL = """
with p as (
  select page_id, coalesce(html, '') as h from pages
), m as (
  select page_id, h, max(page_id) over (partition by h) as last from p
)
select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as payload_digest,
  case when strlen(h) < 1000 or page_id = last then 'response' else 'revisit' end as record_type,
  case when strlen(h) < 1000 or page_id = last then null else last end as refers_to
from m
"""

OP8_SQL = """
with stats as (
  select source, sum(strlen(coalesce(text, '')) + 1)::bigint as bytes from documents group by source
), wants as (
  select source, bytes, pow(bytes::double, 0.7) as want from stats
), rates as (
  select source, round(want / sum(want) over () * sum(bytes) over () / bytes, 6) as rate from wants
), terms as (
  select source, rate, k, exp(-rate + k * ln(rate) - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: ln(j))), 0)) as p
  from rates, range(0, 64) t(k)
), cdf as (
  select source, k, sum(p) over (partition by source order by k) as below from terms
), docs as (
  select d.*, r.rate,
    (('0x' || substr(md5('17|count|' || coalesce(doc_id::varchar, 'null|' || md5(coalesce(text, '')))), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from documents d join rates r on d.source is not distinct from r.source
), counted as (
  select d.*, (select count(*) from cdf c where c.source is not distinct from d.source and c.below <= d.u) as n from docs d
)
select doc_id, text, lang, source, n_chars, rate, n::int as n_copies, i::int as copy,
  substr(md5('17|order|' || coalesce(doc_id::varchar, 'null|' || md5(coalesce(text, ''))) || '|' || i), 1, 16) as mix_key
from counted, range(0, n) t(i)
"""


OP11_SQL = """
with d as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, 'null')) as h from documents
), cut as (
  select *, ('0x' || substr(h, 1, 8))::bigint % (n + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (n + 1) as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= 90 then 'plain'
      when ('0x' || substr(h, 25, 8))::bigint % 100 < 20 then 'spm' else 'psm' end as form
  from d
), parts as (
  select doc_id, n, form, t, least(a, b) as x, greatest(a, b) as y, substr(t, 1, least(a, b)) as pre,
    substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) as mid, substr(t, greatest(a, b) + 1) as suf
  from cut
)
select doc_id, n, form, case when form <> 'plain' then x end as prefix_chars, case when form <> 'plain' then y - x end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from parts
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_bundles": OP4_SQL, "op8_mixing": OP8_SQL, "op11_fill_in_middle": OP11_SQL}
