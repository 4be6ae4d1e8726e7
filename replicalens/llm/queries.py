"""Registered queries of this subpackage, with oracles where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replicalens.llm import alignment, classifier, exact, jaccard, kneser_ney, lexical, mixing, packing, repetition, secret_scan, sharding, simhash, substring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(spark, sf_dir.rstrip("/"))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2, segments=2)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096, remember=2_500_000)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op5_repetition")
def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


@query("op6_site_classifier")
def op6_site_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return classifier.assess(docs, table(spark, sf_dir, "labels")).select("doc_id", "assessment.*")


OP7_SQL = """
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, '')) as h
  from documents),
sources as (select source, sum(size)::bigint as source_size from docs group by source),
weighted as (
  select *, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w
  from sources),
ratios as (
  select *, 2.0::double * source_size as cap, coalesce(sum(2.0::double * source_size) over before, 0) as capped, sum(w) over rest as open
  from weighted
  window before as (order by source_size / w, source is null, source rows between unbounded preceding and 1 preceding),
         rest as (order by source_size / w, source is null, source rows between current row and unbounded following)),
level as (
  select coalesce(arg_min(l, cap / w) filter (l * w <= cap), max(l)) as l
  from (select *, (1.5::double * (select sum(size) from docs) - capped) / open as l from ratios)),
targets as (
  select source, source_size, case when source_size = 0 then 0 else least(w * l, 2.0::double * source_size) end as target from weighted, level),
summed as (
  select d.doc_id, d.size, t.source_size, t.target, case when t.source_size = 0 then 0 else floor(t.target / t.source_size) end as whole,
         coalesce(sum(d.size) over (partition by d.source order by h, d.size rows between unbounded preceding and 1 preceding), 0) as before
  from docs d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (size * (whole + case when size > 0 and before + size / 2 <= target - whole * source_size then 1 else 0 end))::bigint as taken
from summed
"""


@query("op7_mixing", OP7_SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id is not distinct from max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""


@query("op8_exact_dedup", OP8_SQL)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query("op9_kneser_ney")
def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kneser_ney.score(docs, kneser_ney.train(docs))


@query("op10_secret_ledger")
def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_versions(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE]
    return found.select(
        F.col("path").alias("doc_id"), *[secret_scan.counted(F.col("findings"), k).alias(f"n_{k}") for k in base],
        F.sha2(secret_scan.spelled(F.col("findings"), base), 256).alias("base_sha256"), secret_scan.spelled(F.col("findings")).alias("spans"))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = alignment.count_pairs(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return alignment.aligned(docs, counts).withColumn("groups_sha256", digest).drop("groups")


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
with docs as (select row_number() over () as d, doc_id, {_TERMS} as terms from documents where text is not null),
sizes as (select d, doc_id, len(terms)::bigint as n from docs where len(terms) > 0),
totals as (select count(*)::bigint as documents, sum(n)::bigint as tokens from sizes),
counts as (select d, term, count(*)::bigint as tf from (select d, unnest(terms) as term from docs) group by d, term),
weights as (select term, floor(1000 * ln((2 * any_value(documents) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from counts, totals group by term),
asked as (select i, item_id, unnest(list_distinct({_TERMS})) as term from (select row_number() over () as i, item_id, text from benchmark where text is not null)),
scores as (
  select i, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * documents) // tokens))))::bigint as score
  from asked join counts using (term) join weights using (term) join sizes using (d), totals group by i, item_id, d, doc_id)
select item_id, rank, doc_id, score from (
  select *, (row_number() over (partition by i order by score desc, doc_id nulls last))::int as rank from scores where score > 0) where rank <= 10
"""


@query("op11_lexical_search", OP11_SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query("op12_jaccard_join")
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), width=4, percent=85)
