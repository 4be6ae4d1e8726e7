"""Exact deduplication with salted combining; built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicalens.session import materialize


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), t.alias("content"), F.sha2(t, 256).alias("digest"))


def _combined(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, content, keep_id, group_size). Copies meet first inside each map task, then per (digest, salt), then per digest; the whole
    content is part of the key each time. The salt spreads a group's copies over ``salts`` tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    merged = salted.groupBy("digest", "content", "salt").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return merged.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row; rows with identical text are a group.

    The row with the largest doc_id of a group stays. Null text counts as empty. A null doc_id stays only in a group without other ids.
    Rows that repeat the winning doc_id are one document and all marked kept. An empty table gives no rows. Other columns are not read.

    Groups are formed by whole content. Rows then find their group by digest, which is exact for every digest that was seen with one content only; a
    digest with several contents is looked up by content too.
    """
    rows = _rows(docs, doc_id, text)
    winners = materialize(_combined(rows, salts).drop("content"), "exact-winners")
    shared = winners.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("digest")
    found = rows.select("doc_id", "digest").join(winners, "digest")
    if not shared.isEmpty():
        several = _combined(rows.join(shared, "digest", "left_semi"), salts)
        found = rows.select("doc_id", "digest").join(winners.join(shared, "digest", "left_anti"), "digest").unionByName(
            rows.join(several, ["digest", "content"]).drop("content"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each group one row with the largest doc_id. Columns may have any names."""
    winners = exact_groups(docs, doc_id, text, salts).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("keep")).distinct()
    content = F.coalesce(F.col(text), F.lit(""))
    marked = docs.select(F.sha2(content, 256).alias("digest"), F.col(doc_id).alias("own"), F.xxhash64(content).alias("hash"), F.octet_length(content).alias("bytes"),
                         F.struct(*docs.columns).alias("row"))
    kept = marked.join(winners, F.col("own").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("keep")))
    # What is left to drop are repeats of one document's row: same id, digest, second hash and length.
    return kept.dropDuplicates(["digest", "id", "hash", "bytes"]).select("row.*")
