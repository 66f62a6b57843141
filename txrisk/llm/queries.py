"""The queries of this subpackage, each over whole tables, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm import (
    conversations,
    factorisation,
    licenses,
    mixing,
    negatives,
    neighbours,
    pieces,
    quality,
    sharding,
    simhash,
    suffixes,
    tree_weighting,
    warc,
)
from txrisk.session import apply_sql_settings

# Where the public tokenizers' files are.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return apply_sql_settings(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op3_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_weighting.score(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.STATISTICS, "base_failed", "kept")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), PIECE_MODEL)


# Records of which the replica has bit rot: one in 256, by the digest of the id.
DAMAGED = "substring(md5(cast(page_id as string)), 1, 2) = '00'"


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.in_order(_table(spark, sf_dir, "pages"))
    records = pages.select("position", "page_id", warc.record().alias("record"))
    replica = warc.with_bit_rot(records, F.expr(DAMAGED))
    found = warc.audit(warc.manifest(records), warc.manifest(replica))
    return found.join(pages.select("position", "page_id"), "position").select(
        "page_id", "position", "file", "start", "end", "expected", "found"
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op11_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return factorisation.judge(docs, labels)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations")
    return conversations.with_all(conversations.repair(conversations.damage(table)), table)


# Rows whose label is moved on by one before the search.
RELABELLED = "if(vec_id % 7 = 0, (label + 1) % 10, label)"


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings").withColumn("label", F.expr(RELABELLED))
    return negatives.mine(table, F.col("vec_id") % 100 == 0)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    operators = (
        op1_simhash,
        op2_learned_partitions,
        op3_tree_weighting,
        op4_mixing,
        op5_suffix_dedup,
        op6_quality,
        op7_licenses,
        op8_pieces,
        op9_warc_fixity,
        op10_sharding,
        op11_factorisation,
        op12_conversation_repair,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in operators} | {"pipeline": corpus_pipeline.run}


WARC_SQL = """
WITH records AS (
  SELECT page_id,
         row_number() OVER (ORDER BY page_id, url, html) - 1 AS position,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
         || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>'
         || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
         || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
), placed AS (
  SELECT *, position // 4096 AS file,
         sum(strlen(record)) OVER (PARTITION BY position // 4096 ORDER BY position) AS stop
  FROM records
), replica AS (
  SELECT position,
         CASE WHEN substring(md5(CAST(page_id AS VARCHAR)), 1, 2) = '00'
              THEN substring(record, 1, length(record) // 2) || '~'
                   || substring(record, length(record) // 2 + 2)
              ELSE record END AS record
  FROM records
)
SELECT a.page_id, a.position, a.file, CAST(a.stop - strlen(a.record) AS BIGINT) AS start,
       CAST(a.stop AS BIGINT) AS "end", sha256(a.record) AS expected, sha256(b.record) AS found
FROM placed a JOIN replica b USING (position)
WHERE sha256(a.record) <> sha256(b.record)
"""


def _sharding_sql() -> str:
    names = [f"shard-{i:03d}" for i in range(sharding.SHARDS)]
    table = ",".join(map(str, sharding.fill(names)))
    return f"""
WITH filled AS (SELECT string_split('{table}', ',') AS shards),
placed AS (
  SELECT doc_id,
         CAST(CAST('0x' || substring(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)
              % {sharding.SLOTS} AS INTEGER) AS slot
  FROM documents
)
SELECT doc_id, slot, CAST(shards[slot + 1] AS INTEGER) AS shard FROM placed, filled
"""


def sql() -> dict[str, str]:
    import corpus_pipeline

    known = {"op9_warc_fixity": WARC_SQL, "op10_sharding": _sharding_sql()}
    if corpus_pipeline.ORACLE_SQL is not None:
        known["pipeline"] = corpus_pipeline.ORACLE_SQL
    return known
