"""From raw documents to token ids: five stages, each over all that the last one kept.

Every stage is written as Parquet in the shared folder and read again, so a lost
executor repeats a part of one stage. What a stage stores on its way is deleted
when the next one begins, so its result must have been written by then. Empty input gives empty output; null ids,
repeated rows and further columns go through the stages as the operators
state it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from txrisk.llm import mixing, pieces, quality, simhash, suffixes
from txrisk.llm.queries import PIECE_MODEL
from txrisk.session import apply_sql_settings, free, materialize, recorded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# A passage that several documents share is cut if it has so many words and so
# many bytes. Passages of fifty words have 248 bytes or more in the given tables.
PASSAGE_WORDS = 50
PASSAGE_BYTES = 240

# What the stage before stored on its way.
_left: list[str] = []


def _stage(fn: Stage) -> Stage:
    @functools.wraps(fn)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free(spark, _left)
        with recorded() as made:
            kept = fn(spark, docs, sf_dir)
        _left.extend(made)
        return kept

    return stage


@_stage
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs)


@_stage
def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(docs, length=PASSAGE_BYTES, least_words=PASSAGE_WORDS)


@_stage
def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


@_stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, PIECE_MODEL)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good_documents),
    ("near-dedup", one_of_each_group),
    ("repeated passages", without_repeated_passages),
    ("mixing", mixed_to_weights),
    ("token ids", token_ids),
]

# No SQL states the forest, the connected groups and the lattice in one query.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = apply_sql_settings(spark).read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        with recorded() as made:
            docs = materialize(kept, name.replace(" ", "-"))
        free(spark, before)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
