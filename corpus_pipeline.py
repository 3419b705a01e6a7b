"""Corpus pipeline: quality rules, language ID, near-dedup, substring dedup and packing over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
reread as the next stage's ``docs``.  Filtering stages take away the few rows they
reject by an anti-join, which shuffles no text while these are few (the join is
chosen by their counted size).  A row is known by its id, one without an id by its text
and source; rows that share an id are rejected together.  Columns beyond those of
documents may have any names and pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, near_dedup, packing, quality_rules, substring_dedup
from tidemark.llm.shared import checkpointed, join_checked

#: Documents whose best language has a lower score than this are rejected.
MIN_LANGUAGE_SCORE = 0.4


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _any_columns(stage: Stage) -> Stage:
    """Keep the names of further columns away from those that a stage makes."""

    @wraps(stage)
    def renamed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*(c if c in DOCUMENT else f"extra{k}" for k, c in enumerate(docs.columns)))
        return stage(spark, plain, sf_dir).toDF(*docs.columns)

    return renamed


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a ``row_key``: the id, or for a row without one a hash of text and source beyond the ids."""
    beyond = F.xxhash64("text", "source").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return docs.withColumn("row_key", F.coalesce(F.col("doc_id").cast("long"), beyond))


def _as_documents(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_key").alias("doc_id"), "text", "source")


def _without(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    return join_checked(rows, rejected.select(F.col("doc_id").alias("row_key")), "row_key", "left_anti").drop("row_key")


@_any_columns
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    rows = _keyed(docs)
    return _without(rows, quality_rules.apply(_as_documents(rows)).where("not kept")).select(docs.columns)


@_any_columns
def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language, or in none that scores well enough, go."""
    rows = _keyed(docs)
    found = language_id.predict(_as_documents(rows), language_id.fit(docs))
    return _without(rows, found.where((F.col("lang_pred") == language_id.UNKNOWN) | (F.col("score") < MIN_LANGUAGE_SCORE))).select(docs.columns)


def _told_apart(docs: DataFrame) -> DataFrame:
    """One row for each id and text, with a ``row_key`` of its own.

    The key is the id.  A row without an id, and all texts of an id but one, get a hash
    beyond the ids, so that a row with an id is kept rather than its copy without one.
    Only rows whose id is missing or repeated are shuffled with their text.
    """
    named = docs.where("doc_id is not null")
    repeated = checkpointed(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    again = join_checked(named, repeated, "doc_id", "left_semi").select(docs.columns)
    again = checkpointed(again.unionByName(docs.where("doc_id is null")).dropDuplicates(["doc_id", "text"]))
    first = again.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("first"))
    beyond = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    own = F.when(F.xxhash64("text") == F.col("first"), F.col("doc_id").cast("long")).otherwise(beyond)
    again = again.join(first.hint("merge"), "doc_id", "left").select(*docs.columns, own.alias("row_key"))
    single = join_checked(named, repeated, "doc_id", "left_anti").select(*docs.columns, F.col("doc_id").cast("long").alias("row_key"))
    return single.unionByName(checkpointed(again))


@_any_columns
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, repeated rows and rows without an id included."""
    rows = _told_apart(docs)
    copies = near_dedup.apply(rows.select(F.col("row_key").alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias("row_key"))
    return join_checked(rows, copies, "row_key", "left_anti").select(docs.columns)


@_any_columns
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the passages that occur more than once."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    told = substring_dedup.apply(docs, carry=tuple(others))
    texts = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return told.select(*(texts[c].alias(c) if c in texts else F.col(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packing.apply(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("language ID", keep_language),
    ("near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Language ID and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
