"""Registered queries against their SQL, and the pipeline stage by stage, on the smallest driver tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import SparkSession

import corpus_pipeline
from tests.llm.conftest import SCHEMA, sentences
from tests.llm.test_dedup_and_rules import brute_near, brute_substring, check_packing
from tidemark.llm import oracle, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark: SparkSession, name: str) -> None:
    import duckdb

    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    told = queries.QUERIES[name](spark, SF).toPandas()
    want = connection.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(told.columns)
    assert columns == sorted(want.columns)
    told, want = (t[columns].sort_values("doc_id").reset_index(drop=True).astype(str) for t in (told, want))
    assert told.equals(want)
    assert oracle


def test_pipeline_stages(spark: SparkSession, tmp_path) -> None:
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        seen.append(name)
        if name == "packing":
            check_packing(rows, list(before.values()), 1024)
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in rows}
        if name == "near-dedup":
            assert after == {k: before[k] for k, (_, c) in brute_near(before).items() if c == k}
        elif name == "substring dedup":
            assert set(after) == set(before)
            assert {k: len(t.split(" ")) if t else 0 for k, t in after.items()} == {k: n - gone for k, (n, gone, _) in brute_substring(before, 35).items()}
            assert all(r.n_chars == len(r.text) for r in rows)
        else:
            assert all(before[k] == t for k, t in after.items()) and len(after) > 0.8 * len(before)
    assert seen == ["quality rules", "language ID", "near-dedup", "substring dedup", "packing"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))


def test_pipeline_keeps_one_copy_of_repeated_rows(spark: SparkSession) -> None:
    """Repeated rows, copies without an id and other texts of an id: one row of each text reaches packing whole."""
    a, b, c, d, e = (sentences(k, 12) for k in range(40, 45))
    rows = [(1, a)] * 3 + [(None, a), (None, b), (None, b), (2, c), (3, c), (3, d), (3, d), (4, e), (None, e), (None, None), (5, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], SCHEMA).repartition(4)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (None, b), (2, c), (3, d), (4, e), (None, None), (5, None)], key=str)
    left = corpus_pipeline.drop_repeated_passages(spark, kept, SF).collect()
    assert sorted(len(r.text.split()) for r in left) == sorted([0, 0, *(len(t.split()) for t in (a, b, c, d, e))])


def test_pipeline_filters_rows_without_an_id_and_passes_further_columns(spark: SparkSession) -> None:
    """Rejected rows go with or without an id, clean ones stay, and further columns may be named like those of the stages."""
    clean, bad = [sentences(k, 12) for k in range(50, 62)], "word " * 200
    rows = [(k, t, "en", "s", None, k) for k, t in enumerate(clean)] + [(None, clean[0] + " more", "en", None, None, 90), (None, bad, "en", "s", None, 91), (99, bad, "en", "s", None, 92), (None, None, "en", "s", None, 93)]
    clash = ["row_key", "n_words", "first", "kept_text", "score", "kept", "extra0", "extra6"]
    docs = spark.createDataFrame(rows, SCHEMA + ", mark long").selectExpr("*", *(f"mark AS {c}" for c in clash)).repartition(3)
    for stage in (corpus_pipeline.keep_quality, corpus_pipeline.keep_language, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_repeated_passages):
        told = stage(spark, docs, SF)
        assert told.columns == docs.columns
        found = told.collect()
        assert all(r[c] == r.mark for r in found for c in clash)
        marks = {r.mark for r in found}
        if stage is corpus_pipeline.keep_quality:
            assert marks == {*range(len(clean)), 90}
        elif stage is corpus_pipeline.keep_language:
            assert 93 not in marks and marks >= set(range(len(clean)))
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_quality_stage_equals_sql(spark: SparkSession) -> None:
    import duckdb

    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {k for k, kept in connection.sql(queries.ORACLE_SQL["op6_quality_rules"]).df()[["doc_id", "kept"]].itertuples(index=False) if kept}
    told = corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert {r.doc_id for r in told.select("doc_id").collect()} == want
