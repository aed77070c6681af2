"""The registered queries against their SQL, and the pipeline against its stages' promises."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from armlens.llm import queries
from armlens.llm.pii import base_spans

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    query = next(q for q in queries.QUERIES if q.__name__ == name)
    result = connection.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    rows = query(spark, SF)
    assert sorted(rows.columns) == sorted(columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in rows.collect()) == sorted(map(repr, result.fetchall()))


@pytest.mark.parametrize("number", range(1, 14))
def test_every_operator_has_one_query(number):
    assert sum(q.__name__.startswith(f"op{number}_") for q in queries.QUERIES) == 1


def similarity(a, b, k=5):
    sets = []
    for text in (a, b):
        words = text.lower().split()
        sets.append({tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, before, SF))
        rows = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else {}
        if name != "best_fit_packing":
            assert docs.columns == columns and rows
        if name == "exact_dedup":
            assert len(set(rows.values())) == len(rows) == before.select("text").distinct().count()
        if name == "simhash_near_dedup":
            left = list(rows.values())
            close = [(a, b) for i, a in enumerate(left) for b in left[:i] if similarity(a, b) >= 0.8]
            assert not close
        if name == "pii":
            assert len(rows) == before.count()
            assert not any(base_spans(t) for t in rows.values() if not re.search(r"[0-9][\x20-]\[", t))
            unchanged = before.where(~F.col("text").rlike(r"[@0-9]")).select("doc_id", "text").collect()
            assert all(rows[r.doc_id] == r.text for r in unchanged)
    assert docs.select("doc_id").distinct().count() == before.count()


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
    assert docs.count() == 0


def test_pipeline_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and ids, ties and columns with clashing names."""
    long = "alpha beta gamma delta " * 20_000
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, t string, fp string"
    text = "the quick brown fox jumps over the lazy dog and runs into the forest at night"
    rows = [
        (1, text, "en", "a", 10, 7, "k", "t", "f"), (1, text, "en", "a", 10, 7, "k", "t", "f"), (2, text + " again", "en", "a", 10, 7, "k", "t", "f"),
        (2, "words of another text that is nobody's copy, whatever the id says of it", None, None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None, None), (None, "a text without an id", "en", None, None, 1, "", "", ""),
        (4, "", "en", "b", 0, 1, "", "", ""), (5, None, "en", "b", 0, 1, "", "", ""), (6, long, "en", "c", len(long), 1, "", "", ""),
        (7, "mail to a.b@c.example.org now", "en", "c", 29, 1, "", "", ""), (8, " \n\t ", "en", "c", 4, 1, "", "", ""),
    ]
    docs = spark.createDataFrame(rows, schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        if "text" in docs.columns:
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
            kept[name] = sorted(repr((r.doc_id, r.text)) for r in docs.select("doc_id", "text").collect())
    # Of the empty texts the largest id stays, then the blank one is its near copy.
    assert [r for r in kept["exact_dedup"] if r in ("(4, '')", "(5, None)")] == ["(5, None)"]
    near = kept["simhash_near_dedup"]
    assert near.count(repr((1, text))) == 2 and repr((2, text + " again")) not in near
    assert any(r.startswith("(2, \"words of another") for r in near)
    assert "(5, None)" in near and not any(r.startswith("(8,") for r in near)
    assert any("[EMAIL]" in r for r in kept["pii"]) and len(kept["pii"]) == len(near)
    assert docs.where("doc_id = 6").count() > 50 and docs.count() > len(near)
