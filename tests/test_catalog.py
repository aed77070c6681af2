"""Every named query against its SQL statement, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as spark_entry
from armlens.plans import catalog, oracles, views

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


@pytest.mark.parametrize("name", sorted(oracles.statements()))
def test_query_equals_its_sql(spark, duck, name):
    df = spark_entry.queries()[name](spark, SF_DIR)
    result = duck.execute(spark_entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted({q.__name__ for q in catalog.QUERIES} - set(spark_entry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    rows = spark_entry.queries()[name](spark, SF_DIR).collect()
    assert rows
    for row in rows:
        assert not any(isinstance(v, float) and math.isnan(v) for v in row)


READ_ONCE = (
    "feature_cardinality_united", "experiment_summary", "feature_cardinality", "experiment_summary_by_segment", "duplicates_rare",
    "uplift_table_sketch", "uplift_by_segment", "uplift_bins_by_segment", "shifted_moments", "gated_effects_null_key",
)


@pytest.mark.parametrize("name", READ_ONCE)
def test_tables_are_joined_once(spark, monkeypatch, name):
    """However often the log is analysed, the lines are read and joined once."""
    plain, read = views._table, spark.sparkContext.accumulator(0)

    def counted(session, sf_dir, table):
        df = plain(session, sf_dir, table)

        def count(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return df.mapInArrow(count, df.schema) if table == "lineitem" else df

    monkeypatch.setattr(views, "_table", counted)
    spark_entry.queries()[name](spark, SF_DIR).collect()
    assert read.value == plain(spark, SF_DIR, "lineitem").count()


def test_lines_and_orders_meet_by_a_shuffle_at_every_size(spark):
    plan = views.explog(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "SortMergeJoin [l_orderkey" in plan


def test_entry_gives_one_row(spark):
    assert spark_entry.entry(spark).count() == 1
