"""Experiment views over the star-schema tables.

The tables hold no experiment, so one is defined with integer arithmetic on
order and part keys. Only the dimension tables a caller's columns need are
joined, and only by their keys: Spark picks the join from the table sizes. Only
``orders`` grows with the log itself and is never broadcast: both sides are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import stored

FEATURES = tuple(f"f{i}" for i in range(12))
LOG_COLUMNS = (*FEATURES, "treatment", "conversion", "visit", "exposure")

def _flag(condition: Column) -> Column:
    return condition.cast("int")


def _definitions() -> dict[str, tuple[Column, tuple[str, ...]]]:
    """Column name -> (expression, tables it needs besides lineitem)."""
    c = F.col
    treated = c("l_orderkey") % 20 < 17
    days = F.datediff(c("l_shipdate"), c("o_orderdate"))
    features = [
        (c("l_quantity"), ()), (c("l_extendedprice"), ()), (c("l_discount"), ()),
        (c("l_tax"), ()), (c("l_linenumber"), ()), (c("o_totalprice"), ("orders",)),
        (c("c_acctbal"), ("orders", "customer")), (c("p_size"), ("part",)),
        (c("p_retailprice"), ("part",)), (c("s_acctbal"), ("supplier",)),
        (days, ("orders",)), (c("c_nationkey"), ("orders", "customer")),
    ]
    returned = c("l_returnflag") == "R"
    out = {f"f{i}": (e.cast("double"), t) for i, (e, t) in enumerate(features)}
    out |= {
        "treatment": (_flag(treated), ()),
        "visit": (_flag(c("l_returnflag").isin("R", "A")), ()),
        "conversion": (_flag(returned & ~(~treated & (c("l_partkey") % 5 == 0))), ()),
        "conversion_null": (_flag(returned), ()),
        "exposure": (_flag(treated & (c("l_linestatus") == "F")), ()),
        "fold": ((c("l_partkey") % 2).cast("int"), ()),
        "fold5": ((c("l_partkey") % 5).cast("int"), ()),
        "segment": (c("o_orderpriority"), ("orders",)),
        # A key that is missing for some rows.
        "segment_null": (F.nullif(c("o_orderpriority"), F.lit("1-URGENT")), ("orders",)),
        "market": (c("c_mktsegment"), ("orders", "customer")),
        # Assignment gone wrong: heavy treatment lines end up in control.
        "treatment_skewed": (_flag(treated & (c("l_quantity") <= 45)), ()),
    }
    return out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def explog(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] = LOG_COLUMNS
) -> DataFrame:
    """One row per order line: twelve features, arm, outcome flags, folds and segments."""
    definitions = _definitions()
    needed = {t for name in columns for t in definitions[name][1]}
    log = _table(spark, sf_dir, "lineitem")
    if "orders" in needed:
        orders = _table(spark, sf_dir, "orders")
        if "customer" in needed:
            # Before the lines, of which an order has several.
            orders = orders.join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        log = log.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    for name, left, right in (("part", "l_partkey", "p_partkey"), ("supplier", "l_suppkey", "s_suppkey")):
        if name in needed:
            log = log.join(_table(spark, sf_dir, name), F.col(left) == F.col(right))
    return log.select(*[definitions[name][0].alias(name) for name in columns])


def explog_stored(spark: SparkSession, sf_dir: str, columns: Sequence[str] = LOG_COLUMNS) -> DataFrame:
    """The same rows, joined once and kept as Parquet, for analyses that read them several times."""
    return stored(explog(spark, sf_dir, columns))


def explog_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few coarse columns, so exact copies of a row are common."""
    return explog(spark, sf_dir, ("treatment", "conversion", "visit", "exposure", "f0", "f2", "f3"))


def explog_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, with a mixed assignment and a block-assembled one."""
    orders = _table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", "o_orderpriority",
        _flag(F.col("o_orderkey") % 20 < 17).alias("treatment"),
    )


def explog_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event in time order: arm by user, metric = purchase."""
    events = _table(spark, sf_dir, "events")
    return events.select(
        "event_id", "ts", "user_id",
        (F.col("user_id") % 2).cast("int").alias("treatment"),
        _flag(F.col("event_type") == "purchase").alias("conversion"),
    )
