"""Exact order statistics of many groups at once, by histograms that close in on the wanted ranks.

A value at a wanted rank lies in an interval; the rows inside are counted in equal
parts of it, the part that holds the rank is the next interval, from its least to its greatest value. Every
round is one aggregate without a sort: a task sends at most one row per group, interval
and part. The position of a part never falls as the value rises, so no rounding can lose a value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import on_keys
from ..sources.session import stored

PARTS = 4096


def _part(value: Column, low: Column, high: Column, parts: int) -> Column:
    """0 for the least value, ``parts - 1`` for the greatest, rising between; infinite ends included."""
    inner = F.nanvl((value - low) / (high - low), F.lit(0.5)) * float(parts - 2)
    inside = F.least(F.greatest(F.floor(inner), F.lit(0)), F.lit(parts - 3)) + 1
    return F.when(value == low, 0).when(value == high, parts - 1).otherwise(inside).cast("int")


def values_at_ranks(
    df: DataFrame, column: str, ranks: Sequence[tuple[int, int] | int], keys: Sequence[str] = (), parts: int = PARTS
) -> DataFrame:
    """``keys, at, value``: for each entry of ``ranks`` its number and a value: for (a, b) the ceil(a * n / b)-th least, for k the k-th.

    n counts the values of a group that are neither NULL nor NaN; a group without
    any has no rows, a rank below 1 gives the least value and one over n the greatest. ``df`` is read once and then once a round; each round
    divides an interval by ``parts``, so a few rounds separate all values of a column.
    """
    keys = list(keys)
    x = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")).alias("_x")
    rows = df.select(*keys, x)
    values = rows.filter(F.col("_x").isNotNull())
    whole = rows.groupBy(*keys).agg(F.count("_x").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    texts = [str(r) if isinstance(r, int) else f"(_n * {r[0]} + {r[1] - 1}) div {r[1]}" for r in ranks]
    wanted = F.explode(F.array(*[
        F.expr(f"struct({i} AS at, greatest(1L, least(_n, CAST({text} AS BIGINT))) AS rank)") for i, text in enumerate(texts)])).alias("_r")
    state = stored(whole.filter(F.col("_n") > 0).select(*keys, wanted, F.col("_low").alias("low"), F.col("_high").alias("high"))
                   .select(*keys, "_r.at", "_r.rank", "low", "high"))
    found = [state.filter("low = high")]
    open_ = state.filter("low < high")
    while not open_.isEmpty():
        interval = F.sort_array(F.collect_set(F.struct("low", "high"))).alias("_intervals")
        intervals = stored(open_.groupBy(*keys).agg(interval))
        joined = on_keys(values, intervals, keys)
        mine = F.lit(None).cast("struct<low:double,high:double>")
        for i in reversed(range(len(ranks))):
            one = F.get("_intervals", F.lit(i))
            mine = F.when((F.col("_x") >= one["low"]) & (F.col("_x") <= one["high"]), one).otherwise(mine)
        placed = joined.select(*keys, "_x", mine.alias("_in")).filter(F.col("_in").isNotNull())
        counts = placed.groupBy(
            *keys, "_in.low", "_in.high", _part(F.col("_x"), F.col("_in.low"), F.col("_in.high"), parts).alias("_part")
        ).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_from"), F.max("_x").alias("_to"))
        # At most ``parts`` rows an interval.
        upto = Window.partitionBy(*keys, "low", "high").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_before", F.col("_upto") - F.col("_n"))
        same = [open_[k].eqNullSafe(running[k]) for k in keys] + [
            open_[c] == running[c] for c in ("low", "high")] + [open_["rank"] > running["_before"], open_["rank"] <= running["_upto"]]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        state = stored(open_.join(running, condition).select(
            *[open_[k] for k in keys], open_["at"], (open_["rank"] - running["_before"]).alias("rank"),
            running["_from"].alias("low"), running["_to"].alias("high")))
        found.append(state.filter("low = high"))
        open_ = state.filter("low < high")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select(*keys, "at", F.col("low").alias("value"))
