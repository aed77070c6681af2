"""Row position without a global sort on one task.

A file source tells for every row its file and where the split it was read from begins, and
``monotonically_increasing_id`` rises within a split, so the stored order is (path, split, id), whatever order
Spark reads the splits in and whether or not the format numbers its rows. Once the rows per split
are counted, the row at any global position has a known split and id, so equal-size blocks
are a comparison of each row's place with ``n_blocks - 1`` constants: no window
over the log and no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import durable
from ..spec import ExperimentSpec

_ROW_BITS = 33
_ID = "_row_id"


def _block_starts(df: DataFrame, n_blocks: int) -> list[int]:
    """Ids of the first row of blocks 1 .. n_blocks-1.

    The window runs over one row per partition of the log, and only the block
    starts (n_blocks - 1 numbers) reach the driver.
    """
    ids = df.select(F.monotonically_increasing_id().alias(_ID))
    sizes = ids.groupBy(F.shiftright(_ID, _ROW_BITS).alias("_part")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumns(
        {
            "_from": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_all": F.sum("_n").over(Window.partitionBy(F.lit(0))),
        }
    )
    found = _starts_within(placed, n_blocks).select(
        "_b", (F.shiftleft("_part", _ROW_BITS) + F.col("_start") - F.col("_from")).alias("_id")
    )
    return [r["_id"] for r in found.orderBy("_b").collect()]


def _starts_within(placed: DataFrame, n_blocks: int) -> DataFrame:
    """Rows of ``placed`` (``_from, _n, _all``) that hold the start of a block, once for each.

    Block b starts at the least position p with floor(p * n_blocks / total) = b.
    Only the starts inside a row's range become rows.
    """
    starts = F.expr(
        f"filter(transform(sequence(1, {n_blocks - 1}), b -> struct(b AS _b, (b * _all + {n_blocks - 1}) div {n_blocks} AS _start)), "
        "s -> s._start >= _from AND s._start < _from + _n)"
    ) if n_blocks > 1 else F.expr("CAST(array() AS array<struct<_b: int, _start: bigint>>)")
    return placed.withColumn("_s", F.explode(starts)).select("*", "_s.*").drop("_s")


def _place_starts(placed: DataFrame, n_blocks: int) -> list[tuple[str, int, int]]:
    """File, split and id at which blocks 1 .. n_blocks-1 begin, for rows with ``_place``.

    The window runs over one row per split.
    """
    part = F.when(F.col("_place.file") == "", F.shiftright("_place.id", _ROW_BITS)).alias("_part")
    sizes = placed.groupBy(F.col("_place.file").alias("_file"), F.col("_place.split").alias("_split"), part).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_place.id").alias("_first")
    )
    before = Window.orderBy("_file", "_split", "_part").rowsBetween(Window.unboundedPreceding, -1)
    splits = sizes.withColumns(
        {
            "_from": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_all": F.sum("_n").over(Window.partitionBy(F.lit(0))),
        }
    )
    found = _starts_within(splits, n_blocks).select(
        "_b", "_file", "_split", (F.col("_first") + F.col("_start") - F.col("_from")).alias("_id")
    )
    return [(r["_file"], r["_split"], r["_id"]) for r in found.orderBy("_b").collect()]


def _shuffled_since_read(df: DataFrame) -> bool:
    """Whether rows leave the task that reads them, other than to be broadcast."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Exchange" in plan.replace("BroadcastExchange", "")


# What Spark says of a column that no source, several sources or another kind of source has.
_NO_SUCH_PLACE = (
    "UNRESOLVED_COLUMN.WITH_SUGGESTION", "UNRESOLVED_COLUMN.WITHOUT_SUGGESTION", "FIELD_NOT_FOUND", "AMBIGUOUS_REFERENCE",
    "METADATA_COLUMN_NOT_FOUND",
)


def _read_from(df: DataFrame, *fields: str) -> bool:
    """Whether the rows come from one file source that tells these of them."""
    try:
        df.select(*[f"_metadata.{f}" for f in fields])
    except AnalysisException as error:
        if error.getCondition() not in _NO_SUCH_PLACE:
            raise
        return False
    return True


def _with_place(df: DataFrame) -> DataFrame | None:
    """``df`` with ``_place`` (file, split, id), which orders the rows as they are stored; null if nothing tells.

    Rows of a file source that have been shuffled still have their place if the format numbers its rows (Parquet).
    Rows that come from no file stand in the order in which they are read.
    """
    file, split = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    number = F.monotonically_increasing_id()
    moved = _shuffled_since_read(df)
    if not moved and _read_from(df, "file_path", "file_block_start"):
        place = (file, split, number)
    elif _read_from(df, "file_path", "row_index"):
        place = (file, F.lit(0).cast("long"), F.col("_metadata.row_index"))
    elif not moved and not df.inputFiles():
        place = (F.lit(""), F.lit(0).cast("long"), number)
    else:
        return None
    return df.withColumn("_place", F.struct(*[c.alias(n) for c, n in zip(place, ("file", "split", "id"))]))


def has_stored_order(df: DataFrame) -> bool:
    """Whether the position of a row in the stored log can be told."""
    return _with_place(df) is not None


def _count_at_or_before(starts: Sequence[Column], value: Column) -> Column:
    block = F.lit(0)
    for start in starts:
        block = block + (value >= start).cast("int")
    return block


def ordered_keys(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The order columns alone, range-partitioned, sorted and written out.

    A row number is the last sort key, so ties of a hot value spread over
    several ranges. Written out because range bounds are sampled anew on each run.
    """
    keyed = df.select(*order_by, F.monotonically_increasing_id().alias("_tie"))
    names = [*order_by, "_tie"]
    return durable(keyed.repartitionByRange(*names).sortWithinPartitions(*names).select(*order_by))


def order_cuts(df: DataFrame, order_by: Sequence[str], n_blocks: int) -> list[tuple]:
    """Order-key values at which blocks 1 .. n_blocks-1 of equal size begin."""
    keys = ordered_keys(df, order_by)
    starts = _block_starts(keys, n_blocks)
    at_start = keys.withColumn(_ID, F.monotonically_increasing_id()).filter(F.col(_ID).isin(starts))
    rows = at_start.orderBy(_ID).collect() if starts else []
    return [tuple(r[c] for c in order_by) for r in rows]


def with_block(
    df: DataFrame, n_blocks: int, order_by: Sequence[str] | None = None, name: str = "block"
) -> DataFrame:
    """Adds the number of the equal-size block each row falls in.

    Without ``order_by`` the position is the one in the stored log: files by path
    and rows as they stand in them, for text as for Parquet, plain or compressed, and after a filter
    the rows that are left. Rows of several sources, or of a text source that were
    shuffled, have lost it, which is an error.
    With ``order_by``, rows are placed by their order key, which should be
    unique; only the keys are sorted, the rows stay where they are.
    """
    if order_by is None:
        placed = _with_place(df)
        if placed is None:
            raise ValueError("the stored order of these rows is lost; give order_by, or the log as it is read")
        starts = [
            F.struct(F.lit(f).alias("file"), F.lit(s).cast("long").alias("split"), F.lit(i).cast("long").alias("id"))
            for f, s, i in _place_starts(placed, n_blocks)
        ]
        return placed.withColumn(name, _count_at_or_before(starts, F.col("_place"))).drop("_place")
    cuts = order_cuts(df, order_by, n_blocks)
    types = {f.name: f.dataType for f in df.schema.fields}
    starts = [
        F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(order_by, cut)])
        for cut in cuts
    ]
    key = F.struct(*[F.col(c) for c in order_by])
    return df.withColumn(name, _count_at_or_before(starts, key))


def share_by_block(
    df: DataFrame, spec: ExperimentSpec, n_blocks: int = 10, order_by: Sequence[str] | None = None
) -> DataFrame:
    """Rows and treatment share of each positional block."""
    needed = [*spec.keys, spec.arm, *(order_by or ())]
    blocked = with_block(df.select(*dict.fromkeys(needed)), n_blocks, order_by)
    return blocked.groupBy(*spec.keys, "block").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(spec.arm).cast("double")).alias("treatment_share")
    )


def position_summary(by_block: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Range of the block shares and whether the log looks shuffled."""
    share = F.col("treatment_share")
    out = by_block.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.min(share).alias("min_share"),
        F.max(share).alias("max_share"),
    )
    spread = F.col("max_share") - F.col("min_share")
    return out.withColumns({"spread": spread, "shuffled": spread < spec.shuffle_tolerance})


def rank_cuts(df: DataFrame, column: str, n_bins: int) -> list[float]:
    """Exact quantiles of a column at i/n_bins: the value at rank ceil(i*n/n_bins).

    One distributed sort of that column; ``percentile`` would build every
    distinct value into a single buffer.
    """
    keys = ordered_keys(df.filter(F.col(column).isNotNull()), [column])
    starts = _block_starts(keys, n_bins)
    # Rank r is position r - 1, so the wanted row is the one before each block start.
    return [r[0] for r in _values_before(keys, column, starts)]


def _values_before(keys: DataFrame, column: str, starts: Sequence[int]) -> list:
    numbered = keys.withColumn(_ID, F.monotonically_increasing_id())
    inside = [s - 1 for s in starts if s & ((1 << _ROW_BITS) - 1)]
    last = [s >> _ROW_BITS for s in starts if not s & ((1 << _ROW_BITS) - 1)]
    found = []
    if inside:
        found += numbered.filter(F.col(_ID).isin(inside)).select(column).collect()
    for part in last:
        # The start opens a partition: the value before it is the largest earlier one.
        found.append(numbered.filter(F.shiftright(_ID, _ROW_BITS) < part).agg(F.max(column)).first())
    return sorted(found)
