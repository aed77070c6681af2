"""Data quality of the log: flag domains, nesting, duplicates, cardinality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.session import stored
from ..spec import ExperimentSpec

MULTIPLICITY = "multiplicity"


def _not_binary(name: str) -> Column:
    return ~F.coalesce(F.col(name).isin(0, 1), F.lit(False))


def flag_counts(flags: Sequence[str]) -> list[Column]:
    """Row count and out-of-domain count per flag, to be combined with other aggregates."""
    return [F.count(F.lit(1)).alias("n_rows")] + [
        F.count_if(_not_binary(f)).alias(f"bad_{f}") for f in flags
    ]


def flag_quality(
    df: DataFrame,
    flags: Sequence[str],
    set_flags: Mapping[str, str] | None = None,
    implications: Mapping[str, tuple[str, str]] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Rows, out-of-domain values per flag (NULL counts as bad), set flags and broken nesting.

    ``set_flags`` maps an output name to a flag to count where it is 1;
    ``implications`` maps an output name to (consequence-less cause, required
    flag): rows with the first at 1 and the second at 0.
    """
    counts = flag_counts(flags)
    counts += [F.count_if(F.col(f) == 1).alias(o) for o, f in (set_flags or {}).items()]
    counts += [
        F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias(o)
        for o, (a, b) in (implications or {}).items()
    ]
    return df.groupBy(*keys).agg(*counts)


class FlagDomainError(ValueError):
    """A flag column holds something other than 0 or 1."""


def require_clean_flags(quality: DataFrame) -> None:
    """Fail fast when any ``bad_`` count is above zero. Runs the one-row quality aggregate."""
    bad = [c for c in quality.columns if c.startswith("bad_")]
    worst = quality.agg(*[F.max(c).alias(c) for c in bad]).first()
    found = {c: worst[c] for c in bad if worst[c]}
    if found:
        raise FlagDomainError(f"values other than 0 and 1 found: {found}")


def clean_flags(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """The same gate inside the plan: reading a bad row raises, without a pass of its own."""
    bad = F.lit(False)
    for f in flags:
        bad = bad | _not_binary(f)
    message = F.lit("values other than 0 and 1 found in " + ", ".join(flags))
    return df.filter(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def collapse(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows with how often each occurs.

    The one wide shuffle of the duplicate analysis. Copies are counted
    map-side first, so a record repeated a billion times moves once per task.
    Grouping is NULL-safe.
    """
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(MULTIPLICITY))


# Bits of the filter of repeated row hashes: so many a row, at most so many (32 MB); and in one row of the filter.
FILTER_BITS_PER_ROW, MOST_FILTER_BITS, ROW_BITS = 8, 1 << 28, 1 << 15


def collapse_rare(df: DataFrame, columns: Sequence[str], n_rows: int, most_bits: int = MOST_FILTER_BITS) -> DataFrame:
    """``collapse`` for a log of about ``n_rows`` rows of which few repeat, without shuffling those that do not.

    Row hashes are counted by slot, which moves two numbers a slot; a bit says
    whether a slot holds more than one row. Rows of other slots are alone
    and stay where they are, the rest is collapsed as usual, so a shared slot costs a shuffle and never a wrong count.
    The filter is broadcast and bounded: beyond ``most_bits / 8`` rows more of those
    that are alone are shuffled too. ``df`` is read three times.
    """
    bits = min(most_bits, 1 << max(15, (FILTER_BITS_PER_ROW * n_rows - 1).bit_length()))
    slot = F.pmod(F.xxhash64(*columns), F.lit(bits))
    slotted = df.select(*columns, slot.alias("_slot"))
    shared = slotted.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    words = shared.groupBy(
        F.floor(F.col("_slot") / ROW_BITS).alias("_block"), F.floor(F.col("_slot") % ROW_BITS / 64).cast("int").alias("_place")
    ).agg(F.expr("bit_or(shiftleft(1L, CAST(_slot % 64 AS INT)))").alias("_word"))
    # One row for each block of slots: its words side by side, 0 where no slot is shared.
    held = F.map_from_entries(F.collect_list(F.struct("_place", "_word")))
    whole = words.groupBy("_block").agg(held.alias("_m")).select(
        "_block", F.expr(f"transform(sequence(0, {ROW_BITS // 64 - 1}), i -> coalesce(_m[i], 0L))").alias("_words"))
    blocks = F.broadcast(stored(whole))
    marked = slotted.withColumn("_block", F.floor(F.col("_slot") / ROW_BITS)).join(blocks, "_block", "left").withColumn(
        "_shared", F.expr(f"coalesce((shiftright(get(_words, CAST(_slot % {ROW_BITS} / 64 AS INT)), CAST(_slot % 64 AS INT)) & 1L) = 1L, false)"))
    alone = marked.filter(~F.col("_shared")).select(*columns, F.lit(1).cast("long").alias(MULTIPLICITY))
    return alone.unionByName(collapse(marked.filter("_shared").select(*columns), columns))


def duplicate_summary(collapsed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct rows and exact duplicates, optionally per key (such as the arm)."""
    m = F.col(MULTIPLICITY)
    out = collapsed.groupBy(*keys).agg(
        F.coalesce(F.sum(m), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("distinct_rows")
    )
    duplicates = F.col("n_rows") - F.col("distinct_rows")
    return out.withColumns(
        {
            "exact_duplicate_rows": duplicates,
            "duplicate_share": ratio(duplicates.cast("double"), F.col("n_rows")),
        }
    )


def duplicate_profile(collapsed: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Who the repeated records are: size, conversions, treatment share.

    ``expected_conversions`` is what the repeated rows would hold if they
    converted at the rate of the rows that occur once.
    """
    m = F.col(MULTIPLICITY)
    y, t = F.col(spec.metric), F.col(spec.arm)
    repeated = m > 1
    out = collapsed.groupBy(*spec.keys).agg(
        F.coalesce(F.sum(F.when(repeated, m)), F.lit(0)).alias("rows_in_duplicate_groups"),
        F.count_if(repeated).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(repeated, m * y)), F.lit(0)).alias("conversions"),
        F.sum(F.when(repeated, m * t)).alias("_treated"),
        F.count_if(~repeated).alias("singleton_rows"),
        F.coalesce(F.sum(F.when(~repeated, y)), F.lit(0)).alias("singleton_conversions"),
        F.max(m).alias("largest_group"),
    )
    rate = ratio(F.col("singleton_conversions").cast("double"), F.col("singleton_rows"))
    return out.select(
        *spec.keys, "rows_in_duplicate_groups", "duplicate_groups", "largest_group",
        "conversions", "singleton_rows", "singleton_conversions",
        ratio(F.col("_treated").cast("double"), F.col("rows_in_duplicate_groups")).alias(
            "treatment_share"
        ),
        (rate * F.col("rows_in_duplicate_groups")).alias("expected_conversions"),
    )


def distinct_per_group(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Distinct combinations per key; counts combinations holding a NULL too."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.struct(*columns)).alias("distinct_rows"),
    )


# Sketches have 2^14 buckets, a standard error of about 0.8 percent.
SKETCH_BITS = 14


def cardinality_sketches(df: DataFrame, spec: ExperimentSpec, bits: int = SKETCH_BITS) -> DataFrame:
    """A sketch of the distinct values of each feature per key, to be stored beside the cells.

    One pass with a row per key and task; sketches of segments, days or experiments can be
    united later without the log (``united_cardinality``). NULL is not a value.
    """
    value = lambda f: F.when(F.col(f).isNotNull(), F.xxhash64(F.col(f).cast("double")))
    return df.groupBy(*spec.keys).agg(*[F.hll_sketch_agg(value(f), bits).alias(f) for f in spec.features])


def united_cardinality(sketches: DataFrame, spec: ExperimentSpec, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values of each feature over all sketches of a key, about as exact as one sketch of all rows."""
    wide = sketches.groupBy(*keys).agg(*[
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f)), F.lit(0)).cast("long").alias(f) for f in spec.features])
    return wide.unpivot(list(keys), list(spec.features), "feature", "distinct_values")


def feature_cardinality(df: DataFrame, spec: ExperimentSpec, exact: bool = False) -> DataFrame:
    """Distinct values of each feature, by sketch in one pass, or exact.

    The exact form reads and groups one feature at a time, so no row is multiplied, repeated
    values collapse map-side and no feature's values are gathered in one place.
    """
    if not exact:
        return united_cardinality(cardinality_sketches(df, spec), spec, spec.keys)
    keys, parts = list(spec.keys), []
    for f in spec.features:
        values = df.select(*keys, F.col(f).cast("double").alias("_value")).groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_n"))
        parts.append(values.groupBy(*keys).agg(F.count("_value").alias("distinct_values")).select(
            *keys, F.lit(f).alias("feature"), "distinct_values"))
    return reduce(DataFrame.unionByName, parts)
