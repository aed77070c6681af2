"""Samples of a log that hold up on block-ordered files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import NumericType

from ..functions.columns import quoted
from ..operators.selection import values_at_ranks
from ..spec import ExperimentSpec

# Rows of a sample that one task may gather.
MOST_IN_TASK = 100_000


def fraction_sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Bernoulli sample without replacement."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def arm_sample(df: DataFrame, spec: ExperimentSpec, fractions: dict[int, float], seed: int) -> DataFrame:
    """A different sampling rate per arm, so the small arm is never lost."""
    return df.sampleBy(spec.arm, fractions, seed)


def fixed_size_sample(
    df: DataFrame,
    n: int,
    seed: int,
    rank: Column | None = None,
    tie_break: Sequence[str] = (),
    most_in_task: int = MOST_IN_TASK,
) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), drawn across the whole input: the ``n`` smallest ranks.

    ``rank`` defaults to a seeded hash of the whole row, so a row has the same
    rank whichever task reads it. Up to ``most_in_task`` rows (and for ranks that are not numbers) it is one read, in which each
    task keeps at most ``n`` rows. For more, the n-th rank is found by closing in on it and the
    rows below it are filtered where they are; only rows that equal it as a double are sorted.
    """
    if rank is None:
        rank = F.xxhash64(F.lit(seed), *[F.col(quoted(c)) for c in df.columns])
    ranked = df.withColumn("_rank", rank)
    if n <= most_in_task or not isinstance(ranked.schema["_rank"].dataType, NumericType):
        return ranked.orderBy("_rank", *tie_break).limit(n).drop("_rank")
    # A missing rank comes first, as in a sort.
    placed = ranked.withColumn("_place", F.coalesce(F.col("_rank").cast("double"), F.lit(float("-inf"))))
    last = values_at_ranks(placed, "_place", [n]).first()
    if last is None:
        return df.limit(0)
    below = placed.filter(F.col("_place") < last.value)
    edge = placed.filter(F.col("_place") == last.value).orderBy("_rank", *tie_break).limit(n - below.count())
    return below.unionByName(edge).drop("_rank", "_place")


def arm_coverage(sample: DataFrame, spec: ExperimentSpec, least: int = 1000) -> DataFrame:
    """Rows per arm and whether each arm has more than ``least`` of them.

    Both arms get a row; one that is absent counts 0 and is not covered.
    """
    counts = sample.groupBy(*spec.keys).agg(
        F.count_if(F.col(spec.arm) == 1).alias("_t"), F.count_if(F.col(spec.arm) == 0).alias("_c")
    )
    rows = F.array(
        F.struct(F.lit(0).alias(spec.arm), F.col("_c").alias("n")),
        F.struct(F.lit(1).alias(spec.arm), F.col("_t").alias("n")),
    )
    long = counts.select(*spec.keys, F.explode(rows).alias("_row")).select(*spec.keys, "_row.*")
    return long.withColumn("covered", F.col("n") > least)
