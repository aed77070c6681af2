"""Looking more than once: always-valid intervals, look replay, A/A error rates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import above_zero, ratio
from ..spec import ExperimentSpec
from .position import with_block

# n * rho at which the mixture boundary is tightest for usual alphas.
TIGHTEST_PRODUCT = 8.2

LOOK = "look"


def mixture_boundary(n_eff: Column, rho: Column, alpha: float) -> Column:
    """Half-width in standard errors of the normal-mixture confidence sequence."""
    scaled = n_eff * rho
    return F.sqrt(ratio(scaled + 1.0, scaled) * F.log((scaled + 1.0) / (alpha * alpha)))


def tuned_rho(n_planned: float) -> float:
    """Constant that makes the boundary tightest at a sample size fixed in advance.

    ``n_planned`` counts on the n_t*n_c/(n_t+n_c) scale.
    """
    if n_planned <= 0:
        raise ValueError("n_planned must be positive")
    return TIGHTEST_PRODUCT / n_planned


def always_valid(
    pairs: DataFrame, spec: ExperimentSpec, rho: float | str | None = None
) -> DataFrame:
    """Always-valid interval beside the fixed-horizon one.

    ``rho`` must be one positive constant over all looks for the interval to
    hold at every look; the default is ``tuned_rho(spec.n_planned)``. ``"n_eff"``
    takes the effective sample size of the row itself: a single reading that
    does not hold over several looks, and far from the tightest choice.
    """
    if rho is None:
        rho = tuned_rho(spec.n_planned)
    if not isinstance(rho, str) and rho <= 0:
        raise ValueError("rho must be positive")
    n_t, n_c = F.col("t_n"), F.col("c_n")
    n_eff = ratio(n_t * n_c, n_t + n_c)
    frame = pairs.withColumns(
        {
            "absolute_effect": F.col("t_mean_y") - F.col("c_mean_y"),
            "se": F.sqrt(ratio(F.col("t_var_y"), n_t) + ratio(F.col("c_var_y"), n_c)),
            "n_eff": n_eff,
        }
    )
    tuning = F.col("n_eff") if rho == "n_eff" else F.lit(float(rho))
    frame = frame.withColumn("boundary", mixture_boundary(F.col("n_eff"), tuning, spec.alpha))
    effect, se, b = F.col("absolute_effect"), F.col("se"), F.col("boundary")
    z = spec.z_crit
    return frame.select(
        *spec.keys, "n_eff", "absolute_effect", "se", "boundary",
        (effect - z * se).alias("fixed_ci_low"), (effect + z * se).alias("fixed_ci_high"),
        (effect - b * se).alias("always_valid_ci_low"), (effect + b * se).alias("always_valid_ci_high"),
        (b / z).alias("width_penalty"),
        (effect - b * se > 0).alias("still_significant"),
    )


def look_stats(df: DataFrame, spec: ExperimentSpec, by: Sequence[str] = ()) -> DataFrame:
    """Rows and metric sums of both arms per (keys, by, look)."""
    y = F.col(spec.metric).cast("double")
    is_arm = lambda v: F.col(spec.arm) == v
    return df.groupBy(*spec.keys, *by, LOOK).agg(
        F.count_if(is_arm(1)).alias("n_t"), F.count_if(is_arm(0)).alias("n_c"),
        F.coalesce(F.sum(F.when(is_arm(1), y)), F.lit(0.0)).alias("y_t"),
        F.coalesce(F.sum(F.when(is_arm(0), y)), F.lit(0.0)).alias("y_c"),
    )


def cumulative_looks(stats: DataFrame, spec: ExperimentSpec, by: Sequence[str] = ()) -> DataFrame:
    """Running totals and the pooled two-proportion z at every look.

    The window holds one row per look of a key, so it stays small on any log.
    """
    keys = [*spec.keys, *by]
    running = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(LOOK)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sums = stats.select(
        *keys, LOOK,
        F.sum("n_t").over(running).alias("n_treatment"),
        F.sum("n_c").over(running).alias("n_control"),
        F.sum("y_t").over(running).alias("conversions_treatment"),
        F.sum("y_c").over(running).alias("conversions_control"),
    )
    n_t, n_c = F.col("n_treatment"), F.col("n_control")
    pooled = ratio(
        F.col("conversions_treatment") + F.col("conversions_control"), n_t + n_c
    )
    sums = sums.withColumns(
        {
            "rate_treatment": ratio(F.col("conversions_treatment"), n_t),
            "rate_control": ratio(F.col("conversions_control"), n_c),
            "_se": F.sqrt(pooled * (1.0 - pooled) * (ratio(F.lit(1.0), n_t) + ratio(F.lit(1.0), n_c))),
        }
    )
    z = ratio(F.col("rate_treatment") - F.col("rate_control"), above_zero(F.col("_se")))
    return sums.withColumn("z", z).withColumn(
        "crossed", F.coalesce(F.abs(F.col("z")) > spec.z_crit, F.lit(False))
    ).drop("_se")


def look_replay(
    df: DataFrame, spec: ExperimentSpec, n_looks: int, order_by: Sequence[str] | None = None
) -> DataFrame:
    """What a team checking at ``n_looks`` equal points of the log would have seen.

    Looks are positions in the whole log, shared by all keys, as on a calendar.
    """
    needed = dict.fromkeys([*spec.keys, spec.arm, spec.metric, *(order_by or ())])
    blocked = with_block(df.select(*needed), n_looks, order_by, "_block")
    placed = blocked.withColumn(LOOK, F.col("_block") + 1)
    return cumulative_looks(look_stats(placed, spec), spec)


def ever_crossed(looks: DataFrame, spec: ExperimentSpec, by: Sequence[str] = ()) -> DataFrame:
    """First crossing and largest |z| over the looks."""
    return looks.groupBy(*spec.keys, *by).agg(
        F.count(F.lit(1)).alias("n_looks"),
        F.max(F.abs("z")).alias("max_abs_z"),
        F.min(F.when(F.col("crossed"), F.col(LOOK))).alias("first_crossing"),
        F.bool_or("crossed").alias("ever_crossed"),
    )


def unit_hash(unit: Column, replicate: Column, share: Column) -> Column:
    """Default A/A assignment by a salted hash of the unit: 1 with probability ``share``, else 0."""
    return (F.pmod(F.xxhash64(unit, replicate), F.lit(1 << 20)) < share * float(1 << 20)).cast("int")


def aa_replicates(
    units: DataFrame, spec: ExperimentSpec, unit: str, replicates: int, assign=None
) -> DataFrame:
    """z at every look for ``replicates`` re-randomisations of real units.

    ``units`` has one row per (unit, look) with ``n`` and ``sum_y``. The arms of
    eight replicates are the bits of a byte. A unit is counted once for each byte,
    by the byte's value, so a task sends at most 256 rows per (key, look, byte), and the counts of a
    replicate are those of the values that have its bit. Units are assigned with
    the design share; ``assign(unit, replicate)`` gives another 0/1 rule, of which anything but 1 counts as control.
    """
    if assign is None:
        assign = lambda u, r: unit_hash(u, r, spec.share_column())
    placed = units.select(
        *spec.keys, LOOK, F.col(unit).alias("_unit"), F.col("n").alias("_n"), F.col("sum_y").cast("double").alias("_y"),
        F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 8))).alias("_place"),
    )
    bits = [F.coalesce(assign(F.col("_unit"), F.col("_place") * 8 + b).cast("int"), F.lit(0)) * (1 << b) for b in range(8)]
    held = placed.withColumn("_byte", reduce(Column.__add__, bits))
    counted = held.groupBy(*spec.keys, LOOK, "_place", "_byte").agg(F.sum("_n").alias("_n"), F.sum("_y").alias("_y"))
    # From here on there are at most 256 rows per byte of a look of a key.
    bits = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_bit"))
    is_treated = F.expr("(shiftright(_byte, _bit) & 1) = 1")
    sums = (
        bits.withColumn("replicate", F.col("_place") * 8 + F.col("_bit")).filter(F.col("replicate") < replicates)
        .groupBy(*spec.keys, LOOK, "replicate").agg(
            *[F.coalesce(F.sum(F.when(is_treated, F.col(c))), F.lit(0)).alias(f"{c}_t") for c in ("_n", "_y")],
            F.sum("_n").alias("_n"), F.sum("_y").alias("_y"),
        )
    )
    stats = sums.select(
        *spec.keys, LOOK, "replicate", F.col("_n_t").alias("n_t"), (F.col("_n") - F.col("_n_t")).alias("n_c"),
        F.col("_y_t").alias("y_t"), (F.col("_y") - F.col("_y_t")).alias("y_c"),
    )
    return cumulative_looks(stats, spec, ("replicate",))


def unit_looks(
    df: DataFrame, spec: ExperimentSpec, unit: str, n_looks: int,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """One row per (keys, unit, look), the input of ``aa_replicates``."""
    needed = dict.fromkeys([*spec.keys, unit, spec.metric, *(order_by or ())])
    blocked = with_block(df.select(*needed), n_looks, order_by, "_block")
    return blocked.groupBy(*spec.keys, unit, (F.col("_block") + 1).alias(LOOK)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(spec.metric).cast("double")).alias("sum_y")
    )


def aa_false_positive_rate(replicate_looks: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Share of re-randomisations that ever cross when stopping at look k, for every k."""
    running = (
        Window.partitionBy(*spec.keys, "replicate")
        .orderBy(LOOK)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    so_far = replicate_looks.withColumn("_ever", F.max(F.col("crossed").cast("int")).over(running))
    return so_far.groupBy(*spec.keys, LOOK).agg(
        F.count(F.lit(1)).alias("replicates"),
        F.sum("_ever").alias("ever_crossed"),
        F.avg(F.col("crossed").cast("double")).alias("rate_at_this_look"),
        F.avg(F.col("_ever").cast("double")).alias("false_positive_rate"),
    ).withColumnRenamed(LOOK, "n_looks")
