"""Sample size and power per key, as closed-form columns.

With a two-sided test the opposite tail is far below any target power used for
design, so sizes and detectable lifts have closed forms; achieved power keeps
both tails because it also describes weak designs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.distributions import normal_sf
from ..spec import ExperimentSpec
from .suffstats import arm_pairs


def _angle(rate: Column) -> Column:
    """Variance-stabilised rate; NULL outside [0, 1]."""
    return F.when((rate >= 0) & (rate <= 1), F.asin(F.sqrt(rate)))


def cohens_h(baseline: Column, treated: Column) -> Column:
    """Effect size between two proportions on the arcsine scale."""
    return 2.0 * (_angle(treated) - _angle(baseline))


def balanced_n(h: Column, spec: ExperimentSpec) -> Column:
    """Rows per arm of an even split that reach the spec's power at effect size h."""
    z = spec.z_crit + spec.z_power
    return F.ceil(ratio(F.lit(2.0 * z * z), h * h)).cast("long")


def unbalanced_control_n(n_balanced: Column, k: Column) -> Column:
    """Control rows needed when treatment is k times control."""
    return F.ceil(n_balanced * (1.0 + ratio(F.lit(1.0), k)) / 2.0).cast("long")


def design_table(design: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Sizes for hypothetical designs: rows of ``baseline_rate, mde_relative, treatment_share``."""
    return _required(design.withColumn("_k", ratio(F.col("treatment_share"), 1.0 - F.col("treatment_share"))), spec).drop("_k")


def _required(frame: DataFrame, spec: ExperimentSpec) -> DataFrame:
    frame = frame.withColumn(
        "treated_rate_target", F.col("baseline_rate") * (1.0 + F.col("mde_relative"))
    )
    frame = frame.withColumn(
        "effect_size_h", cohens_h(F.col("baseline_rate"), F.col("treated_rate_target"))
    )
    frame = frame.withColumn("n_per_arm_balanced", balanced_n(F.col("effect_size_h"), spec))
    frame = frame.withColumn(
        "n_control_required", unbalanced_control_n(F.col("n_per_arm_balanced"), F.col("_k"))
    )
    frame = frame.withColumn(
        "n_treatment_required", F.ceil(F.col("_k") * F.col("n_control_required")).cast("long")
    )
    return frame.withColumn(
        "n_total_required", F.col("n_treatment_required") + F.col("n_control_required")
    )


def achieved_power(h: Column, n_eff: Column, spec: ExperimentSpec) -> Column:
    """Two-sided power at effect size h with n_eff rows per arm."""
    drift = F.abs(h) * F.sqrt(n_eff / 2.0)
    return normal_sf(F.lit(spec.z_crit) - drift) + normal_sf(F.lit(spec.z_crit) + drift)


def smallest_detectable_lift(baseline: Column, n_eff: Column, spec: ExperimentSpec) -> Column:
    """Relative lift at which the spec's power is reached; NULL past a rate of 1."""
    step = (spec.z_crit + spec.z_power) * F.sqrt(ratio(F.lit(2.0), n_eff)) / 2.0
    angle = _angle(baseline) + step
    reachable = F.when(angle <= F.lit(1.5707963267948966), F.sin(angle) ** 2)
    return ratio(reachable, baseline) - 1.0


def _baseline(cells: DataFrame, spec: ExperimentSpec) -> DataFrame:
    pairs = arm_pairs(cells, spec, ("n", "sum_y"))
    frame = pairs.select(
        *spec.keys,
        ratio(F.col("c_sum_y"), F.col("c_n")).alias("baseline_rate"),
        F.col("t_n").cast("long").alias("n_treatment"),
        F.col("c_n").cast("long").alias("n_control"),
    )
    n_t, n_c = F.col("n_treatment").cast("double"), F.col("n_control").cast("double")
    return frame.withColumns({"_k": ratio(n_t, n_c), "n_eff": ratio(2.0 * n_t * n_c, n_t + n_c)})


def _with_outcome(frame: DataFrame, spec: ExperimentSpec) -> DataFrame:
    return frame.withColumns(
        {
            "powered": (F.col("n_treatment") >= F.col("n_treatment_required"))
            & (F.col("n_control") >= F.col("n_control_required")),
            "achieved_power": achieved_power(F.col("effect_size_h"), F.col("n_eff"), spec),
        }
    )


def power_grid(
    cells: DataFrame, spec: ExperimentSpec, mdes: Sequence[float] | None = None
) -> DataFrame:
    """Required sizes, achieved power and powered flag for every (keys, effect size)."""
    grid = F.explode(F.array(*[F.lit(float(m)) for m in (mdes or spec.mde_grid)]))
    frame = _required(_baseline(cells, spec).withColumn("mde_relative", grid), spec)
    return _with_outcome(frame, spec).select(
        *spec.keys, "mde_relative", "baseline_rate", "treated_rate_target", "effect_size_h",
        "n_per_arm_balanced", "n_treatment_required", "n_control_required", "n_total_required",
        "n_treatment", "n_control", "powered", "achieved_power",
    )


def power_summary(cells: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """The design question per key at the spec's effect size, and what was detectable."""
    frame = _baseline(cells, spec).withColumn("mde_relative", F.lit(spec.mde))
    frame = _with_outcome(_required(frame, spec), spec)
    return frame.select(
        *spec.keys, "baseline_rate", "mde_relative",
        (F.col("treated_rate_target") - F.col("baseline_rate")).alias("mde_absolute"),
        "treated_rate_target", F.lit(spec.alpha).alias("alpha"), F.lit(spec.power).alias("power"),
        "effect_size_h", "n_per_arm_balanced",
        (2 * F.col("n_per_arm_balanced")).alias("n_total_balanced"),
        "n_treatment_required", "n_control_required", "n_total_required",
        F.col("_k").alias("allocation_ratio"), "n_treatment", "n_control", "n_eff",
        "powered", "achieved_power",
        smallest_detectable_lift(F.col("baseline_rate"), F.col("n_eff"), spec).alias(
            "smallest_detectable_lift"
        ),
        F.when(F.col("powered"), "powered").when(~F.col("powered"), "underpowered")
        .otherwise("no_comparison").alias("verdict"),
    )
