"""Effect estimates as columns over paired moments.

All estimators of a key are produced in one pass over its single row: each is a
(mean, variance) pair per arm, and the z-test, interval and ratio interval that
follow are the same expressions for every one of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import above_zero, ratio, stack_rows
from ..functions.distributions import two_sided_p
from ..spec import ExperimentSpec

ESTIMATORS = ("unadjusted", "cuped", "lin")

# A pre-assignment covariate whose arms differ with p below this is reported as imbalanced.
COVARIATE_IMBALANCE_P = 0.001


def infer(arms: DataFrame, spec: ExperimentSpec, keep: Sequence[str] = ()) -> DataFrame:
    """z-test, confidence interval and log-scale ratio interval for estimator rows.

    Input has ``estimator, n_*, mean_*, var_*`` for both arms. A missing arm
    yields NULLs plus a ``status``; nothing divides by zero.
    """
    z = F.lit(spec.z_crit)
    se2 = ratio(F.col("var_treatment"), F.col("n_treatment")) + ratio(
        F.col("var_control"), F.col("n_control")
    )
    both_positive = (F.col("mean_treatment") > 0) & (F.col("mean_control") > 0)
    log_se2 = ratio(
        F.col("var_treatment"), F.col("n_treatment") * F.col("mean_treatment") ** 2
    ) + ratio(F.col("var_control"), F.col("n_control") * F.col("mean_control") ** 2)
    staged = arms.withColumns(
        {
            "absolute_effect": F.col("mean_treatment") - F.col("mean_control"),
            "se": F.sqrt(se2),
            "_ratio": F.when(
                both_positive, ratio(F.col("mean_treatment"), F.col("mean_control"))
            ),
            "_log_se": F.when(both_positive, F.sqrt(log_se2)),
        }
    )
    effect, se = F.col("absolute_effect"), F.col("se")
    staged = staged.withColumns(
        {
            "ci_low": effect - z * se,
            "ci_high": effect + z * se,
            "ci_width": 2.0 * z * se,
            "z": F.when(se > 0, ratio(effect, se)).when(se == 0, F.lit(0.0)),
            "relative_lift": F.col("_ratio") - 1.0,
            "relative_ci_low": F.exp(F.log(F.col("_ratio")) - z * F.col("_log_se")) - 1.0,
            "relative_ci_high": F.exp(F.log(F.col("_ratio")) + z * F.col("_log_se")) - 1.0,
            "status": F.when(F.col("n_treatment").isNull(), "no_treatment")
            .when(F.col("n_control").isNull(), "no_control")
            .when(se.isNull(), "too_few_rows")
            .when(se == 0, "zero_variance")
            .when(~both_positive, "no_ratio")
            .otherwise("ok"),
        }
    )
    staged = staged.withColumns(
        {"significant": F.abs(F.col("z")) > z, "p_value": two_sided_p(F.col("z"))}
    )
    return staged.select(
        *spec.keys, *keep, "estimator", "n_treatment", "n_control",
        "mean_treatment", "mean_control", "absolute_effect", "se",
        "ci_low", "ci_high", "ci_width", "z", "p_value",
        "relative_lift", "relative_ci_low", "relative_ci_high",
        "var_treatment", "var_control", "significant", "status",
    )


def _adjusted(theta: Column, arm: str) -> tuple[Column, Column]:
    """Mean and variance of y - theta * (x - pooled mean of x) in one arm."""
    mean = F.col(f"{arm}_mean_y") - theta * (F.col(f"{arm}_mean_x") - F.col("p_mean_x"))
    variance = (
        F.col(f"{arm}_var_y")
        - 2.0 * theta * F.col(f"{arm}_cov_yx")
        + theta * theta * F.col(f"{arm}_var_x")
    )
    return mean, variance


def slopes(pairs: DataFrame) -> DataFrame:
    """Adds the pooled slope ``theta`` and the per-arm slopes (0 for a constant covariate)."""
    slope = lambda p: F.coalesce(
        ratio(F.col(f"{p}_cov_yx"), above_zero(F.col(f"{p}_var_x"))), F.lit(0.0)
    )
    return pairs.withColumns(
        {"theta": slope("p"), "theta_treatment": slope("t"), "theta_control": slope("c")}
    )


def _estimator_arms(name: str) -> tuple[Column, Column, Column, Column]:
    if name == "unadjusted":
        return F.col("t_mean_y"), F.col("t_var_y"), F.col("c_mean_y"), F.col("c_var_y")
    if name == "cuped":
        return *_adjusted(F.col("theta"), "t"), *_adjusted(F.col("theta"), "c")
    if name == "lin":
        return *_adjusted(F.col("theta_treatment"), "t"), *_adjusted(F.col("theta_control"), "c")
    raise ValueError(f"unknown estimator {name!r}")


def estimates(
    pairs: DataFrame,
    spec: ExperimentSpec,
    which: Sequence[str] = ESTIMATORS,
    keep: Sequence[str] = (),
    suffix: str = "",
) -> DataFrame:
    """One inference row per (keys, estimator), from ``moments.paired_moments``."""
    frame = slopes(pairs) if set(which) != {"unadjusted"} else pairs
    rows = []
    for name in which:
        mean_t, var_t, mean_c, var_c = _estimator_arms(name)
        rows.append(
            F.struct(
                F.lit(name + suffix).alias("estimator"),
                F.col("t_n").alias("n_treatment"),
                F.col("c_n").alias("n_control"),
                mean_t.alias("mean_treatment"),
                var_t.alias("var_treatment"),
                mean_c.alias("mean_control"),
                var_c.alias("var_control"),
            )
        )
    return infer(stack_rows(frame, [*spec.keys, *keep], rows), spec, keep)


def cuped_diagnostics(
    pairs: DataFrame, spec: ExperimentSpec, pre_assignment: bool = True
) -> DataFrame:
    """How much the adjustment bought, how far it moved the estimate, and whether to trust it."""
    frame = slopes(pairs)
    mean_t, var_t = _adjusted(F.col("theta"), "t")
    mean_c, var_c = _adjusted(F.col("theta"), "c")
    frame = frame.withColumns(
        {
            "_adj_t": var_t, "_adj_c": var_c,
            "_noise_t": ratio(F.col("t_var_y"), F.col("t_n")),
            "_noise_c": ratio(F.col("c_var_y"), F.col("c_n")),
            "_effect": F.col("t_mean_y") - F.col("c_mean_y"),
            "_effect_adj": mean_t - mean_c,
            "_gap": F.col("t_mean_x") - F.col("c_mean_x"),
            "_gap_se": F.sqrt(
                ratio(F.col("t_var_x"), F.col("t_n")) + ratio(F.col("c_var_x"), F.col("c_n"))
            ),
        }
    )
    raw2 = F.col("_noise_t") + F.col("_noise_c")
    adj2 = ratio(F.col("_adj_t"), F.col("t_n")) + ratio(F.col("_adj_c"), F.col("c_n"))
    red_t = 1.0 - ratio(F.col("_adj_t"), F.col("t_var_y"))
    red_c = 1.0 - ratio(F.col("_adj_c"), F.col("c_var_y"))
    share_c = ratio(F.col("_noise_c"), raw2)
    chance = F.abs(F.col("theta")) * F.col("_gap_se")
    frame = frame.withColumns(
        {
            "variance_reduction_treatment": red_t,
            "variance_reduction_control": red_c,
            "control_share_of_variance": share_c,
            "achievable_variance_reduction": (1.0 - share_c) * red_t + share_c * red_c,
            "observed_variance_reduction": 1.0 - ratio(adj2, raw2),
            "observed_ci_width_reduction": 1.0 - F.sqrt(ratio(adj2, raw2)),
            "imbalance_z": F.coalesce(
                ratio(F.col("_gap"), above_zero(F.col("_gap_se"))), F.lit(0.0)
            ),
            "point_estimate_shift": F.col("_effect_adj") - F.col("_effect"),
            "_chance": chance,
        }
    )
    relative = lambda c: F.coalesce(ratio(c, F.abs(F.col("_effect"))), F.lit(0.0))
    shift = F.col("point_estimate_shift")
    z_limit = NormalDist().inv_cdf(1.0 - COVARIATE_IMBALANCE_P / 2.0)
    frame = frame.withColumns(
        {
            "point_estimate_shift_pct": F.coalesce(ratio(shift, F.col("_effect")), F.lit(0.0)),
            "expected_shift_from_chance_pct": relative(F.col("_chance")),
            "shift_vs_chance_multiple": F.coalesce(
                ratio(F.abs(shift), above_zero(F.col("_chance"))), F.lit(0.0)
            ),
            "covariate_status": (
                F.when(F.abs(F.col("imbalance_z")) > z_limit, "imbalanced").otherwise("valid")
                if pre_assignment
                else F.lit("invalid_post_assignment")
            ),
            "covariate_is_safe": F.lit(pre_assignment),
            "imbalance_p": two_sided_p(F.col("imbalance_z")),
        }
    )
    return frame.select(
        *spec.keys, "theta", F.col("corr_yx").alias("corr_pooled"),
        (F.col("corr_yx") ** 2).alias("theoretical_variance_reduction"),
        "achievable_variance_reduction", "variance_reduction_treatment",
        "variance_reduction_control", "control_share_of_variance",
        "observed_variance_reduction", "observed_ci_width_reduction",
        F.col("t_mean_x").alias("covariate_mean_treatment"),
        F.col("c_mean_x").alias("covariate_mean_control"),
        F.col("_gap").alias("covariate_imbalance"), "imbalance_z", "imbalance_p",
        "point_estimate_shift", "point_estimate_shift_pct",
        "expected_shift_from_chance_pct", "shift_vs_chance_multiple",
        "covariate_is_safe", "covariate_status",
    )


def lin_diagnostics(pairs: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Per-arm slopes, their gap, and the variance reduction of the per-arm adjustment."""
    frame = slopes(pairs)
    _, var_t = _adjusted(F.col("theta_treatment"), "t")
    _, var_c = _adjusted(F.col("theta_control"), "c")
    raw2 = ratio(F.col("t_var_y"), F.col("t_n")) + ratio(F.col("c_var_y"), F.col("c_n"))
    adj2 = ratio(var_t, F.col("t_n")) + ratio(var_c, F.col("c_n"))
    return frame.select(
        *spec.keys, "theta_treatment", "theta_control",
        (F.col("theta_treatment") - F.col("theta_control")).alias("theta_gap"),
        (1.0 - ratio(adj2, raw2)).alias("variance_reduction"),
    )


def complier_effects(
    pairs: DataFrame, spec: ExperimentSpec, which: Sequence[str] = ESTIMATORS
) -> DataFrame:
    """Wald effect on the exposed, one row per intent-to-treat estimate.

    ``cace_se`` treats compliance as known; ``cace_se_delta`` adds its sampling
    error. Zero compliance or an exposed control arm is reported in ``status``.
    """
    rows = estimates(pairs, spec, which, keep=("compliance", "control_exposed"))
    c, z = F.col("compliance"), spec.z_crit
    rows = rows.withColumns(
        {
            "cace_absolute": ratio(F.col("absolute_effect"), c),
            "cace_se": ratio(F.col("se"), c),
            "_compliance_var": ratio(c * (1.0 - c), F.col("n_treatment")),
        }
    )
    est, se = F.col("cace_absolute"), F.col("cace_se")
    return rows.select(
        *spec.keys, "estimator", F.col("compliance").alias("compliance_rate"),
        "cace_absolute", "cace_se",
        (est - z * se).alias("cace_ci_low"),
        (est + z * se).alias("cace_ci_high"),
        F.sqrt(se * se + ratio(est * est * F.col("_compliance_var"), c * c)).alias("cace_se_delta"),
        F.when(F.col("status").isin("no_treatment", "no_control"), F.col("status"))
        .when(c == 0, "no_compliance")
        .when(F.col("control_exposed") > 0, "control_exposed")
        .otherwise("ok").alias("status"),
    )
