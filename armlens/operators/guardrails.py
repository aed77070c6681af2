"""Is the experiment fit to be read? Sample ratio and covariate balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import above_zero, on_keys, packed_gram, ratio
from ..functions.distributions import f_sf, log10_two_sided_p, two_sided_p
from ..functions.linalg import hotelling_distance
from ..spec import ExperimentSpec
from .moments import feature_moments
from .suffstats import arm_pairs, complete_cases

# Alternative designs the observed counts are tested against (fixed values).
SENSITIVITY_SHARES = (0.50, 0.80, 0.84, 0.845, 0.85, 0.855, 0.86, 0.90)

# An arm ratio this close (relative) to a simple fraction looks constructed.
RATIO_TOLERANCE = 1e-5
RATIO_MAX_NUMERATOR = 100
RATIO_MAX_DENOMINATOR = 20


def _chi_square(counts: DataFrame, share: Column) -> DataFrame:
    """Adds n_total, the expected counts and the one-degree goodness-of-fit statistics."""
    n_t, n_c = F.col("n_treatment").cast("double"), F.col("n_control").cast("double")
    total = n_t + n_c
    staged = counts.withColumns(
        {"n_total": total, "_share": share, "observed_treatment_share": ratio(n_t, total)}
    )
    share = F.col("_share")
    staged = staged.withColumns(
        {
            "expected_treatment_count": F.col("n_total") * share,
            "expected_control_count": F.col("n_total") * (1.0 - share),
            "binomial_sd_users": F.sqrt(F.col("n_total") * share * (1.0 - share)),
        }
    )
    delta = n_t - F.col("expected_treatment_count")
    return staged.withColumns(
        {
            "delta_users": delta,
            "chi2": ratio(delta * delta, F.col("expected_treatment_count"))
            + ratio(delta * delta, F.col("expected_control_count")),
            "z_score": F.coalesce(ratio(delta, F.col("binomial_sd_users")), F.lit(0.0)),
        }
    )


def srm_check(counts: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Sample-ratio mismatch against the designed share, and the opposite fault.

    ``counts`` holds ``n_treatment, n_control`` per key. A split much closer to
    the design than independent assignment allows is flagged ``underdispersed``.
    ``log10_p`` stays finite where the p-value underflows.
    """
    frame = _chi_square(counts, spec.share_column())
    z = F.col("z_score")
    empty = F.col("n_total") == 0
    frame = frame.withColumns(
        {
            "passed": F.when(~empty, F.abs(z) <= spec.srm_z_limit),
            "underdispersed": F.when(~empty, F.abs(z) < spec.closeness_z_limit),
            "p_value": F.when(~empty, two_sided_p(z)),
            "log10_p": F.when(~empty, log10_two_sided_p(z)),
            "closeness_p": F.when(~empty, 1.0 - two_sided_p(z)),
        }
    )
    frame = nearest_ratio(frame)
    return frame.select(
        *spec.keys, "n_treatment", "n_control", F.col("n_total").cast("long").alias("n_total"),
        "observed_treatment_share", F.col("_share").alias("expected_treatment_share"),
        "expected_treatment_count", "expected_control_count", "delta_users",
        F.lit(1).alias("dof"), "chi2", "p_value", "log10_p", "passed",
        F.lit(spec.srm_threshold).alias("threshold"),
        "binomial_sd_users", "z_score", "closeness_p", "underdispersed",
        "arm_ratio", "nearest_simple_ratio", "ratio_gap", "ratio_looks_constructed",
        F.when(empty, "empty").when(F.col("passed"), "pass").otherwise("fail").alias("status"),
    )


def nearest_ratio(counts: DataFrame) -> DataFrame:
    """The fraction a/b (a to 100, b to 20) closest to n_treatment / n_control.

    For a given b only the two integers around ratio*b can be closest, so 40
    candidates stand for the whole grid. Ties go to the smaller b, then a.
    """
    arm_ratio = ratio(F.col("n_treatment").cast("double"), F.col("n_control").cast("double"))

    def candidate(b: Column, step: int) -> Column:
        raw = F.floor(F.col("arm_ratio") * b).cast("int") + step
        a = F.least(F.greatest(raw, F.lit(1)), F.lit(RATIO_MAX_NUMERATOR))
        gap = F.abs(F.col("arm_ratio") - a.cast("double") / b)
        return F.struct(gap.alias("gap"), b.alias("b"), a.alias("a"))

    denominators = F.sequence(F.lit(1), F.lit(RATIO_MAX_DENOMINATOR))
    candidates = F.concat(
        F.transform(denominators, lambda b: candidate(b, 0)),
        F.transform(denominators, lambda b: candidate(b, 1)),
    )
    # Far beyond the grid every candidate is the largest numerator over 1.
    bounded = F.least(arm_ratio, F.lit(1e6))
    best = counts.withColumn("arm_ratio", bounded).withColumn(
        "_best", F.when(F.col("arm_ratio").isNotNull(), F.array_min(candidates))
    )
    return best.withColumns(
        {
            "arm_ratio": arm_ratio,
            "nearest_simple_ratio": F.concat_ws("/", F.col("_best.a"), F.col("_best.b")),
            "ratio_gap": F.abs(arm_ratio - F.col("_best.a") / F.col("_best.b").cast("double")),
        }
    ).withColumn(
        "ratio_looks_constructed",
        F.coalesce(ratio(F.col("ratio_gap"), F.col("arm_ratio")) < RATIO_TOLERANCE, F.lit(False)),
    ).drop("_best")


def srm_sensitivity(
    counts: DataFrame, spec: ExperimentSpec, shares: Sequence[float] = SENSITIVITY_SHARES
) -> DataFrame:
    """The same counts against a list of assumed designs: one row per (keys, share)."""
    grid = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    frame = counts.withColumn("assumed_treatment_share", grid)
    frame = _chi_square(frame, F.col("assumed_treatment_share"))
    z = F.col("z_score")
    return frame.select(
        *spec.keys, "assumed_treatment_share", "chi2", z,
        two_sided_p(z).alias("p_value"), (F.abs(z) <= spec.srm_z_limit).alias("passed"),
    )


def balance_features(cells: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Standardised mean difference, z and p of every feature, long."""
    moments = feature_moments(cells, spec)
    return _smd_rows(moments, spec)


def balance_direct(df: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """The same table from rows, with Spark's stable mean and variance aggregates."""
    stats = [F.count(F.lit(1)).cast("double").alias("n")]
    for f in spec.features:
        x = F.col(f).cast("double")
        stats += [F.avg(x).alias(f"m_{f}"), F.var_samp(x).alias(f"v_{f}")]
    rows = [
        F.struct(
            F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.col(f"v_{f}").alias("variance")
        )
        for f in spec.features
    ]
    wide = complete_cases(df, spec).groupBy(*spec.keys, spec.arm).agg(*stats)
    long = wide.select(*spec.keys, spec.arm, "n", F.explode(F.array(*rows)).alias("_row"))
    return _smd_rows(long.select(*spec.keys, spec.arm, "n", "_row.*"), spec)


def _smd_rows(moments: DataFrame, spec: ExperimentSpec) -> DataFrame:
    per_feature = spec.with_keys(*spec.keys, "feature")
    pairs = arm_pairs(moments, per_feature, ("n", "mean", "variance"))
    pairs = pairs.withColumns(
        {
            "difference": F.col("t_mean") - F.col("c_mean"),
            "_sd": F.sqrt((F.col("t_variance") + F.col("c_variance")) / 2.0),
            "_se": F.sqrt(
                ratio(F.col("t_variance"), F.col("t_n")) + ratio(F.col("c_variance"), F.col("c_n"))
            ),
        }
    )
    # No spread in either arm reads as no difference, as long as both arms exist.
    scaled = lambda by: F.when(F.col(by) > 0, ratio(F.col("difference"), F.col(by))).when(
        F.col(by) == 0, F.lit(0.0)
    )
    pairs = pairs.withColumns({"smd": scaled("_sd"), "z": scaled("_se")})
    return pairs.select(
        *spec.keys, "feature",
        F.col("t_mean").alias("mean_treatment"), F.col("c_mean").alias("mean_control"),
        "difference", "smd", "z", two_sided_p(F.col("z")).alias("p_value"),
        (F.abs(F.col("smd")) > spec.smd_threshold).alias("above_threshold"),
    )


def hotelling(cells: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Two-sample Hotelling test on the mean vectors, one row per key."""
    packed = cells.select(*spec.keys, spec.arm, packed_gram(spec.features).alias("gram"), "n")
    pairs = arm_pairs(packed, spec, ("gram", "n"))
    p = float(len(spec.features))
    frame = pairs.withColumn("_h", hotelling_distance(F.col("t_gram"), F.col("c_gram")))
    frame = frame.withColumns(
        {
            "n_total": F.col("t_n").cast("double") + F.col("c_n").cast("double"),
            "hotelling_t2": F.col("_h.t2"),
            "singular": F.col("_h.rank") < int(p),
        }
    )
    df2 = F.col("n_total") - p - 1.0
    frame = frame.withColumns(
        {
            "hotelling_f": F.when(
                df2 > 0, ratio(F.col("hotelling_t2") * df2, p * (F.col("n_total") - 2.0))
            ),
            "hotelling_df1": F.lit(int(p)),
            "hotelling_df2": df2.cast("long"),
        }
    )
    return frame.select(
        *spec.keys, F.col("n_total").cast("long").alias("n_total"),
        "hotelling_t2", "hotelling_f", "hotelling_df1", "hotelling_df2",
        f_sf(F.col("hotelling_f"), F.col("hotelling_df1").cast("double"),
             F.col("hotelling_df2").cast("double")).alias("hotelling_p"),
        "singular",
    )


def balance_summary(features: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Worst feature and count over the threshold, from ``balance_features`` rows."""
    size = F.abs(F.col("smd"))
    return features.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n_features"),
        F.max(size).alias("max_abs_smd"),
        F.max_by("feature", size).alias("max_abs_smd_feature"),
        F.count_if(size > spec.smd_threshold).alias("n_features_above_threshold"),
        F.coalesce(F.bool_and(size <= spec.smd_threshold), F.lit(False)).alias("passed"),
    )


def balance_check(cells: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Verdict per key: ``balanced``, ``negligible`` (joint test rejects, SMDs small) or ``imbalanced``."""
    summary = balance_summary(balance_features(cells, spec), spec)
    joined = on_keys(summary, hotelling(cells, spec), spec.keys)
    verdict = (
        F.when(F.col("max_abs_smd").isNull(), "no_comparison")
        .when(~F.col("passed"), "imbalanced")
        .when(F.col("hotelling_p") >= 0.001, "balanced")
        .otherwise("negligible")
    )
    return joined.withColumn("verdict", verdict)


def gate(effects: DataFrame, srm: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Stop rule: effect rows of keys that pass the sample-ratio check; the rest are withheld."""
    passing = srm.filter(F.col("passed"))
    if spec.keys:
        return on_keys(effects, passing.select(*spec.keys), spec.keys, "left_semi")
    return effects.withColumn("_passed", srm.select("passed").scalar()).filter("_passed").drop("_passed")
