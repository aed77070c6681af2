"""Named queries: every operator run over the whole star-schema tables.

Doubles are rounded at this edge only, so that results can be compared by value.
Tails of the chi-square and F distributions and logarithms of p-values are left out
where the comparison engine has no form of them; the statistics behind them stay.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import quoted
from ..operators import ancova as anc
from ..operators import decision, effects, guardrails, models, moments, position, power
from ..operators import quality, robustness, sequential, suffstats, uplift
from ..operators.folds import FOLD, with_fold
from ..sources import logs, samples
from ..sources.session import durable
from ..spec import ExperimentSpec
from . import sql_forms
from .experiment import ExperimentReport
from .views import FEATURES, LOG_COLUMNS, explog, explog_coarse, explog_looks, explog_ordered, explog_stored

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 8

# Decimal exponent of each feature's typical size, for rounding sums of products.
MAGNITUDE = {
    "f0": 1, "f1": 5, "f2": -1, "f3": -1, "f4": 1, "f5": 5,
    "f6": 4, "f7": 1, "f8": 3, "f9": 4, "f10": 3, "f11": 1,
}

FULL = ExperimentSpec(features=FEATURES, post_covariate="visit", exposure="exposure", fold="fold")
ONE = ExperimentSpec(
    features=("f0",), covariate="f0", post_covariate="visit", exposure="exposure", fold="fold"
)
TWO = replace(ONE, features=("f0", "f2"))
FEW = replace(FULL, features=("f0", "f2", "f6", "f7"), exposure=None, post_covariate=None)
PLAIN = ExperimentSpec()
COARSE = ExperimentSpec(
    features=("f0", "f2", "f3"), covariate="f0", post_covariate="visit", exposure="exposure"
)
PRICE = ExperimentSpec(features=("f1",), fold="fold")
LOOKS = ExperimentSpec(design_share=0.5)

RANDOM_PRIME = 2147483647
RANDOM_FACTOR = 48271
SAMPLE_SIZE = 1000
N_LOOKS = 10
AA_REPLICATES = 100


def sum_digits(name: str) -> int:
    """Decimals kept of a cell sum, from the size of what it adds up."""
    parts = name.removeprefix("sum_").split("_")
    return 3 - sum(MAGNITUDE.get(p, 0) for p in parts)


def rounded(
    df: DataFrame, digits: Mapping[str, int] | Callable[[str], int] | None = None
) -> DataFrame:
    """Round every double column; adding zero turns -0.0 into 0.0."""
    pick = digits if callable(digits) else lambda name: (digits or {}).get(name, DIGITS)
    texts = [
        f"round({quoted(f.name)}, {pick(f.name)}) + 0D AS {quoted(f.name)}"
        if isinstance(f.dataType, DoubleType) else quoted(f.name)
        for f in df.schema.fields
    ]
    return df.selectExpr(*texts)


def _log(spark: SparkSession, sf_dir: str, spec: ExperimentSpec, *extra: str) -> DataFrame:
    return explog(spark, sf_dir, [*dict.fromkeys([*suffstats.analysis_columns(spec), *extra])])


def _stored_log(spark: SparkSession, sf_dir: str, spec: ExperimentSpec) -> DataFrame:
    """``_log`` for operators that read it more than once."""
    return explog_stored(spark, sf_dir, suffstats.analysis_columns(spec))


def _cells(spark: SparkSession, sf_dir: str, spec: ExperimentSpec) -> DataFrame:
    return suffstats.sufficient_stats(_log(spark, sf_dir, spec), spec)


def _pairs(spark, sf_dir, spec, tag="xs") -> DataFrame:
    return moments.paired_moments(_cells(spark, sf_dir, spec), spec, tag)


# -- quality ---------------------------------------------------------------------------------

FLAGS = ("treatment", "conversion", "visit", "exposure")


def flag_quality(spark, sf_dir):
    return quality.flag_quality(
        explog(spark, sf_dir, FLAGS), FLAGS, {"exposed": "exposure"},
        {"converted_without_visit": ("conversion", "visit")},
    )


def implication_violations(spark, sf_dir):
    return quality.flag_quality(
        explog(spark, sf_dir, (*FLAGS, "segment")), (), {"converted": "conversion"},
        {
            "converted_without_visit": ("conversion", "visit"),
            "visit_without_conversion": ("visit", "conversion"),
            "exposed_in_control": ("exposure", "treatment"),
        },
        keys=("segment",),
    )


def completeness(spark, sf_dir):
    return suffstats.completeness(_log(spark, sf_dir, FULL), FULL)


def _collapsed(spark, sf_dir):
    coarse = explog_coarse(spark, sf_dir)
    return quality.collapse(coarse, coarse.columns)


def duplicate_summary(spark, sf_dir):
    return rounded(quality.duplicate_summary(_collapsed(spark, sf_dir)))


def duplicates_by_arm(spark, sf_dir):
    return rounded(quality.duplicate_summary(_collapsed(spark, sf_dir), ("treatment",)))


def duplicate_summary_16col(spark, sf_dir):
    """Copies agree in every column of the log."""
    return rounded(quality.duplicate_summary(quality.collapse(explog(spark, sf_dir), LOG_COLUMNS)))


def spec_cells_subset_features(spark, sf_dir):
    """Two features are analysed, but the row-handling choices still see all sixteen columns."""
    spec = ExperimentSpec(features=("f0", "f2"))
    whole = quality.collapse(explog(spark, sf_dir), LOG_COLUMNS)
    return rounded(robustness.spec_cells(whole, spec), sum_digits).select(
        "spec", "treatment", "n", "sum_y", "sum_f0", "sum_f2")


def distinct_by_arm(spark, sf_dir):
    coarse = explog_coarse(spark, sf_dir)
    return quality.distinct_per_group(coarse, coarse.columns, ("treatment",))


def duplicate_profile(spark, sf_dir):
    return rounded(quality.duplicate_profile(_collapsed(spark, sf_dir), COARSE), {"expected_conversions": 6})


def multiplicity_weights(spark, sf_dir):
    return robustness.spec_weights(_collapsed(spark, sf_dir))


def feature_cardinality(spark, sf_dir):
    return quality.feature_cardinality(explog_stored(spark, sf_dir, FEATURES), FULL, exact=True)


def feature_cardinality_sketch(spark, sf_dir):
    return quality.feature_cardinality(explog(spark, sf_dir, FEATURES), FULL)


def feature_cardinality_united(spark, sf_dir):
    """Sketches per market, united, against the exact counts: within five standard errors."""
    spec = replace(FULL, keys=("market",))
    log = explog_stored(spark, sf_dir, (*FEATURES, "market"))
    united = quality.united_cardinality(durable(quality.cardinality_sketches(log, spec)), spec)
    exact = quality.feature_cardinality(log, FULL, exact=True).withColumnRenamed("distinct_values", "_exact")
    off = F.abs(F.col("distinct_values") / F.col("_exact") - 1)
    return united.join(exact, "feature").select("feature", F.col("_exact").alias("distinct_values"), (off <= 0.04).alias("close"))


def position_dependence(spark, sf_dir):
    return rounded(
        position.share_by_block(explog_ordered(spark, sf_dir), PLAIN, order_by=["o_orderkey"])
    )


def _assembled(spark, sf_dir):
    orders = explog_ordered(spark, sf_dir)
    last = orders.agg(F.max("o_orderkey")).scalar()
    early = F.col("o_orderkey") < last * 0.35
    return orders.withColumn("treatment", F.when(early, 1).otherwise(F.col("treatment")))


def position_summary(spark, sf_dir):
    blocks = position.share_by_block(
        explog_ordered(spark, sf_dir), PLAIN, order_by=["o_orderkey"]
    )
    return rounded(position.position_summary(blocks, PLAIN))


def position_summary_assembled(spark, sf_dir):
    blocks = position.share_by_block(_assembled(spark, sf_dir), PLAIN, order_by=["o_orderkey"])
    return rounded(position.position_summary(blocks, PLAIN))


def position_stored_order(spark, sf_dir):
    return rounded(position.share_by_block(
        explog(spark, sf_dir, ("treatment",)), PLAIN
    ))


# -- samples ---------------------------------------------------------------------------------


def _hash_sample(spark, sf_dir):
    orders = explog_ordered(spark, sf_dir)
    rank = F.pmod(F.col("o_orderkey") * RANDOM_FACTOR + 11, F.lit(RANDOM_PRIME))
    return samples.fixed_size_sample(
        orders, SAMPLE_SIZE, 0, rank, ["o_orderkey"]
    )


def hash_sample_topn(spark, sf_dir):
    return _hash_sample(spark, sf_dir)


def sample_arm_coverage(spark, sf_dir):
    return samples.arm_coverage(_hash_sample(spark, sf_dir), PLAIN, least=100)


def bernoulli_sample(spark, sf_dir):
    return samples.fraction_sample(explog_ordered(spark, sf_dir), 0.5, 7)


def stratified_sample(spark, sf_dir):
    return samples.arm_sample(explog_ordered(spark, sf_dir), PLAIN, {0: 0.8, 1: 0.1}, 7)


# -- sums and moments --------------------------------------------------------------------------


def arm_summary(spark, sf_dir):
    spec = replace(PLAIN, post_covariate="visit", exposure="exposure")
    return rounded(suffstats.arm_summary(_cells(spark, sf_dir, spec), spec))


def arm_summary_by_segment(spark, sf_dir):
    spec = replace(PLAIN, post_covariate="visit", exposure="exposure", keys=("market",))
    return rounded(suffstats.arm_summary(_cells(spark, sf_dir, spec), spec))


def sufficient_stats(spark, sf_dir):
    return rounded(_cells(spark, sf_dir, replace(FULL, fold=None)), sum_digits)


def sufficient_stats_sql(spark, sf_dir):
    spec = replace(FULL, fold=None)
    return rounded(sql_forms.sufficient_stats_sql(_log(spark, sf_dir, spec), spec), sum_digits)


def sufficient_stats_by_segment(spark, sf_dir):
    spec = replace(FEW, keys=("segment",), fold=None)
    return rounded(_cells(spark, sf_dir, spec), sum_digits)


def weighted_stats_by_spec(spark, sf_dir):
    return rounded(robustness.spec_cells(_collapsed(spark, sf_dir), COARSE), sum_digits)


def fold_stats(spark, sf_dir):
    return rounded(models.fold_cells(_log(spark, sf_dir, FEW), FEW), sum_digits)


def fold_complement_stats(spark, sf_dir):
    cells = models.fold_cells(_log(spark, sf_dir, FEW), FEW)
    return rounded(suffstats.fold_complement(cells, FEW, FOLD), sum_digits)


def arm_moments(spark, sf_dir):
    return rounded(moments.arm_moments(_cells(spark, sf_dir, ONE), ONE), {"var_x": 6, "mean_x": 6})


def arm_moments_direct(spark, sf_dir):
    spec = replace(PLAIN, covariate="f1")
    return rounded(
        moments.arm_moments_direct(_log(spark, sf_dir, spec), spec, "f1"),
        {"mean_x": 3, "var_x": -2, "cov_yx": 4},
    )


def pooled_moments(spark, sf_dir):
    return rounded(moments.pooled_moments(_cells(spark, sf_dir, ONE), ONE), {"var_x": 6, "mean_x": 6})


def feature_covariance(spark, sf_dir):
    cells = _cells(spark, sf_dir, FEW)
    return rounded(moments.feature_covariance(cells, FEW), {"covariance": 2})


def feature_moments(spark, sf_dir):
    cells = _cells(spark, sf_dir, FEW)
    return rounded(moments.feature_moments(cells, FEW), {"mean": 4, "variance": 2})


def shifted_moments(spark, sf_dir):
    """Feature variances from sums of shifted products: prices keep their digits."""
    spec = replace(FULL, features=("f1", "f5", "f8"))
    log = _stored_log(spark, sf_dir, spec)
    spec = replace(spec, shift=suffstats.feature_shifts(log, spec))
    cells = suffstats.sufficient_stats(log, spec)
    return rounded(moments.feature_moments(cells, spec), {"mean": 4, "variance": -2})


# -- guardrails ----------------------------------------------------------------------------------

# Two assignments of the same rows: as designed, and with heavy lines pushed to control.
ASSIGNMENT = "assignment"


def _two_assignments(spark, sf_dir, *columns: str) -> DataFrame:
    log = explog(spark, sf_dir, (*columns, "treatment", "treatment_skewed"))
    rows = F.array(
        F.struct(F.lit("designed").alias(ASSIGNMENT), F.col("treatment").alias("treatment")),
        F.struct(F.lit("skewed").alias(ASSIGNMENT), F.col("treatment_skewed").alias("treatment")),
    )
    return log.select(*columns, F.explode(rows).alias("_a")).select(*columns, "_a.*")


ASSIGNED = replace(PLAIN, keys=(ASSIGNMENT,))


def srm_check(spark, sf_dir):
    counts = suffstats.arm_counts(_two_assignments(spark, sf_dir), ASSIGNED)
    checked = guardrails.srm_check(counts, ASSIGNED).drop("log10_p")
    return rounded(checked, {"delta_users": 5, "expected_treatment_count": 5, "expected_control_count": 5, "chi2": 6})


def srm_by_segment(spark, sf_dir):
    spec = replace(PLAIN, keys=("segment",))
    counts = suffstats.arm_counts(_log(spark, sf_dir, spec), spec)
    return rounded(guardrails.srm_check(counts, spec).select(
        "segment", "n_treatment", "n_control", "chi2", "z_score", "passed", "underdispersed"
    ), {"chi2": 6})


def srm_sensitivity(spark, sf_dir):
    counts = suffstats.arm_counts(_log(spark, sf_dir, PLAIN), PLAIN)
    return rounded(guardrails.srm_sensitivity(counts, PLAIN), {"chi2": 4, "z_score": 6})


def srm_nearest_ratio(spark, sf_dir):
    spec = replace(PLAIN, keys=("market",))
    counts = suffstats.arm_counts(_log(spark, sf_dir, spec), spec)
    return rounded(guardrails.nearest_ratio(counts))


def balance_smd(spark, sf_dir):
    spec = replace(FULL, exposure=None, post_covariate=None, fold=None)
    return rounded(
        guardrails.balance_direct(_log(spark, sf_dir, spec), spec),
        {"mean_treatment": 4, "mean_control": 4, "difference": 4, "z": 6},
    )


def balance_from_sums(spark, sf_dir):
    spec = replace(ASSIGNED, features=("f0", "f2", "f3", "f4"))
    cells = suffstats.sufficient_stats(
        _two_assignments(spark, sf_dir, "conversion", *spec.features), spec, cross_products=True
    )
    return rounded(guardrails.balance_features(cells, spec), {"z": 6})


def balance_sql(spark, sf_dir):
    spec = replace(FULL, exposure=None, post_covariate=None, fold=None)
    return rounded(
        sql_forms.balance_sql(_log(spark, sf_dir, spec), spec), {"difference": 4}
    )


def balance_verdict(spark, sf_dir):
    spec = replace(ASSIGNED, features=("f0", "f2", "f3", "f4"))
    cells = suffstats.sufficient_stats(
        _two_assignments(spark, sf_dir, "conversion", *spec.features), spec
    )
    return rounded(guardrails.balance_summary(guardrails.balance_features(cells, spec), spec))


def balance_check(spark, sf_dir):
    spec = replace(ASSIGNED, features=FEATURES)
    cells = durable(suffstats.sufficient_stats(
        _two_assignments(spark, sf_dir, "conversion", *FEATURES), spec
    ))
    return guardrails.balance_check(cells, spec)


def hotelling_2cov(spark, sf_dir):
    spec = replace(ASSIGNED, features=("f0", "f2"))
    cells = suffstats.sufficient_stats(
        _two_assignments(spark, sf_dir, "conversion", "f0", "f2"), spec
    )
    return rounded(
        guardrails.hotelling(cells, spec), {"hotelling_t2": 5, "hotelling_f": 5}
    )


def balance_check_2cov(spark, sf_dir):
    """The verdict on each assignment, from two covariates."""
    spec = replace(ASSIGNED, features=("f0", "f2"))
    cells = durable(suffstats.sufficient_stats(_two_assignments(spark, sf_dir, "conversion", "f0", "f2"), spec))
    return rounded(guardrails.balance_check(cells, spec).drop("hotelling_t2", "singular"), {"hotelling_f": 5})


def gated_effects(spark, sf_dir):
    log = _two_assignments(spark, sf_dir, "conversion")
    cells = suffstats.sufficient_stats(log, ASSIGNED)
    rows = effects.estimates(
        moments.paired_moments(cells, ASSIGNED, None), ASSIGNED, ("unadjusted",)
    )
    srm = guardrails.srm_check(suffstats.arm_counts(log, ASSIGNED), ASSIGNED)
    return _effect(guardrails.gate(rows, srm, ASSIGNED))


# -- effects -------------------------------------------------------------------------------------


def _effect(rows: DataFrame) -> DataFrame:
    return rounded(rows, {"z": 6})


def itt_unadjusted(spark, sf_dir):
    return _effect(effects.estimates(_pairs(spark, sf_dir, PLAIN, None), PLAIN, ("unadjusted",)))


def itt_by_segment(spark, sf_dir):
    spec = replace(PLAIN, keys=("market", "segment"))
    return _effect(effects.estimates(_pairs(spark, sf_dir, spec, None), spec, ("unadjusted",)))


def cuped(spark, sf_dir):
    return _effect(effects.estimates(_pairs(spark, sf_dir, ONE), ONE, ("cuped",)))


def cuped_diagnostics(spark, sf_dir):
    return rounded(
        effects.cuped_diagnostics(_pairs(spark, sf_dir, ONE), ONE),
        {"imbalance_z": 6, "shift_vs_chance_multiple": 6},
    )


def cuped_post_treatment(spark, sf_dir):
    pairs = _pairs(spark, sf_dir, ONE, "xn")
    return _effect(effects.estimates(pairs, ONE, ("cuped",), suffix="[visit]"))


def cuped_post_diagnostics(spark, sf_dir):
    pairs = _pairs(spark, sf_dir, ONE, "xn")
    return rounded(
        effects.cuped_diagnostics(pairs, ONE, pre_assignment=False),
        {"imbalance_z": 6, "shift_vs_chance_multiple": 6},
    )


def lin_adjusted(spark, sf_dir):
    return rounded(effects.lin_diagnostics(_pairs(spark, sf_dir, ONE), ONE))


def cace(spark, sf_dir):
    return rounded(effects.complier_effects(_pairs(spark, sf_dir, ONE), ONE))


def estimator_forest(spark, sf_dir):
    cells = durable(_cells(spark, sf_dir, ONE))
    rows = effects.estimates(moments.paired_moments(cells, ONE), ONE)
    forest = rows.unionByName(anc.ancova(cells, ONE).drop("n_covariates", "r2_control"))
    return _effect(forest)


# -- models --------------------------------------------------------------------------------------


def ols_1cov_by_arm(spark, sf_dir):
    fits = models.fit_cells(_cells(spark, sf_dir, ONE), ONE)
    return rounded(fits.select(
        "treatment", "n",
        F.get("coef", F.lit(0)).alias("intercept"), F.get("coef", F.lit(1)).alias("slope"),
        "ssr", "r2",
    ), {"ssr": 5, "slope": 10, "r2": 10})


def ols_coefficients(spark, sf_dir):
    """Twelve coefficients per arm, long."""
    fits = models.fit_cells(_cells(spark, sf_dir, FULL), FULL)
    return models.coefficient_table(fits, FULL, ("treatment",))


def crossfit_index_1cov(spark, sf_dir):
    fitted = models.covariate_models(models.fold_cells(_log(spark, sf_dir, ONE), ONE), ONE)
    return rounded(fitted.select(
        FOLD, "fit_rows", F.get("coef", F.lit(0)).alias("intercept"),
        F.get("coef", F.lit(1)).alias("slope"), "r2",
    ), {"slope": 10, "r2": 10})


def crossfit_index_sums(spark, sf_dir):
    """Sums of the cross-fitted index from sums alone; the check scores every row."""
    per_fold = durable(models.fold_cells(_log(spark, sf_dir, ONE), replace(ONE, covariate=None)))
    spec = replace(ONE, covariate=None)
    cells = models.index_cells(per_fold, models.covariate_models(per_fold, spec), spec)
    return rounded(cells.select("treatment", "n", "sum_xs", "sum_xsxs", "sum_yxs"),
                   {"sum_xs": 5, "sum_xsxs": 5, "sum_yxs": 5})


def crossfit_scores(spark, sf_dir):
    """Row scores of the fold models, averaged per (fold, arm)."""
    log = _log(spark, sf_dir, ONE)
    fitted = models.pin_models(models.covariate_models(models.fold_cells(log, ONE), ONE), ONE)
    scored = models.score_rows(log, fitted, ONE, "score")
    return rounded(scored.groupBy(FOLD, "treatment").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"),
        F.min("score").alias("min_score"), F.max("score").alias("max_score"),
    ))


def uplift_model_1cov(spark, sf_dir):
    fitted = models.uplift_models(models.fold_cells(_log(spark, sf_dir, PRICE), PRICE), PRICE)
    return rounded(fitted.select(
        FOLD, "fit_rows", F.get("coef", F.lit(0)).alias("intercept_gap"),
        F.get("coef", F.lit(1)).alias("slope_gap"),
    ), {"slope_gap": 13, "intercept_gap": 8})


def ancova_1cov(spark, sf_dir):
    rows = anc.ancova(_cells(spark, sf_dir, ONE), ONE, ("pooled", "within", "lin"))
    return _effect(rows.drop("r2_control", "n_covariates"))


def ancova_12cov(spark, sf_dir):
    return anc.ancova(_cells(spark, sf_dir, FULL), FULL, ("pooled", "within", "lin"))


def ancova_index_gain(spark, sf_dir):
    per_fold = durable(models.fold_cells(_log(spark, sf_dir, ONE), ONE))
    r2 = models.mean_index_r2(models.covariate_models(per_fold, ONE), ONE)
    rows = anc.ancova(suffstats.merge_cells(per_fold, ONE), ONE, ("lin",))
    return rounded(anc.index_gain(rows, r2, ONE), lambda _: 10)


# -- row-handling choices ---------------------------------------------------------------------------

CURVE_P = ("srm_p", "srm_log10_p", "p_value")


def _curve(spark, sf_dir):
    cells = durable(robustness.spec_cells(_collapsed(spark, sf_dir), COARSE))
    return robustness.spec_curve(cells, COARSE)


def spec_curve(spark, sf_dir):
    return rounded(_curve(spark, sf_dir).drop(*CURVE_P), {"srm_z": 6})


def spec_curve_summary(spark, sf_dir):
    return rounded(
        robustness.spec_curve_summary(_curve(spark, sf_dir), COARSE),
        {"adjustment_stability_gain": 3},
    )


def spec_curve_crossfit(spark, sf_dir):
    spec = replace(COARSE, covariate=None)
    cells = durable(robustness.cross_fitted_spec_cells(_collapsed(spark, sf_dir), spec))
    return robustness.spec_curve(cells, spec)


# -- uplift ------------------------------------------------------------------------------------------


def _bins(spark, sf_dir):
    return uplift.uplift_bins(_log(spark, sf_dir, PRICE), PRICE, exact=True)


def uplift_bins(spark, sf_dir):
    return rounded(_bins(spark, sf_dir))


def uplift_table(spark, sf_dir):
    return rounded(uplift.uplift_table(_bins(spark, sf_dir), PRICE), {"incremental_conversions": 5})


def qini_curve(spark, sf_dir):
    table = uplift.uplift_table(_bins(spark, sf_dir), PRICE)
    return rounded(uplift.qini_curve(table, PRICE), {"incremental_conversions": 5})


def qini_coefficient(spark, sf_dir):
    table = uplift.uplift_table(_bins(spark, sf_dir), PRICE)
    return rounded(uplift.uplift_summary(table, PRICE).select(
        "n_bins", "ate_absolute", "total_incremental", "qini_ratio", "chi2", "chi2_weighted",
        "heterogeneity_df", "heterogeneity_p",
    ), {"total_incremental": 5, "chi2": 6, "chi2_weighted": 6})


def uplift_concentration(spark, sf_dir):
    table = uplift.uplift_table(_bins(spark, sf_dir), PRICE)
    return rounded(uplift.uplift_summary(table, PRICE).select(
        "top_bin_uplift", "bottom_bin_uplift", "top_vs_bottom_ratio",
        "share_of_effect_in_top_bins", "population_in_top_bins", "share_of_effect_in_top_share",
    ), {"top_vs_bottom_ratio": 6})


def uplift_table_sketch(spark, sf_dir):
    """All twelve features, hashed folds and sketched cut points."""
    spec = replace(FULL, fold=None, exposure=None, post_covariate=None)
    return uplift.uplift_table(uplift.uplift_bins(_stored_log(spark, sf_dir, spec), spec), spec)


def uplift_bins_by_segment(spark, sf_dir):
    """Exact cut points of every segment's scores."""
    spec = replace(PRICE, keys=("segment",))
    return rounded(uplift.uplift_bins(_stored_log(spark, sf_dir, spec), spec, exact=True))


def uplift_by_segment(spark, sf_dir):
    spec = replace(FEW, keys=("segment",), fold=None)
    return uplift.uplift_summary(
        uplift.uplift_table(uplift.uplift_bins(_stored_log(spark, sf_dir, spec), spec, 5), spec), spec
    )


# -- power -------------------------------------------------------------------------------------------


def power_by_segment(spark, sf_dir):
    spec = replace(PLAIN, keys=("market",))
    return rounded(power.power_summary(_cells(spark, sf_dir, spec), spec), {"n_eff": 4})


def power_mde_grid(spark, sf_dir):
    return rounded(power.power_grid(_cells(spark, sf_dir, PLAIN), PLAIN))


def smallest_detectable(spark, sf_dir):
    spec = replace(PLAIN, keys=("segment",))
    return rounded(power.power_summary(_cells(spark, sf_dir, spec), spec).select(
        "segment", "baseline_rate", "n_eff", "smallest_detectable_lift"
    ), {"n_eff": 4})


def power_achieved(spark, sf_dir):
    spec = replace(PLAIN, keys=("market",))
    return rounded(power.power_grid(_cells(spark, sf_dir, spec), spec))


def power_designs(spark, sf_dir):
    """Required sizes for other allocations, at each market's control rate."""
    spec = replace(PLAIN, keys=("market",))
    base = power.power_summary(_cells(spark, sf_dir, spec), spec).select("market", "baseline_rate")
    design = base.withColumn("mde_relative", F.lit(0.05)).withColumn(
        "treatment_share", F.explode(F.array(*[F.lit(s) for s in (0.5, 0.7, 0.85, 0.95)]))
    )
    return rounded(power.design_table(design, spec))


# -- looks -------------------------------------------------------------------------------------------


def always_valid_interval(spark, sf_dir):
    pairs = _pairs(spark, sf_dir, PLAIN, None)
    return rounded(sequential.always_valid(pairs, PLAIN, "n_eff"), {"n_eff": 4})


def always_valid_tuned(spark, sf_dir):
    spec = replace(PLAIN, keys=("market",))
    pairs = _pairs(spark, sf_dir, spec, None)
    return rounded(sequential.always_valid(pairs, spec, sequential.tuned_rho(8000.0)), {"n_eff": 4})


def look_replay(spark, sf_dir):
    return rounded(sequential.look_replay(
        explog_looks(spark, sf_dir), LOOKS, N_LOOKS, ["ts", "event_id"]
    ))


def look_crossings(spark, sf_dir):
    looks = sequential.look_replay(explog_looks(spark, sf_dir), LOOKS, N_LOOKS, ["ts", "event_id"])
    return rounded(sequential.ever_crossed(looks, LOOKS))


def _integer_assignment(unit, replicate):
    """Quadratic hash in integer arithmetic, which both engines evaluate alike."""
    p = F.lit(RANDOM_PRIME)
    mixed = (unit * RANDOM_FACTOR + (replicate.cast("long") + 1) * 69621) % p
    return F.floor((mixed * mixed) % p / 65536).cast("int") % 2


def aa_false_positive_rate(spark, sf_dir):
    units = sequential.unit_looks(
        explog_looks(spark, sf_dir), LOOKS, "event_id", N_LOOKS, ["ts", "event_id"]
    )
    replicates = sequential.aa_replicates(
        units, LOOKS, "event_id", AA_REPLICATES, _integer_assignment
    )
    return rounded(sequential.aa_false_positive_rate(replicates, LOOKS))


def aa_false_positive_rate_hashed(spark, sf_dir):
    units = sequential.unit_looks(
        explog_looks(spark, sf_dir), LOOKS, "event_id", N_LOOKS, ["ts", "event_id"]
    )
    replicates = sequential.aa_replicates(units, LOOKS, "event_id", AA_REPLICATES)
    return sequential.aa_false_positive_rate(replicates, LOOKS)


def _integer_assignment_85(unit, replicate):
    """As ``_integer_assignment``, with seventeen of twenty units treated."""
    p = F.lit(RANDOM_PRIME)
    mixed = (unit * RANDOM_FACTOR + (replicate.cast("long") + 1) * 69621) % p
    return (F.floor((mixed * mixed) % p / 65536).cast("int") % 20 < 17).cast("int")


def aa_false_positive_rate_by_user(spark, sf_dir):
    """Users are re-randomised 85/15 with all their events, so a unit is counted up once per look."""
    units = sequential.unit_looks(
        explog_looks(spark, sf_dir), LOOKS, "user_id", N_LOOKS, ["ts", "event_id"]
    )
    replicates = sequential.aa_replicates(units, LOOKS, "user_id", AA_REPLICATES, _integer_assignment_85)
    return rounded(sequential.aa_false_positive_rate(replicates, LOOKS))


# -- decision ----------------------------------------------------------------------------------------


def ship_decision(spark, sf_dir):
    cells = durable(robustness.spec_cells(_collapsed(spark, sf_dir), COARSE))
    curve = durable(robustness.spec_curve(cells, COARSE))
    every_row = cells.filter(F.col("spec") == "all").drop("spec")
    rows = effects.estimates(moments.paired_moments(every_row, COARSE), COARSE)
    balance = guardrails.balance_summary(guardrails.balance_features(every_row, COARSE), COARSE)
    summary = robustness.spec_curve_summary(curve, COARSE)
    return rounded(decision.ship_decision(rows, COARSE, summary, balance).drop("final_p"))


def experiment_summary(spark, sf_dir):
    """The whole analysis with all twelve features; its last table."""
    spec = replace(FULL, fold=None)
    return ExperimentReport(explog_stored(spark, sf_dir, LOG_COLUMNS), spec).summary


def experiment_summary_by_segment(spark, sf_dir):
    """The same per market: one pass for all of them. Copies agree in the whole log, not just in what is analysed."""
    spec = replace(FEW, fold=None, keys=("market",), exposure="exposure", post_covariate="visit")
    return ExperimentReport(explog_stored(spark, sf_dir, (*LOG_COLUMNS, "market")), spec).summary


def duplicates_rare(spark, sf_dir):
    """Exact duplicates over all columns, by arm; only rows whose hash repeats are shuffled whole."""
    log = explog_stored(spark, sf_dir, LOG_COLUMNS)
    return rounded(quality.duplicate_summary(quality.collapse_rare(log, LOG_COLUMNS, log.count()), ("treatment",)))


def result_documents(spark, sf_dir):
    spec = replace(PLAIN, keys=("market",))
    rows = effects.estimates(_pairs(spark, sf_dir, spec, None), spec, ("unadjusted",))
    return logs.result_documents(rows, spec)


def fold_hash_counts(spark, sf_dir):
    """Rows per hashed fold and arm."""
    spec = replace(FULL, fold=None)
    return with_fold(_log(spark, sf_dir, spec), spec).groupBy(FOLD, "treatment").agg(
        F.count(F.lit(1)).alias("n")
    )


# -- nothing is lost: many folds, NULL keys, failing keys -------------------------------------------

FIVE = replace(ONE, fold="fold5")
NULL_KEY = replace(PLAIN, keys=("segment_null",))


def crossfit_five_folds(spark, sf_dir):
    fitted = models.covariate_models(models.fold_cells(_log(spark, sf_dir, FIVE), FIVE), FIVE)
    return rounded(fitted.select(
        FOLD, "fit_rows", F.get("coef", F.lit(0)).alias("intercept"),
        F.get("coef", F.lit(1)).alias("slope"), "r2",
    ), {"slope": 10, "r2": 10})


def uplift_scores_five_folds(spark, sf_dir):
    """Every row has a score, whatever the number of folds."""
    spec = replace(PRICE, fold="fold5")
    scored = uplift.uplift_scores(_log(spark, sf_dir, spec), spec)
    return rounded(scored.groupBy(FOLD, "treatment").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(uplift.SCORE).isNull()).alias("n_unscored"),
        F.avg(uplift.SCORE).alias("mean_score"),
    ))


def gated_effects_null_key(spark, sf_dir):
    log = _stored_log(spark, sf_dir, NULL_KEY)
    cells = suffstats.sufficient_stats(log, NULL_KEY)
    rows = effects.estimates(moments.paired_moments(cells, NULL_KEY, None), NULL_KEY, ("unadjusted",))
    srm = guardrails.srm_check(suffstats.arm_counts(log, NULL_KEY), NULL_KEY)
    return _effect(guardrails.gate(rows, srm, NULL_KEY))


def balance_null_key(spark, sf_dir):
    spec = replace(NULL_KEY, features=("f0", "f2"))
    cells = durable(suffstats.sufficient_stats(_log(spark, sf_dir, spec), spec))
    return rounded(guardrails.balance_check(cells, spec).select(
        "segment_null", "n_features", "max_abs_smd", "max_abs_smd_feature", "passed", "n_total"))


def decision_withheld(spark, sf_dir):
    """A key whose sample ratio fails keeps its row."""
    log = _two_assignments(spark, sf_dir, "conversion")
    cells = durable(suffstats.sufficient_stats(log, ASSIGNED))
    rows = effects.estimates(moments.paired_moments(cells, ASSIGNED, None), ASSIGNED, ("unadjusted",))
    srm = guardrails.srm_check(suffstats.arm_counts(log, ASSIGNED), ASSIGNED)
    gated = guardrails.gate(rows, srm, ASSIGNED)
    return rounded(decision.ship_decision(gated, ASSIGNED, srm=srm).select(
        "assignment", "decision", "lift", "worst_case_lower_bound"))


QUERIES: tuple[Query, ...] = (
    crossfit_five_folds, uplift_scores_five_folds, gated_effects_null_key, balance_null_key, decision_withheld,
    flag_quality, implication_violations, completeness,
    duplicate_summary, duplicate_summary_16col, spec_cells_subset_features, duplicates_by_arm, distinct_by_arm, duplicate_profile,
    multiplicity_weights, feature_cardinality, feature_cardinality_sketch, feature_cardinality_united,
    position_dependence, position_summary, position_summary_assembled, position_stored_order,
    hash_sample_topn, sample_arm_coverage, bernoulli_sample, stratified_sample,
    arm_summary, arm_summary_by_segment,
    sufficient_stats, sufficient_stats_sql, sufficient_stats_by_segment, weighted_stats_by_spec,
    fold_hash_counts, fold_stats, fold_complement_stats,
    arm_moments, arm_moments_direct, pooled_moments, feature_covariance, feature_moments,
    shifted_moments,
    srm_check, srm_by_segment, srm_sensitivity, srm_nearest_ratio,
    balance_smd, balance_from_sums, balance_sql, balance_verdict, balance_check, balance_check_2cov,
    hotelling_2cov, gated_effects,
    itt_unadjusted, itt_by_segment, cuped, cuped_diagnostics, cuped_post_treatment,
    cuped_post_diagnostics, lin_adjusted, cace, estimator_forest,
    ols_1cov_by_arm, ols_coefficients, crossfit_index_1cov, crossfit_index_sums, crossfit_scores,
    uplift_model_1cov, ancova_1cov, ancova_12cov, ancova_index_gain,
    spec_curve, spec_curve_summary, spec_curve_crossfit,
    uplift_bins, uplift_table, qini_curve, qini_coefficient, uplift_concentration,
    uplift_table_sketch, uplift_bins_by_segment, uplift_by_segment,
    power_by_segment, power_mde_grid, smallest_detectable, power_achieved, power_designs,
    always_valid_interval, always_valid_tuned, look_replay, look_crossings,
    aa_false_positive_rate, aa_false_positive_rate_by_user, aa_false_positive_rate_hashed,
    ship_decision, experiment_summary, experiment_summary_by_segment, duplicates_rare, result_documents,
)
