"""Who the treatment works on: cross-fitted uplift scores, bins, Qini."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import above_zero, on_keys, ratio
from ..functions.distributions import chi2_sf
from ..sources.session import durable, stored
from ..spec import ExperimentSpec
from .models import fold_cells, pin_models, score_rows, uplift_models
from .selection import values_at_ranks
from .suffstats import complete_cases

SCORE = "uplift_score"
N_BINS = 10
SKETCH_ACCURACY = 1000


def uplift_scores(
    df: DataFrame, spec: ExperimentSpec, models: DataFrame | None = None
) -> DataFrame:
    """Rows with the predicted uplift of a model that never saw their fold."""
    rows = complete_cases(df, spec)
    if models is None:
        models = pin_models(uplift_models(durable(fold_cells(rows, spec)), spec), spec)
    # NULL stands for "no score" from here on: no model for the key, or not a number.
    scored = score_rows(rows, models, spec, SCORE)
    return scored.withColumn(SCORE, F.nanvl(SCORE, F.lit(None).cast("double")))


def score_edges(
    scored: DataFrame, spec: ExperimentSpec, n_bins: int = N_BINS, accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """Quantile cut points of the score per key, from a mergeable sketch.

    Ties collapse: equal cut points are kept once, so there can be fewer bins.
    """
    points = F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])
    edges = scored.groupBy(*spec.keys).agg(
        F.percentile_approx(SCORE, points, accuracy).alias("_edges")
    )
    return edges.withColumn("edges", F.array_distinct("_edges")).drop("_edges")


def exact_edges(scored: DataFrame, spec: ExperimentSpec, n_bins: int = N_BINS) -> DataFrame:
    """Exact cut points of the score per key, without a sort: ``scored`` is read once more for each round of the selection."""
    cuts = values_at_ranks(scored, SCORE, [(i, n_bins) for i in range(1, n_bins)], spec.keys)
    return cuts.groupBy(*spec.keys).agg(F.sort_array(F.collect_set("value")).alias("edges"))


def assign_bins(
    scored: DataFrame, edges: DataFrame, spec: ExperimentSpec, n_bins: int = N_BINS
) -> DataFrame:
    """Bin = number of cut points strictly below the score; NULL for a row without a score."""
    joined = on_keys(scored, edges, spec.keys)
    bin_number = F.lit(0)
    for i in range(n_bins - 1):
        edge = F.coalesce(F.get(F.col("edges"), F.lit(i)), F.lit(float("inf")))
        bin_number = bin_number + (F.col(SCORE) > edge).cast("int")
    return joined.withColumn("bin", bin_number).drop("edges")


def unscored(scored: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Rows left out of the bins because they have no score."""
    missing = F.col(SCORE).isNull()
    return scored.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("n_unscored")
    )


def bin_stats(binned: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """n, conversions and mean score per (keys, bin, arm); rows without a score drop out.

    They are dropped after counting: a filter on the score would be pushed down
    and compute every score twice.
    """
    counted = binned.groupBy(*spec.keys, "bin", spec.arm).agg(
        F.count(SCORE).alias("n"),
        F.sum(F.col(spec.metric).cast("double")).alias("conversions"),
        F.avg(SCORE).alias("mean_score"),
    )
    return counted.filter(F.col("n") > 0)


def uplift_bins(
    df: DataFrame,
    spec: ExperimentSpec,
    n_bins: int = N_BINS,
    exact: bool = False,
    fitted: DataFrame | None = None,
) -> DataFrame:
    """Fit (unless ``fitted`` models are given), score, cut and count per (bin, arm).

    Cut points and counts all read the scores, so arm, outcome and score are
    written to the shared folder once.
    """
    scored = uplift_scores(df, spec, fitted).select(*spec.keys, spec.arm, spec.metric, SCORE)
    return durable(binned_counts(stored(scored), spec, n_bins, exact))


def binned_counts(
    scored: DataFrame, spec: ExperimentSpec, n_bins: int = N_BINS, exact: bool = False
) -> DataFrame:
    """Cut already scored rows into bins and count them. Reads ``scored`` twice, or a few times for exact cut points."""
    edges = exact_edges(scored, spec, n_bins) if exact else score_edges(scored, spec, n_bins)
    return bin_stats(assign_bins(scored, stored(edges), spec, n_bins), spec)


def uplift_table(bins: DataFrame, spec: ExperimentSpec, order: str = "pooled") -> DataFrame:
    """Rates, uplift, standard error and incremental conversions of each bin.

    Bins that lack an arm are left out. ``mean_score`` orders the bins: the
    mean over both arms, or with ``order="treatment"`` the treatment arm's mean.
    """
    arm = lambda v, c: F.coalesce(F.max(F.when(F.col(spec.arm) == v, F.col(c))), F.lit(0.0))
    wide = bins.groupBy(*spec.keys, "bin").agg(
        arm(1, "n").alias("n_treatment"), arm(0, "n").alias("n_control"),
        arm(1, "conversions").alias("_y_t"), arm(0, "conversions").alias("_y_c"),
        arm(1, "mean_score").alias("_score_t"),
        F.sum(F.col("n") * F.col("mean_score")).alias("_score_sum"),
    ).filter((F.col("n_treatment") > 0) & (F.col("n_control") > 0))
    n_t, n_c = F.col("n_treatment"), F.col("n_control")
    wide = wide.withColumns({"rate_treatment": F.col("_y_t") / n_t, "rate_control": F.col("_y_c") / n_c})
    p_t, p_c = F.col("rate_treatment"), F.col("rate_control")
    score = F.col("_score_t") if order == "treatment" else F.col("_score_sum") / (n_t + n_c)
    return wide.select(
        *spec.keys, "bin",
        n_t.cast("long").alias("n_treatment"), n_c.cast("long").alias("n_control"),
        "rate_treatment", "rate_control",
        (p_t - p_c).alias("uplift"),
        F.sqrt(p_t * (1.0 - p_t) / n_t + p_c * (1.0 - p_c) / n_c).alias("se"),
        ratio(p_t - p_c, above_zero(p_c)).alias("uplift_relative"),
        score.alias("mean_score"),
        ((p_t - p_c) * (n_t + n_c)).alias("incremental_conversions"),
    )


def _best_first(spec: ExperimentSpec):
    """Bins of a key, best score first. A key has at most ``n_bins`` rows here."""
    keys = list(spec.keys) or [F.lit(0)]
    return Window.partitionBy(*keys).orderBy(F.col("mean_score").desc(), F.col("bin").desc())


def qini_curve(table: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Cumulative population share and incremental conversions, best bins first, from (0, 0)."""
    best = _best_first(spec)
    running = best.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*(spec.keys or [F.lit(0)]))
    size = F.col("n_treatment") + F.col("n_control")
    points = table.select(
        *spec.keys,
        F.row_number().over(best).alias("step"),
        "bin",
        (F.sum(size).over(running) / F.sum(size).over(whole)).alias("population_share"),
        F.sum("incremental_conversions").over(running).alias("incremental_conversions"),
        F.sum("incremental_conversions").over(whole).alias("_gain"),
    ).withColumn(
        "share_of_incremental", ratio(F.col("incremental_conversions"), F.col("_gain"))
    )
    # The origin rides along with the first point instead of a second read of the table.
    zero = F.struct(
        F.lit(0).alias("step"), F.lit(None).cast("int").alias("bin"),
        F.lit(0.0).alias("population_share"), F.lit(0.0).alias("incremental_conversions"),
        F.lit(0.0).alias("share_of_incremental"), F.lit(0.0).alias("random_share"),
    )
    here = F.struct(
        "step", "bin", "population_share", "incremental_conversions", "share_of_incremental",
        F.col("population_share").alias("random_share"),
    )
    rows = F.when(F.col("step") == 1, F.array(zero, here)).otherwise(F.array(here))
    return points.select(*spec.keys, F.explode(rows).alias("_row")).select(*spec.keys, "_row.*")


def uplift_summary(
    table: DataFrame, spec: ExperimentSpec, top_share: float = 0.3, top_bins: int = 3
) -> DataFrame:
    """ATE, Qini ratio, heterogeneity test and concentration, one row per key.

    * ``qini_ratio``: (area under the curve - area under the diagonal) / |area under the diagonal|.
    * ``chi2`` centres on the plain ATE; ``chi2_weighted`` on the precision-weighted mean.
    * ``share_of_effect_in_top_bins``: literally the best ``top_bins`` bins;
      ``share_of_effect_in_top_share``: bins whose population reaches ``top_share``
      of all rows, with the last one taken in part.
    """
    whole = Window.partitionBy(*(spec.keys or [F.lit(0)]))
    best = _best_first(spec)
    before = best.rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("n_treatment") + F.col("n_control")
    precision = ratio(F.lit(1.0), F.col("se") * F.col("se"))
    frame = table.withColumns(
        {
            "_rank": F.row_number().over(best),
            "_size": size.cast("double"),
            "_n": F.sum(size).over(whole).cast("double"),
            "_gain": F.sum("incremental_conversions").over(whole),
            "_size_before": F.coalesce(F.sum(size).over(before), F.lit(0)).cast("double"),
            "_gain_before": F.coalesce(F.sum("incremental_conversions").over(before), F.lit(0.0)),
            "_ate": ratio(
                F.sum(F.col("rate_treatment") * F.col("n_treatment")).over(whole),
                F.sum("n_treatment").over(whole),
            )
            - ratio(
                F.sum(F.col("rate_control") * F.col("n_control")).over(whole),
                F.sum("n_control").over(whole),
            ),
            "_centre": ratio(
                F.sum(F.col("uplift") * precision).over(whole), F.sum(precision).over(whole)
            ),
        }
    )
    dx = F.col("_size") / F.col("_n")
    x0 = F.col("_size_before") / F.col("_n")
    gain = F.col("incremental_conversions")
    standardised = lambda centre: ratio(F.col("uplift") - centre, above_zero(F.col("se")))
    inside = F.least(
        F.greatest((F.lit(top_share) - x0) / dx, F.lit(0.0)), F.lit(1.0)
    )
    out = frame.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n_bins"),
        F.max("_ate").alias("ate_absolute"),
        F.max("_gain").alias("total_incremental"),
        F.sum(dx * (F.col("_gain_before") + gain / 2.0)).alias("_area"),
        F.sum(dx * F.col("_gain") * (x0 + dx / 2.0)).alias("_area_random"),
        F.sum(standardised(F.col("_ate")) ** 2).alias("chi2"),
        F.sum(standardised(F.col("_centre")) ** 2).alias("chi2_weighted"),
        F.min_by("uplift", "_rank").alias("top_bin_uplift"),
        F.max_by("uplift", "_rank").alias("bottom_bin_uplift"),
        F.sum(F.when(F.col("_rank") <= top_bins, gain)).alias("_top_gain"),
        F.sum(F.when(F.col("_rank") <= top_bins, F.col("_size"))).alias("_top_size"),
        F.sum(gain * inside).alias("_share_gain"),
        F.max("_n").alias("_n"),
    )
    dof = F.greatest(F.col("n_bins") - 1, F.lit(1)).cast("int")
    out = out.withColumns(
        {
            "qini_ratio": F.coalesce(
                ratio(F.col("_area") - F.col("_area_random"), F.abs(F.col("_area_random"))),
                F.lit(0.0),
            ),
            "heterogeneity_df": dof,
            "heterogeneity_p": chi2_sf(F.col("chi2"), dof),
            "top_vs_bottom_ratio": ratio(F.col("top_bin_uplift"), F.col("bottom_bin_uplift")),
            "share_of_effect_in_top_bins": ratio(F.col("_top_gain"), F.col("total_incremental")),
            "population_in_top_bins": ratio(F.col("_top_size"), F.col("_n")),
            "share_of_effect_in_top_share": ratio(F.col("_share_gain"), F.col("total_incremental")),
        }
    )
    return out.withColumn(
        "heterogeneity_detected", F.col("heterogeneity_p") < 0.001
    ).drop("_area", "_area_random", "_top_gain", "_top_size", "_share_gain", "_n")
