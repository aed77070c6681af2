"""Linear models fitted from cells, and their scores on rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import expressions, linear_score, on_keys, packed_gram, packed_rhs, quoted
from ..functions.linalg import least_squares, linear_score_sums
from ..sources.session import stored
from ..spec import ExperimentSpec
from .folds import FOLD, with_fold
from .suffstats import fold_complement, sufficient_stats, sum_columns

INDEX_SUMS = ("sum_xs", "sum_xsxs", "sum_yxs")


def fit_cells(cells: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """OLS of the metric on the features for every row of a cells table.

    Adds ``coef`` (intercept first), ``ssr``, ``r2`` and ``rank``. The solve is
    row-wise and vectorised, so segments need no grouping step.
    """
    fitted = cells.withColumn(
        "_fit",
        least_squares(packed_gram(spec.features), packed_rhs(spec.features), F.col("sum_yy")),
    )
    return fitted.select(*cells.columns, "_fit.*")


def coefficient_table(fits: DataFrame, spec: ExperimentSpec, keep: tuple[str, ...]) -> DataFrame:
    """Coefficients as rows: (keep..., term, estimate)."""
    terms = F.array(*[F.lit(t) for t in ("intercept", *spec.features)])
    return fits.select(*keep, F.posexplode("coef").alias("_pos", "estimate")).select(
        *keep, F.get(terms, F.col("_pos")).alias("term"), "estimate"
    )


def fold_cells(df: DataFrame, spec: ExperimentSpec, weight: str | None = None) -> DataFrame:
    """Sums per (keys, fold, arm): the single pass behind every cross-fitted model."""
    return sufficient_stats(with_fold(df, spec), spec, by=(FOLD,), weight=weight)


def covariate_models(per_fold: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """The cross-fitted covariate index: for fold k, fitted on control rows outside k.

    Full control arm, from sums; no rows are sampled or collected.
    """
    # Folds that only the treatment arm has get a model as well.
    complements = fold_complement(per_fold, spec, FOLD)
    fits = fit_cells(complements.filter(F.col(spec.arm) == 0), spec)
    return fits.select(*spec.keys, FOLD, "coef", F.col("n").alias("fit_rows"), "r2")


def mean_index_r2(models: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Mean R-squared of the fold models, the figure ANCOVA is compared with."""
    return models.groupBy(*spec.keys).agg(
        F.avg("r2").alias("index_r2"), F.sum("fit_rows").alias("fit_rows")
    )


def index_cells(
    per_fold: DataFrame, models: DataFrame, spec: ExperimentSpec, model_keys: tuple[str, ...] | None = None
) -> DataFrame:
    """Cells with the sums of the cross-fitted index, without another pass over the log.

    Within a fold the index is linear in the features, so its sums are linear
    and quadratic forms in the sums already held. ``model_keys`` says which
    keys the models carry when that is not all of them.
    """
    on = [*(spec.keys if model_keys is None else model_keys), FOLD]
    joined = on_keys(per_fold, models.select(*on, "coef"), on)
    scored = joined.withColumn(
        "_s",
        linear_score_sums(F.col("coef"), packed_gram(spec.features), packed_rhs(spec.features)),
    )
    filled = scored.select(
        *per_fold.columns,
        F.col("_s.sum_x").alias("sum_xs"),
        F.col("_s.sum_xx").alias("sum_xsxs"),
        F.col("_s.sum_yx").alias("sum_yxs"),
    )
    # A fold without a model leaves the key's index undefined rather than partial.
    sums = {
        c: f"if(count(sum_xs) = count(1), sum({c}), NULL)" if c in INDEX_SUMS else f"sum({quoted(c)})"
        for c in sum_columns(filled)
    }
    return filled.groupBy(*spec.keys, spec.arm).agg(*expressions(sums))


def uplift_models(per_fold: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """T-learner per fold: treatment minus control coefficients, fitted outside the fold."""
    fits = fit_cells(fold_complement(per_fold, spec, FOLD), spec)
    arm = lambda v: F.any_value(F.when(F.col(spec.arm) == v, F.col("coef")), True)
    paired = fits.groupBy(*spec.keys, FOLD).agg(
        arm(1).alias("_t"), arm(0).alias("_c"), F.sum("n").alias("fit_rows")
    )
    gap = F.zip_with("_t", "_c", lambda t, c: t - c)
    return paired.select(*spec.keys, FOLD, gap.alias("coef"), "fit_rows")


def pin_models(models: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Fix fitted models so scoring does not refit them on every use.

    They are written as Parquet, so that Spark knows their bytes and broadcasts
    them only below its own limit.
    """
    return stored(models)


def score_rows(df: DataFrame, models: DataFrame, spec: ExperimentSpec, out: str) -> DataFrame:
    """Give each row the score of its own fold's model, as arithmetic inside codegen.

    ``models`` come from ``pin_models``. A row whose key or fold has no model
    stays, without a score.
    """
    folded = df if FOLD in df.columns else with_fold(df, spec)
    table = models.select(*spec.keys, FOLD, F.col("coef").alias("_coef"))
    joined = on_keys(folded, table, [*spec.keys, FOLD])
    features = [spec.feature_text(f) for f in spec.features]
    return joined.withColumn(out, linear_score("_coef", features)).drop("_coef")
