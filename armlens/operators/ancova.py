"""Adjustment on all covariates at once, from the same cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import on_keys, packed_gram, packed_rhs, ratio, stack_rows
from ..functions.linalg import least_squares, least_squares_within
from ..spec import ExperimentSpec
from .effects import infer
from .suffstats import arm_pairs

SLOPES = ("pooled", "within", "lin")


def _dot(coef: Column, vector: Column) -> Column:
    """Slope part of coef (intercept dropped) times a vector of the feature length."""
    product = F.zip_with(F.slice(coef, 2, F.size(coef) - 1), vector, lambda a, b: a * b)
    return F.aggregate(product, F.lit(0.0), lambda total, v: total + v)


def _means(gram: Column, p: int) -> Column:
    n = F.get(gram, F.lit(0))
    return F.transform(F.slice(gram, 2, p), lambda s: ratio(s, n))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _normal_equations(cells: DataFrame, spec: ExperimentSpec) -> DataFrame:
    packed = cells.select(
        *spec.keys, spec.arm,
        packed_gram(spec.features).alias("gram"),
        packed_rhs(spec.features).alias("rhs"),
        F.col("sum_yy").cast("double").alias("yty"),
    )
    return arm_pairs(packed, spec, ("gram", "rhs", "yty"))


def ancova(
    cells: DataFrame, spec: ExperimentSpec, slopes: tuple[str, ...] = ("pooled", "lin")
) -> DataFrame:
    """Adjusted effects with p covariates, one row per (keys, slope form).

    * ``pooled``: one slope vector fitted to both arms together, without a
      treatment term. Its interval ignores the covariance that the shared slope
      puts between the adjusted means, so it is approximate.
    * ``within``: one slope vector fitted to the arms centred separately (the
      textbook treatment-term form).
    * ``lin``: a slope vector per arm.

    Rows carry the fit's R-squared in the control arm (``r2_control``).
    """
    p = len(spec.features)
    frame = _normal_equations(cells, spec)
    fit = lambda prefix: least_squares(
        F.col(f"{prefix}_gram"), F.col(f"{prefix}_rhs"), F.col(f"{prefix}_yty")
    )
    frame = frame.withColumns(
        {
            "p_gram": _plus(F.col("t_gram"), F.col("c_gram")),
            "p_rhs": _plus(F.col("t_rhs"), F.col("c_rhs")),
            "p_yty": F.col("t_yty") + F.col("c_yty"),
        }
    )
    if "within" in slopes:
        sides = [F.col(f"{a}_{part}") for a in ("t", "c") for part in ("gram", "rhs", "yty")]
        frame = frame.withColumn("w_fit", least_squares_within(*sides))
    frame = frame.withColumns({"t_fit": fit("t"), "c_fit": fit("c"), "p_fit": fit("p")})
    frame = frame.withColumns(
        {
            **{f"{a}_n": F.get(F.col(f"{a}_gram"), F.lit(0)) for a in ("t", "c")},
            **{f"{a}_bar": _means(F.col(f"{a}_gram"), p) for a in ("t", "c", "p")},
        }
    )
    frame = frame.withColumns(
        {
            f"{a}_off": F.zip_with(f"{a}_bar", "p_bar", lambda x, m: x - m) for a in ("t", "c")
        }
        | {f"{a}_ybar": ratio(F.get(F.col(f"{a}_rhs"), F.lit(0)), F.col(f"{a}_n")) for a in ("t", "c")}
    )
    total = F.col("t_n") + F.col("c_n")
    forms = {
        "pooled": ("p", "p", ratio(F.col("p_fit.ssr"), F.greatest(total - (p + 2), F.lit(0.0)))),
        "within": ("w", "w", ratio(F.col("w_fit.ssr"), F.greatest(total - (p + 2), F.lit(0.0))))
        if "within" in slopes else None,
        "lin": ("t", "c", None),
    }
    rows = []
    for name in slopes:
        fit_t, fit_c, shared = forms[name]
        own = lambda a: ratio(
            F.col(f"{a}_fit.ssr"), F.greatest(F.col(f"{a}_n") - (p + 1), F.lit(0.0))
        )
        rows.append(
            F.struct(
                F.lit(f"ancova_{name}").alias("estimator"),
                F.col("t_n").alias("n_treatment"),
                F.col("c_n").alias("n_control"),
                (F.col("t_ybar") - _dot(F.col(f"{fit_t}_fit.coef"), F.col("t_off")))
                .alias("mean_treatment"),
                (own("t") if shared is None else shared).alias("var_treatment"),
                (F.col("c_ybar") - _dot(F.col(f"{fit_c}_fit.coef"), F.col("c_off")))
                .alias("mean_control"),
                (own("c") if shared is None else shared).alias("var_control"),
            )
        )
    frame = frame.withColumn("r2_control", F.col("c_fit.r2")).withColumn("n_covariates", F.lit(p))
    kept = ("n_covariates", "r2_control")
    return infer(stack_rows(frame, [*spec.keys, *kept], rows), spec, kept)


def index_gain(ancova_rows: DataFrame, index_r2: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """R-squared gained by all covariates over the single collapsed index."""
    fits = ancova_rows.groupBy(*spec.keys).agg(F.max("r2_control").alias("r2_control"))
    joined = on_keys(fits, index_r2.select(*spec.keys, "index_r2"), spec.keys)
    return joined.select(
        *spec.keys, "r2_control", F.col("index_r2").alias("r2_index_only"),
        (F.col("r2_control") - F.col("index_r2")).alias("r2_gain_from_all_features"),
    )
