"""Means, variances and covariances rebuilt from sums, or taken directly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import above_zero, quoted, ratio
from ..spec import ExperimentSpec
from .suffstats import arm_pairs, complete_cases

MOMENTS = ("n", "mean_y", "var_y", "mean_x", "var_x", "cov_yx")


def _moment_columns(tag: str | None, prefix: str = "") -> dict[str, Column]:
    """Moments of y, and of covariate ``tag`` when given, from prefixed sums."""
    col = lambda name: F.col(prefix + name).cast("double")
    n = col("n")
    dof = F.greatest(n - 1.0, F.lit(0.0))
    mean_y = ratio(col("sum_y"), n)
    out = {
        "n": n,
        "mean_y": mean_y,
        "var_y": ratio(col("sum_yy") - n * mean_y * mean_y, dof),
    }
    if tag:
        mean_x = ratio(col(f"sum_{tag}"), n)
        out |= {
            "mean_x": mean_x,
            "var_x": ratio(col(f"sum_{tag}{tag}") - n * mean_x * mean_x, dof),
            "cov_yx": ratio(col(f"sum_y{tag}") - n * mean_y * mean_x, dof),
        }
    return out


def _correlation(prefix: str = "") -> Column:
    spread = F.sqrt(F.col(f"{prefix}var_y") * F.col(f"{prefix}var_x"))
    return F.coalesce(ratio(F.col(f"{prefix}cov_yx"), above_zero(spread)), F.lit(0.0))


def arm_moments(cells: DataFrame, spec: ExperimentSpec, tag: str = "xs") -> DataFrame:
    """Sample moments of the metric and one covariate per (keys, arm)."""
    frame = cells.select(
        *spec.keys, spec.arm, *[c.alias(k) for k, c in _moment_columns(tag).items()]
    )
    return frame.withColumn("corr_yx", _correlation())


def arm_moments_direct(df: DataFrame, spec: ExperimentSpec, covariate: str) -> DataFrame:
    """The same moments straight from rows with Spark's updating (stable) aggregates.

    For metrics such as revenue, where sum(y*y) - n*mean^2 would cancel.
    """
    y, x = F.col(spec.metric).cast("double"), F.col(covariate).cast("double")
    return (
        complete_cases(df, spec)
        .filter(F.col(covariate).isNotNull())
        .groupBy(*spec.keys, spec.arm)
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.avg(y).alias("mean_y"),
            F.var_samp(y).alias("var_y"),
            F.avg(x).alias("mean_x"),
            F.var_samp(x).alias("var_x"),
            F.covar_samp(y, x).alias("cov_yx"),
        )
        .withColumn("corr_yx", _correlation())
    )


def pooled_moments(cells: DataFrame, spec: ExperimentSpec, tag: str = "xs") -> DataFrame:
    """Moments of the two arms taken as one sample, one row per key."""
    pairs = paired_moments(cells, spec, tag)
    return pairs.select(
        *spec.keys, *[F.col(f"p_{m}").alias(m) for m in MOMENTS], "corr_yx"
    )


def paired_moments(cells: DataFrame, spec: ExperimentSpec, tag: str | None = "xs") -> DataFrame:
    """Treatment (``t_``), control (``c_``) and pooled (``p_``) moments per key.

    The pooled moments come from the summed sums, so the between-arm part of
    the variance is kept.
    """
    names = ["n", "sum_y", "sum_yy"]
    if tag:
        names += [f"sum_{tag}", f"sum_{tag}{tag}", f"sum_y{tag}"]
    extra = ["sum_exposure"] if spec.exposure else []
    pairs = arm_pairs(cells, spec, names + extra)
    pooled = pairs.withColumns({f"p_{c}": F.col(f"t_{c}") + F.col(f"c_{c}") for c in names})
    columns = [
        c.alias(prefix + name)
        for prefix in ("t_", "c_", "p_")
        for name, c in _moment_columns(tag, prefix).items()
    ]
    if spec.exposure:
        columns += [
            ratio(F.col("t_sum_exposure"), F.col("t_n")).alias("compliance"),
            F.col("c_sum_exposure").alias("control_exposed"),
        ]
    frame = pooled.select(*spec.keys, *columns)
    return frame.withColumn("corr_yx", _correlation("p_")) if tag else frame


def _covariance_text(i: str, j: str) -> str:
    """Sample covariance of two features in one cell; 0/0 and one-row cells give NULL."""
    cross, sum_i, sum_j = (quoted(c) for c in (f"sum_{i}_{j}", f"sum_{i}", f"sum_{j}"))
    return f"try_divide({cross} - try_divide({sum_i} * {sum_j}, n), greatest(n - 1, 0))"


def _explode_text(frame: DataFrame, keep: list[str], rows: list[str]) -> DataFrame:
    return frame.select(*keep, F.expr(f"inline(array({', '.join(rows)}))"))


def feature_covariance(cells: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Upper triangle of each arm's feature covariance, long: (keys, arm, feature_i, feature_j)."""
    rows = [
        f"struct('{a}' AS feature_i, '{b}' AS feature_j, {_covariance_text(a, b)} AS covariance)"
        for k, a in enumerate(spec.features)
        for b in spec.features[k:]
    ]
    return _explode_text(cells, [*spec.keys, spec.arm], rows)


def feature_moments(cells: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Mean and sample variance per (keys, arm, feature), long."""
    rows = [
        f"struct('{f}' AS feature, try_divide({quoted(f'sum_{f}')}, n)"
        f" + CAST('{spec.shift_of(f)!r}' AS DOUBLE) AS mean, {_covariance_text(f, f)} AS variance)"
        for f in spec.features
    ]
    return _explode_text(cells, [*spec.keys, spec.arm, "n"], rows)
