"""Additive per-arm sufficient statistics: the one pass over the log.

Everything is a partial + final hash aggregate on (keys, arm), so what is
shuffled is bounded by tasks x groups however the rows are skewed: a key holding
a third of the log is combined map-side before it moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import expressions, quoted, ratio
from ..spec import ExperimentSpec


def analysis_columns(spec: ExperimentSpec) -> list[str]:
    """Every log column the spec refers to, without duplicates."""
    named = [spec.arm, spec.metric, spec.covariate, spec.post_covariate, spec.exposure, spec.fold]
    wanted = [*spec.keys, *[c for c in named if c], *spec.features]
    return list(dict.fromkeys(wanted))


def complete_text(spec: ExperimentSpec) -> str:
    """The condition of ``complete_cases`` as SQL."""
    numeric = [spec.arm, spec.metric, spec.covariate, spec.post_covariate, spec.exposure, spec.fold]
    present = dict.fromkeys([c for c in numeric if c] + list(spec.features))
    tests = [f"{quoted(c)} IS NOT NULL" for c in present]
    tests += [f"NOT isnan(CAST({quoted(f)} AS DOUBLE))" for f in spec.features]
    return " AND ".join(tests)


def complete_cases(df: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Rows usable in every sum: no NULL in a used column, no NaN feature.

    Without it n would count rows that the individual sums skip. Being a plain
    filter it also lets Spark treat the columns as non-nullable afterwards.
    """
    return df.filter(F.expr(complete_text(spec)))


def completeness_counts(spec: ExperimentSpec) -> list[Column]:
    """Kept and dropped row counts, to be combined with other aggregates."""
    complete = F.expr(complete_text(spec))
    return [F.count_if(complete).alias("n_complete"), F.count_if(~complete).alias("n_dropped")]


def completeness(df: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """How many rows ``complete_cases`` keeps and drops."""
    rows = F.count(F.lit(1)).alias("n_rows")
    return df.groupBy(*spec.keys).agg(rows, *completeness_counts(spec))


def feature_shifts(df: DataFrame, spec: ExperimentSpec) -> tuple[tuple[str, float], ...]:
    """Global feature means, for ``ExperimentSpec.shift``.

    Summing products of shifted features avoids the cancellation in
    sum(x*x) - n*mean^2 for columns whose mean dwarfs their spread. Returns one
    number per feature, so what reaches the driver does not grow with the data.
    """
    means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in spec.features]).first()
    return tuple((f, float(means[f] or 0.0)) for f in spec.features)


def _outcome_values(spec: ExperimentSpec) -> dict[str, str]:
    """Output name -> SQL text of what is summed, for the outcome and the flags."""
    y = f"CAST({quoted(spec.metric)} AS DOUBLE)"
    values = {"sum_y": y, "sum_yy": f"{y} * {y}"}
    for name, tag in ((spec.post_covariate, "xn"), (spec.covariate, "xs")):
        if name:
            x = f"CAST({quoted(name)} AS DOUBLE)"
            values |= {f"sum_{tag}": x, f"sum_{tag}{tag}": f"{x} * {x}", f"sum_y{tag}": f"{y} * {x}"}
    if spec.exposure:
        values["sum_exposure"] = f"CAST({quoted(spec.exposure)} AS DOUBLE)"
    return values


def _feature_values(spec: ExperimentSpec, cross_products: bool) -> dict[str, str]:
    y = f"CAST({quoted(spec.metric)} AS DOUBLE)"
    x = {f: spec.feature_text(f) for f in spec.features}
    values = {}
    for f in spec.features:
        values |= {f"sum_{f}": x[f], f"sum_{f}_y": f"{x[f]} * {y}"}
    if cross_products:
        # Upper triangle only: the matrix is symmetric.
        for i, a in enumerate(spec.features):
            values |= {f"sum_{a}_{b}": f"{x[a]} * {x[b]}" for b in spec.features[i:]}
    return values


def sufficient_stats(
    df: DataFrame,
    spec: ExperimentSpec,
    by: Sequence[str] = (),
    weight: str | None = None,
    cross_products: bool = True,
) -> DataFrame:
    """Per-(keys, by, arm) sums from which every later test is computed.

    ``weight`` counts each row that many times (rows with weight 0 drop out).
    With 12 features this is 112 sums; see ``sources.session`` for the
    codegen setting that keeps an aggregate this wide compiled.
    """
    rows = complete_cases(df, spec)
    if weight is not None:
        rows = rows.filter(F.col(weight) > 0)
    w = f"CAST({quoted(weight)} AS DOUBLE) * " if weight is not None else ""
    count = "count(1)" if weight is None else f"sum(CAST({quoted(weight)} AS DOUBLE))"
    values = _outcome_values(spec) | _feature_values(spec, cross_products)
    sums = {"n": count} | {name: f"sum({w}{value})" for name, value in values.items()}
    return rows.groupBy(*spec.keys, *by, spec.arm).agg(*expressions(sums))


def sum_columns(cells: DataFrame) -> list[str]:
    """The additive columns of a cells table."""
    return [c for c in cells.columns if c == "n" or c.startswith("sum_")]


def added_up(cells: DataFrame) -> list[Column]:
    """Aggregates that add every additive column up under its own name."""
    return expressions({c: f"sum({quoted(c)})" for c in sum_columns(cells)})


def merge_cells(cells: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Add cells up to one row per (keys, arm): drops folds, looks or days."""
    return cells.groupBy(*spec.keys, spec.arm).agg(*added_up(cells))


def pooled_cells(cells: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Both arms added together, keeping the between-arm part of the variance."""
    return cells.groupBy(*spec.keys).agg(*added_up(cells))


def fold_complement(fold_cells: DataFrame, spec: ExperimentSpec, fold: str = "_fold") -> DataFrame:
    """For every fold, the sums over all other folds.

    Each cell is handed to the key's other folds and added up there: result-sized,
    one pass over the cells, and no digits are lost as they would be by
    subtracting a fold from the total. The folds are those the cells have, whatever
    their number or values.
    """
    # A window over cells holds one row per fold and arm of a key.
    targets = F.collect_set(fold).over(Window.partitionBy(*(spec.keys or [F.lit(0)])))
    handed = fold_cells.withColumn("_targets", targets).withColumn("_target", F.explode("_targets")).drop("_targets").filter(
        F.col("_target") != F.col(fold)
    )
    return handed.groupBy(*spec.keys, F.col("_target").alias(fold), spec.arm).agg(
        *added_up(fold_cells)
    )


def arm_pairs(cells: DataFrame, spec: ExperimentSpec, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key with the treatment (``t_``) and control (``c_``) sums side by side.

    A conditional aggregate rather than a self-join; an absent arm leaves NULLs.
    """
    columns = list(columns or sum_columns(cells))
    picks = {}
    for prefix, value in (("t_", 1), ("c_", 0)):
        test = f"{quoted(spec.arm)} = {value}"
        picks |= {prefix + c: f"any_value(if({test}, {quoted(c)}, NULL), true)" for c in columns}
    return cells.groupBy(*spec.keys).agg(*expressions(picks))


def arm_counts(df: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Treatment and control row counts per key, in one pass."""
    return df.groupBy(*spec.keys).agg(
        F.count_if(F.col(spec.arm) == 1).alias("n_treatment"),
        F.count_if(F.col(spec.arm) == 0).alias("n_control"),
    )


def arm_summary(cells: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Counts, rate, share and an "85/15"-style split label, one row per (keys, arm)."""
    # A window over cells holds one row per arm, whatever the size of the log.
    per_key = Window.partitionBy(*(spec.keys or [F.lit(0)]))
    counted = cells.withColumn("_total", F.sum("n").over(per_key))
    share = ratio(F.col("n").cast("double"), F.col("_total"))
    treated = F.when(F.col(spec.arm) == 1, share).otherwise(1.0 - share)
    percent = lambda c: F.round(c * 100.0).cast("int").cast("string")
    optional = []
    if spec.post_covariate:
        optional.append(F.col("sum_xn").cast("long").alias("visits"))
    if spec.exposure:
        optional.append(F.col("sum_exposure").cast("long").alias("exposed"))
    return counted.select(
        *spec.keys,
        spec.arm,
        F.col("n").cast("long").alias("n"),
        F.col("sum_y").cast("long").alias("conversions"),
        *optional,
        ratio(F.col("sum_y"), F.col("n")).alias("conversion_rate"),
        share.alias("share"),
        F.concat_ws("/", percent(treated), percent(1.0 - treated)).alias("split_label"),
    )
