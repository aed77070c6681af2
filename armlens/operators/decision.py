"""The ship decision: worst case over estimators and row-handling choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import on_keys
from ..spec import ExperimentSpec

# The adjusted lift leads when it is this much less sensitive to the row-handling choice.
STABILITY_GAIN = 1.5


def ship_decision(
    effects: DataFrame,
    spec: ExperimentSpec,
    curve_summary: DataFrame | None = None,
    balance: DataFrame | None = None,
    srm: DataFrame | None = None,
) -> DataFrame:
    """Ship when the least lower bound clears the minimum lift; marginal when only above 0.

    ``effects`` are estimator rows; every estimator in them takes part in the
    worst case, so extra forms can be added by the caller. With ``srm`` (the
    sample-ratio table) every key of it has a row: one that fails the check is
    ``withheld``, with its estimates left out.
    """
    pick = lambda name, c: F.any_value(F.when(F.col("estimator") == name, F.col(c)), True)
    frame = effects.groupBy(*spec.keys).agg(
        F.min("relative_ci_low").alias("_low"),
        F.bool_and(F.col("relative_ci_low").isNotNull()).alias("_known"),
        *[
            pick(name, c).alias(f"_{name}_{c}")
            for name in ("unadjusted", "cuped")
            for c in ("relative_lift", "relative_ci_low", "relative_ci_high", "p_value")
        ],
    )
    if srm is not None:
        checked = srm.select(*spec.keys, F.col("passed").alias("_passed"))
        frame = on_keys(checked, frame, spec.keys) if spec.keys else on_keys(frame, checked, ())
        shown = F.coalesce(F.col("_passed"), F.lit(False))
        frame = frame.withColumns(
            {c: F.when(shown, F.col(c)) for c in frame.columns if c not in (*spec.keys, "_passed")}
        )
    else:
        frame = frame.withColumn("_passed", F.lit(True))
    if curve_summary is not None:
        frame = on_keys(
            frame,
            curve_summary.select(
                *spec.keys, "lowest_ci_bound", "adjustment_stability_gain",
                F.col("lift_min").alias("plausible_low"), F.col("lift_max").alias("plausible_high"),
            ),
            spec.keys,
        )
    else:
        frame = frame.withColumns(
            {c: F.lit(None).cast("double") for c in
             ("lowest_ci_bound", "adjustment_stability_gain", "plausible_low", "plausible_high")}
        )
    if balance is not None:
        frame = on_keys(
            frame, balance.select(*spec.keys, F.col("passed").alias("balance_passed")), spec.keys
        )
    else:
        frame = frame.withColumn("balance_passed", F.lit(None).cast("boolean"))
    frame = frame.withColumn(
        "worst_case_lower_bound",
        F.when(F.col("_known"), F.least("_low", "lowest_ci_bound")),
    )
    worst = F.col("worst_case_lower_bound")
    frame = frame.withColumns(
        {
            "ship": F.coalesce(worst > spec.min_lift, F.lit(False)),
            "marginal": F.coalesce((worst > 0) & (worst <= spec.min_lift), F.lit(False)),
            "leading_estimate": F.when(
                F.coalesce(F.col("adjustment_stability_gain") > STABILITY_GAIN, F.lit(False)), "cuped"
            ).when(F.coalesce(F.col("balance_passed"), F.lit(False)), "unadjusted").otherwise("cuped"),
        }
    )
    lead = lambda c: F.when(
        F.col("leading_estimate") == "unadjusted", F.col(f"_unadjusted_{c}")
    ).otherwise(F.col(f"_cuped_{c}"))
    return frame.select(
        *spec.keys, "ship", "marginal",
        F.when(~F.coalesce(F.col("_passed"), F.lit(False)), "withheld")
        .when(worst.isNull(), "undetermined").when(F.col("ship"), "ship")
        .when(F.col("marginal"), "marginal").otherwise("hold").alias("decision"),
        F.lit(spec.min_lift).alias("min_practical_lift"),
        "worst_case_lower_bound", "leading_estimate",
        lead("relative_lift").alias("point_estimate"),
        lead("relative_ci_low").alias("ci_low"), lead("relative_ci_high").alias("ci_high"),
        *[F.when(F.coalesce(F.col("_passed"), F.lit(False)), F.col(c)).alias(c)
          for c in ("plausible_low", "plausible_high")],
        F.col("_unadjusted_relative_lift").alias("lift"),
        F.col("_cuped_relative_lift").alias("lift_cuped"),
        F.col("_cuped_p_value").alias("final_p"),
    )


def experiment_summary(decision: DataFrame, spec: ExperimentSpec, **parts: DataFrame) -> DataFrame:
    """One wide row per key: the decision joined with other per-key results.

    Columns of each part are prefixed with its name.
    """
    out = decision
    for name, part in parts.items():
        named = part.select(
            *spec.keys, *[F.col(c).alias(f"{name}_{c}") for c in part.columns if c not in spec.keys]
        )
        out = on_keys(out, named, spec.keys)
    return out
