"""Moments, effect estimates and adjustments on data whose answer is known."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from armlens import ExperimentSpec
from armlens.operators import ancova, effects, guardrails, models, moments, suffstats
from tests.conftest import by, one

SPEC = ExperimentSpec(metric="y", arm="arm", covariate="x", features=("x",))


def experiment(spark, seed, n_t=60_000, n_c=60_000, rho=0.6, effect=0.05, shift=0.0, base=1.0):
    """y = base + rho*x + noise, plus a fixed effect; ``shift`` moves x in treatment."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(shift, 1.0, n_t), rng.normal(0.0, 1.0, n_c)])
    arm = np.repeat([1, 0], [n_t, n_c])
    y = base + rho * x + math.sqrt(1 - rho**2) * rng.normal(size=n_t + n_c) + effect * arm
    return spark.createDataFrame(pd.DataFrame({"arm": arm, "x": x, "y": y}))


def paired(df, spec=SPEC, tag="xs"):
    return moments.paired_moments(suffstats.sufficient_stats(df, spec), spec, tag)


def counts_cells(spark, rows):
    """Cells of a binary metric from (arm, n, conversions)."""
    return spark.createDataFrame(
        [(a, n, float(k), float(k)) for a, n, k in rows], "arm int, n long, sum_y double, sum_yy double"
    )


def test_moments_match_numpy(spark):
    df = experiment(spark, 1)
    pdf = df.toPandas()
    spec = replace(SPEC, features=())
    got = by(moments.arm_moments(suffstats.sufficient_stats(df, spec), spec), "arm")
    direct = by(moments.arm_moments_direct(df, spec, "x"), "arm")
    for arm, g in pdf.groupby("arm"):
        cov = np.cov(g.y, g.x, ddof=1)
        for r in (got[arm], direct[arm]):
            assert r["mean_y"] == pytest.approx(g.y.mean(), rel=1e-12)
            assert r["var_y"] == pytest.approx(cov[0, 0], rel=1e-9)
            assert r["var_x"] == pytest.approx(cov[1, 1], rel=1e-9)
            assert r["cov_yx"] == pytest.approx(cov[0, 1], rel=1e-9)
            assert r["corr_yx"] == pytest.approx(np.corrcoef(g.y, g.x)[0, 1], rel=1e-9)


def test_pooling_keeps_the_between_arm_variance(spark):
    df = experiment(spark, 2, effect=3.0, shift=2.0)
    pdf = df.toPandas()
    pooled = one(moments.pooled_moments(suffstats.sufficient_stats(df, SPEC), SPEC))
    assert pooled["var_y"] == pytest.approx(pdf.y.var(ddof=1), rel=1e-9)
    assert pooled["cov_yx"] == pytest.approx(np.cov(pdf.y, pdf.x, ddof=1)[0, 1], rel=1e-9)


def test_shifted_sums_keep_digits_that_raw_sums_lose(spark):
    rng = np.random.default_rng(3)
    x = 1e8 + rng.normal(size=20_000)
    df = spark.createDataFrame(pd.DataFrame({"arm": np.arange(20_000) % 2, "x": x, "y": 1.0 * (x > 1e8)}))
    spec = ExperimentSpec(metric="y", arm="arm", features=("x",))
    shifted = replace(spec, shift=suffstats.feature_shifts(df, spec))
    got = by(moments.feature_moments(suffstats.sufficient_stats(df, shifted), shifted), "arm")
    for arm in (0, 1):
        own = x[np.arange(20_000) % 2 == arm]
        assert got[arm]["variance"] == pytest.approx(own.var(ddof=1), rel=1e-6)
        assert got[arm]["mean"] == pytest.approx(own.mean(), rel=1e-12)


def test_unadjusted_matches_a_welch_test(spark):
    spec = ExperimentSpec(metric="y", arm="arm")
    cells = counts_cells(spark, [(1, 200_000, 6_000), (0, 200_000, 5_000)])
    r = one(effects.estimates(moments.paired_moments(cells, spec, None), spec, ("unadjusted",)))
    var = lambda p, n: p * (1 - p) * n / (n - 1)
    se = math.sqrt((var(0.03, 2e5) + var(0.025, 2e5)) / 2e5)
    assert r["z"] == pytest.approx(0.005 / se, rel=1e-10)
    assert r["p_value"] == pytest.approx(math.erfc(0.005 / se / math.sqrt(2)), rel=1e-9)
    assert r["significant"] and r["status"] == "ok"


def test_ratio_interval_on_published_counts(spark):
    """Published arm counts and lift interval of a 14-million-row experiment."""
    spec = ExperimentSpec(metric="y", arm="arm")
    cells = counts_cells(spark, [(1, 11_882_655, 36_711), (0, 2_096_937, 4_063)])
    r = one(effects.estimates(moments.paired_moments(cells, spec, None), spec, ("unadjusted",)))
    assert r["relative_lift"] == pytest.approx(0.5944881177, abs=1e-9)
    assert r["relative_ci_low"] == pytest.approx(0.5436975673, abs=1e-8)
    assert r["relative_ci_high"] == pytest.approx(0.6469497728, abs=1e-8)
    # A fixed-baseline interval would be a third narrower.
    naive = r["ci_width"] / r["mean_control"]
    assert (r["relative_ci_high"] - r["relative_ci_low"]) / naive > 1.3


def test_cuped_removes_rho_squared_of_the_variance(spark):
    d = one(effects.cuped_diagnostics(paired(experiment(spark, 4)), SPEC))
    assert d["observed_variance_reduction"] == pytest.approx(0.36, abs=0.02)
    assert d["observed_variance_reduction"] == pytest.approx(d["theoretical_variance_reduction"], abs=0.01)
    assert d["covariate_status"] == "valid" and d["shift_vs_chance_multiple"] < 4.0


def test_variance_reduction_is_the_weighted_mix_of_the_arms(spark):
    d = one(effects.cuped_diagnostics(paired(experiment(spark, 5, n_t=80_000, n_c=20_000)), SPEC))
    assert d["achievable_variance_reduction"] == pytest.approx(d["observed_variance_reduction"], abs=1e-9)
    assert d["control_share_of_variance"] > 0.5


def test_cuped_undoes_a_planted_imbalance(spark):
    pairs = paired(experiment(spark, 6, n_t=200_000, n_c=200_000, rho=0.7, effect=0.01, shift=0.05))
    rows = by(effects.estimates(pairs, SPEC), "estimator")
    assert rows["unadjusted"]["absolute_effect"] == pytest.approx(0.01 + 0.7 * 0.05, abs=0.01)
    assert rows["cuped"]["absolute_effect"] == pytest.approx(0.01, abs=0.01)
    assert rows["lin"]["absolute_effect"] == pytest.approx(rows["cuped"]["absolute_effect"], abs=0.002)
    cuped = rows["cuped"]
    assert cuped["relative_lift"] == pytest.approx(cuped["mean_treatment"] / cuped["mean_control"] - 1, rel=1e-9)
    d = one(effects.cuped_diagnostics(pairs, SPEC))
    assert d["covariate_status"] == "imbalanced" and d["shift_vs_chance_multiple"] > 10.0


def test_post_treatment_covariate_is_marked_invalid(spark):
    d = one(effects.cuped_diagnostics(paired(experiment(spark, 7, shift=0.3)), SPEC, pre_assignment=False))
    assert not d["covariate_is_safe"] and d["covariate_status"] == "invalid_post_assignment"


def test_useless_covariate_buys_nothing(spark):
    d = one(effects.cuped_diagnostics(paired(experiment(spark, 8, rho=0.0)), SPEC))
    assert d["observed_variance_reduction"] == pytest.approx(0.0, abs=0.01)


def test_complier_effect_divides_by_compliance(spark):
    rng = np.random.default_rng(9)
    arm = np.arange(40_000) % 2
    seen = arm * (rng.random(40_000) < 0.25)
    y = (rng.random(40_000) < 0.10 + 0.2 * seen).astype(int)
    spec = ExperimentSpec(metric="y", arm="arm", exposure="seen")
    df = spark.createDataFrame(pd.DataFrame({"arm": arm, "seen": seen, "y": y}))
    r = one(effects.complier_effects(
        moments.paired_moments(suffstats.sufficient_stats(df, spec), spec, None), spec, ("unadjusted",)
    ))
    itt = y[arm == 1].mean() - y[arm == 0].mean()
    assert r["cace_absolute"] == pytest.approx(itt / seen[arm == 1].mean(), rel=1e-9)
    assert r["cace_se_delta"] > r["cace_se"] and r["status"] == "ok"


FEATURES = tuple(f"g{i}" for i in range(12))


def wide_experiment(spark, seed=10, n=20_000):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 12)) * 10.0 ** rng.integers(-2, 4, 12) + 5.0
    arm = (rng.random(n) < 0.6).astype(int)
    y = (rng.random(n) < 0.2 + 0.05 * arm + 0.03 * np.sign(x[:, 0] - 5.0)).astype(int)
    pdf = pd.DataFrame(x, columns=FEATURES).assign(arm=arm, y=y, fold=np.arange(n) % 2)
    return spark.createDataFrame(pdf).repartition(5), pdf


WIDE = ExperimentSpec(metric="y", arm="arm", features=FEATURES, fold="fold")


def lstsq(g):
    design = np.column_stack([np.ones(len(g)), g[list(FEATURES)]])
    beta, *_ = np.linalg.lstsq(design, g.y.to_numpy(float), rcond=None)
    residual = g.y - design @ beta
    return beta, float(residual @ residual)


def test_twelve_covariate_fit_matches_row_level_least_squares(spark):
    df, pdf = wide_experiment(spark)
    fits = by(models.fit_cells(suffstats.sufficient_stats(df, WIDE), WIDE), "arm")
    for arm, g in pdf.groupby("arm"):
        beta, ssr = lstsq(g)
        assert np.allclose(fits[arm]["coef"], beta, rtol=1e-6, atol=1e-9)
        assert fits[arm]["ssr"] == pytest.approx(ssr, rel=1e-9)
        assert fits[arm]["rank"] == 12


def test_index_sums_equal_those_of_scored_rows(spark):
    df, _ = wide_experiment(spark, 11)
    per_fold = models.fold_cells(df, WIDE)
    fitted = models.covariate_models(per_fold, WIDE)
    cells = by(models.index_cells(per_fold, fitted, WIDE), "arm")
    scored = models.score_rows(df, models.pin_models(fitted, WIDE), WIDE, "s")
    rows = by(scored.groupBy("arm").agg(
        F.sum("s").alias("s"), F.sum(F.col("s") ** 2).alias("ss"), F.sum(F.col("s") * F.col("y")).alias("sy")
    ), "arm")
    for arm in (0, 1):
        assert cells[arm]["sum_xs"] == pytest.approx(rows[arm]["s"], rel=1e-9)
        assert cells[arm]["sum_xsxs"] == pytest.approx(rows[arm]["ss"], rel=1e-9)
        assert cells[arm]["sum_yxs"] == pytest.approx(rows[arm]["sy"], rel=1e-9)


def test_ancova_against_row_level_regressions(spark):
    df, pdf = wide_experiment(spark, 12)
    rows = by(ancova.ancova(suffstats.sufficient_stats(df, WIDE), WIDE, ("pooled", "within", "lin")), "estimator")
    t, c = pdf[pdf.arm == 1], pdf[pdf.arm == 0]
    names = list(FEATURES)
    (bt, st), (bc, sc), (bp, sp) = lstsq(t), lstsq(c), lstsq(pdf)
    centre = pdf[names].mean().to_numpy()
    off_t, off_c = t[names].mean().to_numpy() - centre, c[names].mean().to_numpy() - centre
    pooled = (t.y.mean() - bp[1:] @ off_t) - (c.y.mean() - bp[1:] @ off_c)
    lin = (t.y.mean() - bt[1:] @ off_t) - (c.y.mean() - bc[1:] @ off_c)
    n_t, n_c = len(t), len(c)
    assert rows["ancova_pooled"]["absolute_effect"] == pytest.approx(pooled, rel=1e-7)
    assert rows["ancova_pooled"]["se"] == pytest.approx(
        math.sqrt(sp / (n_t + n_c - 14) * (1 / n_t + 1 / n_c)), rel=1e-8)
    assert rows["ancova_lin"]["absolute_effect"] == pytest.approx(lin, rel=1e-7)
    assert rows["ancova_lin"]["se"] == pytest.approx(
        math.sqrt(st / (n_t - 13) / n_t + sc / (n_c - 13) / n_c), rel=1e-8)
    # The within form is the treatment coefficient of one regression with a treatment term.
    design = np.column_stack([np.ones(len(pdf)), pdf.arm, pdf[names]])
    beta, *_ = np.linalg.lstsq(design, pdf.y.to_numpy(float), rcond=None)
    assert rows["ancova_within"]["absolute_effect"] == pytest.approx(beta[1], rel=1e-7)


def test_ancova_ratio_interval_is_symmetric_in_logs(spark):
    df, _ = wide_experiment(spark, 13)
    for r in ancova.ancova(suffstats.sufficient_stats(df, WIDE), WIDE).collect():
        up = math.log1p(r.relative_ci_high) - math.log1p(r.relative_lift)
        down = math.log1p(r.relative_lift) - math.log1p(r.relative_ci_low)
        assert up == pytest.approx(down, rel=1e-9)
        assert r.relative_ci_high - r.relative_lift != pytest.approx(r.relative_lift - r.relative_ci_low, rel=1e-6)


def test_collinear_and_constant_features_do_not_break_the_fit(spark):
    rng = np.random.default_rng(14)
    a = rng.normal(size=5_000)
    pdf = pd.DataFrame({"arm": np.arange(5_000) % 2, "a": a, "b": 2 * a, "k": 7.0, "y": 1.0 + 3 * a})
    spec = ExperimentSpec(metric="y", arm="arm", features=("a", "b", "k"))
    for r in models.fit_cells(suffstats.sufficient_stats(spark.createDataFrame(pdf), spec), spec).collect():
        assert r.rank == 1 and r.r2 == pytest.approx(1.0, abs=1e-9)
        assert r.coef[1] + 2 * r.coef[2] == pytest.approx(3.0, rel=1e-6) and r.coef[3] == 0.0


def test_degenerate_groups_report_a_status_instead_of_failing(spark):
    rows = [("no_control", 1, 1), ("no_control", 1, 0), ("no_treatment", 0, 1), ("no_treatment", 0, 0),
            ("zero", 1, 0), ("zero", 1, 0), ("zero", 0, 0), ("zero", 0, 0),
            ("single", 1, 1), ("single", 0, 0)]
    df = spark.createDataFrame(rows, "g string, arm int, y int").withColumn("x", F.lit(1.0))
    spec = replace(SPEC, keys=("g",), exposure=None)
    got = by(effects.estimates(paired(df, spec), spec), "g", "estimator")
    assert got["no_control", "unadjusted"]["status"] == "no_control"
    assert got["no_treatment", "cuped"]["status"] == "no_treatment"
    assert got["zero", "unadjusted"]["status"] == "zero_variance"
    assert got["single", "unadjusted"]["status"] == "too_few_rows"
    assert got["zero", "unadjusted"]["relative_lift"] is None
    assert effects.cuped_diagnostics(paired(df, spec), spec).count() == 4
    cells = suffstats.sufficient_stats(df, spec)
    assert ancova.ancova(cells, spec).count() == 8
    assert guardrails.balance_check(cells, spec).count() == 4


def test_rows_with_null_or_nan_are_left_out_of_every_sum(spark):
    rows = [(1, 1, 1.0), (1, None, 1.0), (0, 1, None), (0, 0, float("nan")), (0, 1, 2.0)]
    df = spark.createDataFrame(rows, "arm int, y int, x double")
    cells = by(suffstats.sufficient_stats(df, SPEC), "arm")
    assert {a: r["n"] for a, r in cells.items()} == {0: 1, 1: 1}
    counted = one(suffstats.completeness(df, SPEC))
    assert (counted["n_rows"], counted["n_complete"], counted["n_dropped"]) == (5, 2, 3)


def test_segments_equal_separate_runs(spark):
    df, _ = wide_experiment(spark, 15, 6_000)
    df = df.withColumn("seg", F.when(F.col("g1") > 5, "hi").otherwise("lo"))
    keyed = replace(WIDE, keys=("seg",))
    together = by(ancova.ancova(suffstats.sufficient_stats(df, keyed), keyed), "seg", "estimator")
    for seg in ("hi", "lo"):
        alone = by(ancova.ancova(suffstats.sufficient_stats(df.filter(F.col("seg") == seg), WIDE), WIDE), "estimator")
        for name, row in alone.items():
            assert together[seg, name]["absolute_effect"] == pytest.approx(row["absolute_effect"], rel=1e-9)
