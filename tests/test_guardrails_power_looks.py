import math
from dataclasses import replace
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from armlens import ExperimentSpec
from armlens.operators import decision, effects, guardrails, moments, power, sequential, suffstats
from tests.conftest import by, one

SPEC = ExperimentSpec()


def counts(spark, *rows):
    return spark.createDataFrame(list(rows), "g string, n_treatment long, n_control long")


KEYED = replace(SPEC, keys=("g",))


def test_srm_on_clean_broken_and_constructed_splits(spark):
    got = by(guardrails.srm_check(counts(
        spark, ("clean", 850_123, 149_877), ("lost", 833_000, 150_000), ("exact", 8_500_000, 1_500_000),
        ("noisy", 8_502_400, 1_497_600), ("empty", 0, 0),
    ), KEYED), "g")
    assert got["clean"]["passed"] and not got["clean"]["underdispersed"]
    assert not got["lost"]["passed"] and got["lost"]["p_value"] < 1e-6
    assert got["exact"]["passed"] and got["exact"]["underdispersed"]
    assert got["noisy"]["passed"] and not got["noisy"]["underdispersed"]
    assert got["empty"]["status"] == "empty" and got["empty"]["passed"] is None


def test_srm_on_published_counts(spark):
    got = by(guardrails.srm_check(counts(
        spark, ("all", 11_882_655, 2_096_937), ("dedup", 10_672_159, 2_047_888),
        ("singleton", 9_756_726, 2_001_716),
    ), KEYED), "g")
    assert got["all"]["z_score"] == pytest.approx(0.0013482492, abs=1e-9)
    assert got["all"]["p_value"] == pytest.approx(0.9989242531, abs=1e-9)
    assert got["all"]["nearest_simple_ratio"] == "17/3" and got["all"]["ratio_looks_constructed"]
    assert got["dedup"]["z_score"] == pytest.approx(-109.8396455, abs=1e-6)
    assert got["singleton"]["z_score"] == pytest.approx(-194.3368588, abs=1e-6)
    assert got["dedup"]["p_value"] == 0.0 and got["dedup"]["log10_p"] < -2000


def test_srm_depends_on_the_assumed_design(spark):
    rows = by(guardrails.srm_sensitivity(counts(spark, ("a", 850_000, 150_000)), KEYED),
              "assumed_treatment_share")
    assert len(rows) == 8 and rows[0.85]["passed"]
    assert not any(r["passed"] for s, r in rows.items() if s != 0.85)


def test_designed_share_can_differ_per_experiment(spark):
    spec = replace(SPEC, keys=("g", "share"), design_share="share")
    df = counts(spark, ("half", 5_030, 4_970), ("skew", 8_480, 1_520)).withColumn(
        "share", F.when(F.col("g") == "half", 0.5).otherwise(0.85))
    assert all(r.passed for r in guardrails.srm_check(df, spec).collect())
    with pytest.raises(ValueError):
        ExperimentSpec(design_share=1.0)


def test_nearest_ratio_equals_the_full_grid_search(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(1, 100_000, (60, 2))] + [(5, 2), (7, 0), (0, 9)]
    df = counts(spark, *[(str(i), a, b) for i, (a, b) in enumerate(pairs)])
    got = by(guardrails.nearest_ratio(df), "g")
    for i, (n_t, n_c) in enumerate(pairs):
        if not n_c:
            assert got[str(i)]["nearest_simple_ratio"] is None or got[str(i)]["arm_ratio"] is None
            continue
        best = min((abs(n_t / n_c - a / b), b, a) for b in range(1, 21) for a in range(1, 101))
        assert got[str(i)]["nearest_simple_ratio"] == f"{best[2]}/{best[1]}"


def balance_data(spark, shift_a, shift_b, n=40_000, rho=0.0, seed=2):
    rng = np.random.default_rng(seed)
    arm = np.arange(2 * n) % 2
    a = rng.normal(size=2 * n)
    b = rho * a + math.sqrt(1 - rho**2) * rng.normal(size=2 * n)
    pdf = pd.DataFrame({"treatment": arm, "conversion": 0, "a": a + shift_a * arm, "b": b + shift_b * arm})
    return spark.createDataFrame(pdf), pdf


PAIR = replace(SPEC, features=("a", "b"))


def test_balance_verdicts(spark):
    check = lambda *s, **k: one(guardrails.balance_check(
        suffstats.sufficient_stats(balance_data(spark, *s, **k)[0], PAIR), PAIR))
    assert check(0.0, 0.0)["verdict"] == "balanced"
    fired = check(0.30, 0.0)
    assert fired["verdict"] == "imbalanced" and fired["max_abs_smd_feature"] == "a"
    assert fired["max_abs_smd"] == pytest.approx(0.30, abs=0.03) and fired["hotelling_p"] < 1e-6
    # Each feature is fine alone; moved against their correlation they are not.
    joint = check(0.02, -0.02, rho=0.9)
    assert joint["verdict"] == "negligible" and joint["max_abs_smd"] < 0.1


def test_hotelling_matches_numpy(spark):
    df, pdf = balance_data(spark, 0.05, -0.02, n=3_000, rho=0.5)
    got = one(guardrails.hotelling(suffstats.sufficient_stats(df, PAIR), PAIR))
    t, c = (pdf[pdf.treatment == v][["a", "b"]] for v in (1, 0))
    pooled = (np.cov(t.T) * (len(t) - 1) + np.cov(c.T) * (len(c) - 1)) / (len(pdf) - 2)
    gap = (t.mean() - c.mean()).to_numpy()
    t2 = len(t) * len(c) / len(pdf) * gap @ np.linalg.solve(pooled, gap)
    assert got["hotelling_t2"] == pytest.approx(t2, rel=1e-9)
    assert got["hotelling_f"] == pytest.approx(t2 * (len(pdf) - 3) / (2 * (len(pdf) - 2)), rel=1e-9)
    assert not got["singular"]


def test_gate_withholds_effects_when_the_split_is_broken(spark):
    df = spark.createDataFrame(
        [("ok", 1)] * 850 + [("ok", 0)] * 150 + [("bad", 1)] * 500 + [("bad", 0)] * 500,
        "g string, treatment int").withColumn("conversion", (F.rand(1) < 0.3).cast("int"))
    cells = suffstats.sufficient_stats(df, KEYED)
    rows = effects.estimates(moments.paired_moments(cells, KEYED, None), KEYED, ("unadjusted",))
    srm = guardrails.srm_check(suffstats.arm_counts(df, KEYED), KEYED)
    assert {r.g for r in guardrails.gate(rows, srm, KEYED).collect()} == {"ok"}


def cells(spark, n_t, k_t, n_c, k_c):
    return spark.createDataFrame([(1, n_t, float(k_t), float(k_t)), (0, n_c, float(k_c), float(k_c))],
                                 "treatment int, n long, sum_y double, sum_yy double")


PUBLISHED = (11_882_655, 36_711, 2_096_937, 4_063)


def test_power_round_trips(spark):
    design = spark.createDataFrame([(0.002, m, 0.5) for m in (0.02, 0.05, 0.1, 0.2)] + [(0.002, 0.05, 0.85)],
                                   "baseline_rate double, mde_relative double, treatment_share double")
    rows = power.design_table(design, SPEC)
    rows = rows.withColumn("pw", power.achieved_power(F.col("effect_size_h"), F.col("n_per_arm_balanced"), SPEC))
    got = by(rows, "mde_relative", "treatment_share")
    for m in (0.02, 0.05, 0.1, 0.2):
        assert got[m, 0.5]["pw"] == pytest.approx(0.8, abs=1e-3)
    sizes = [got[m, 0.5]["n_per_arm_balanced"] for m in (0.2, 0.1, 0.05, 0.02)]
    assert sizes == sorted(sizes)
    cost = got[0.05, 0.85]["n_total_required"] / (2 * got[0.05, 0.5]["n_per_arm_balanced"])
    assert cost == pytest.approx(1.96, abs=0.02)


def test_smallest_detectable_lift_on_published_counts(spark):
    r = one(power.power_summary(cells(spark, *PUBLISHED), SPEC))
    assert r["smallest_detectable_lift"] == pytest.approx(0.0482, abs=5e-5)
    at = one(power.power_grid(cells(spark, *PUBLISHED), SPEC, [r["smallest_detectable_lift"]]))
    assert at["achieved_power"] == pytest.approx(0.8, abs=1e-4)
    assert r["powered"]


def test_weak_designs_keep_both_tails(spark):
    r = one(power.power_grid(cells(spark, 100, 1, 100, 1), SPEC, [1e-6]))
    assert r["achieved_power"] == pytest.approx(0.05, abs=1e-4)


def test_always_valid_interval_on_published_counts(spark):
    pairs = moments.paired_moments(cells(spark, *PUBLISHED), SPEC, None)
    r = one(sequential.always_valid(pairs, SPEC, "n_eff"))
    assert r["fixed_ci_low"] == pytest.approx(0.0010845058, abs=1e-10)
    assert r["fixed_ci_high"] == pytest.approx(0.0012192403, abs=1e-10)
    assert r["always_valid_ci_low"] == pytest.approx(0.0009491721, abs=1e-10)
    assert r["always_valid_ci_high"] == pytest.approx(0.0013545740, abs=1e-10)
    assert r["width_penalty"] == pytest.approx(3.0088929037, abs=1e-8)
    tuned = one(sequential.always_valid(pairs, SPEC, sequential.tuned_rho(r["n_eff"])))
    assert tuned["boundary"] < 3.1 < r["boundary"]
    with pytest.raises(ValueError):
        sequential.always_valid(pairs, SPEC, 0.0)


def test_tuned_rho_is_close_to_the_best_constant():
    n, alpha = 1_000_000.0, 0.05
    width = lambda rho: math.sqrt((n * rho + 1) / (n * rho) * math.log((n * rho + 1) / alpha**2))
    best = min(width(10 ** (e / 50) / n) for e in range(-100, 200))
    assert width(sequential.tuned_rho(n)) == pytest.approx(best, rel=1e-3)


def test_look_replay_matches_a_loop(spark):
    rng = np.random.default_rng(3)
    n = 5_003
    pdf = pd.DataFrame({"t": rng.permutation(n), "treatment": rng.integers(0, 2, n), "conversion": rng.integers(0, 2, n)})
    df = spark.createDataFrame(pdf).repartition(6)
    got = by(sequential.look_replay(df, SPEC, 7, ["t"]), "look")
    ordered = pdf.sort_values("t").reset_index(drop=True)
    look = np.arange(n) * 7 // n + 1
    for k in range(1, 8):
        seen = ordered[look <= k]
        t, c = seen[seen.treatment == 1].conversion, seen[seen.treatment == 0].conversion
        p = seen.conversion.mean()
        z = (t.mean() - c.mean()) / math.sqrt(p * (1 - p) * (1 / len(t) + 1 / len(c)))
        assert (got[k]["n_treatment"], got[k]["n_control"]) == (len(t), len(c))
        assert got[k]["z"] == pytest.approx(z, rel=1e-9)


def test_peeking_inflates_the_false_positive_rate(spark):
    df = spark.range(4_000).select(
        F.col("id"), F.lit(0).alias("treatment"), (F.pmod(F.xxhash64("id"), F.lit(10)) < 3).cast("int").alias("conversion"))
    units = sequential.unit_looks(df, SPEC, "id", 10, ["id"])
    rates = by(sequential.aa_false_positive_rate(sequential.aa_replicates(units, SPEC, "id", 300), SPEC), "n_looks")
    assert rates[1]["false_positive_rate"] == pytest.approx(0.05, abs=0.04)
    assert 0.12 < rates[10]["false_positive_rate"] < 0.30


def effect_rows(spark, *rows):
    return spark.createDataFrame(
        list(rows), "estimator string, relative_lift double, relative_ci_low double, relative_ci_high double, p_value double")


@pytest.mark.parametrize("low,verdict", [(0.12, "ship"), (0.05, "marginal"), (-0.01, "hold"), (None, "undetermined")])
def test_decision_follows_the_worst_bound(spark, low, verdict):
    rows = effect_rows(spark, ("unadjusted", 0.3, 0.2, 0.4, 0.0), ("cuped", 0.25, 0.2, 0.3, 0.0), ("lin", 0.2, low, 0.3, 0.0))
    assert one(decision.ship_decision(rows, SPEC))["decision"] == verdict


@pytest.mark.parametrize("gain,passed,lead", [(3.0, True, "cuped"), (1.0, True, "unadjusted"), (1.0, False, "cuped")])
def test_leading_estimate(spark, gain, passed, lead):
    rows = effect_rows(spark, ("unadjusted", 0.3, 0.2, 0.4, 0.0), ("cuped", 0.25, 0.2, 0.3, 0.0))
    curve = spark.createDataFrame([(0.15, gain, 0.2, 0.4)], "lowest_ci_bound double, adjustment_stability_gain double, lift_min double, lift_max double")
    balance = spark.createDataFrame([(passed,)], "passed boolean")
    got = one(decision.ship_decision(rows, SPEC, curve, balance))
    assert got["leading_estimate"] == lead and got["worst_case_lower_bound"] == 0.15 and got["ship"]
    assert got["point_estimate"] == (0.25 if lead == "cuped" else 0.3)
