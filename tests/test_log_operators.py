"""Operators that read the log: quality, position, samples, sources, choices, uplift."""

import gzip
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from armlens import ExperimentReport, ExperimentSpec
from armlens.operators import models, position, quality, robustness, suffstats, uplift
from armlens.operators.folds import FOLD, with_fold
from armlens.sources import logs, samples
from tests.conftest import by, one

SPEC = ExperimentSpec()


def small_log(seed=1, n=4_000, distinct=None):
    """A log in the standard layout; ``distinct`` draws rows from that many records."""
    rng = np.random.default_rng(seed)
    m = distinct or n
    pdf = pd.DataFrame({f"f{i}": np.round(rng.normal(i, 1 + i % 3, m), 2) for i in range(12)})
    pdf["treatment"] = (rng.random(m) < 0.7).astype("int32")
    pdf["conversion"] = (rng.random(m) < 0.2 + 0.1 * pdf.treatment + 0.05 * (pdf.f0 > 0)).astype("int32")
    pdf["visit"] = np.maximum(pdf.conversion, rng.random(m) < 0.3).astype("int32")
    pdf["exposure"] = (pdf.treatment * (rng.random(m) < 0.4)).astype("int32")
    return pdf if distinct is None else pdf.iloc[rng.integers(0, m, n)].reset_index(drop=True)


STANDARD = ExperimentSpec(features=logs.STANDARD_FEATURES, post_covariate="visit", exposure="exposure", design_share=0.7)


def test_flag_checks_count_null_as_bad_and_gate(spark):
    df = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1), (None, 0, 1)], "treatment int, conversion int, visit int")
    got = quality.flag_quality(df, ("treatment", "conversion"), implications={"broken": ("conversion", "visit")})
    row = one(got)
    assert (row["n_rows"], row["bad_treatment"], row["bad_conversion"], row["broken"]) == (4, 2, 0, 1)
    with pytest.raises(quality.FlagDomainError):
        quality.require_clean_flags(got)
    with pytest.raises(Exception, match="values other than 0 and 1"):
        quality.clean_flags(df, ("treatment",)).collect()
    assert quality.clean_flags(df, ("conversion", "visit")).count() == 4


def test_duplicates_count_null_rows_too(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2), (0, 2)], "treatment int, x int")
    row = one(quality.duplicate_summary(quality.collapse(df, df.columns)))
    assert (row["n_rows"], row["distinct_rows"], row["exact_duplicate_rows"]) == (4, 3, 1)
    arms = by(quality.distinct_per_group(df, df.columns, ("treatment",)), "treatment")
    assert arms[1]["distinct_rows"] == 2 and arms[0]["distinct_rows"] == 1


def test_duplicate_profile_uses_the_singleton_rate(spark):
    rows = [("a", 1, 1)] * 6 + [("b", 1, 0)] * 2 + [(f"s{i}", 0, int(i < 1)) for i in range(4)]
    df = spark.createDataFrame(rows, "r string, treatment int, conversion int")
    row = one(quality.duplicate_profile(quality.collapse(df, df.columns), SPEC))
    assert row["rows_in_duplicate_groups"] == 8 and row["conversions"] == 6
    assert row["expected_conversions"] == pytest.approx(8 * 0.25) and row["treatment_share"] == 1.0


@pytest.mark.parametrize("most_bits", [1 << 28, 1 << 15])
def test_collapse_of_rare_copies_equals_the_plain_one(spark, most_bits):
    rng = np.random.default_rng(3)
    values = rng.normal(size=20_000).round(4)
    df = spark.createDataFrame(pd.DataFrame({"a": values, "b": rng.integers(0, 3, 20_000)}), "a double, b long")
    odd = spark.createDataFrame([(None, 1), (None, 1), (float("nan"), None), (float("nan"), None), (-0.0, 1), (0.0, 1), (5.5, None)], "a double, b long")
    df = df.unionByName(odd).unionByName(df.limit(50))
    wanted = {(str(r.a), r.b): r.multiplicity for r in quality.collapse(df, df.columns).collect()}
    got = quality.collapse_rare(df, df.columns, 20_000, most_bits).collect()
    assert {(str(r.a), r.b): r.multiplicity for r in got} == wanted and len(got) == len(wanted)
    assert quality.collapse_rare(df.where("false"), df.columns, 0).collect() == []


def test_stored_order_blocks_match_row_numbers(spark):
    n = 10_007
    df = spark.range(0, n, 1, 7).select("id", (F.col("id") < n * 0.35).cast("int").alias("treatment"))
    got = position.with_block(df, 10)
    assert got.filter(F.col("block") != F.floor(F.col("id") * 10 / n)).count() == 0
    summary = one(position.position_summary(position.share_by_block(df, SPEC), SPEC))
    assert summary["n_blocks"] == 10 and not summary["shuffled"] and summary["spread"] == 1.0


def test_ordered_blocks_on_shuffled_rows_and_on_one_hot_key(spark):
    rng = np.random.default_rng(4)
    n = 3_001
    df = spark.createDataFrame(pd.DataFrame({"k": rng.permutation(n), "treatment": 1})).repartition(9)
    got = position.with_block(df, 8, ["k"])
    assert got.filter(F.col("block") != F.floor(F.col("k") * 8 / n)).count() == 0
    # A value held by most rows: cut points equal the exact quantiles.
    values = np.concatenate([np.full(2_000, 5.0), rng.normal(size=1_001)])
    hot = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(9)
    cuts = position.rank_cuts(hot, "x", 10)
    ranked = np.sort(values)
    assert cuts == [ranked[-(-i * n // 10) - 1] for i in range(1, 10)]


def test_fixed_size_sample_by_rank_equals_the_sorted_one(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(5_000), "r": rng.integers(0, 40, 5_000)}), "id long, r long").repartition(5)
    df = df.withColumn("r", F.when(F.col("id") > 20, F.col("r")))
    for rank in (None, F.col("r"), F.col("r") * (1 << 55) + F.col("id") % 3):
        for n in (0, 1, 13, 21, 777, 5_000, 6_000):
            got, wanted = (
                {r.id for r in samples.fixed_size_sample(df, n, 3, rank, ["id"], most).collect()} for most in (-1, 10_000))
            assert got == wanted and len(got) == min(n, 5_000)
    assert samples.fixed_size_sample(df.where("false"), 7, 3, most_in_task=1).count() == 0


def test_sketches_of_segments_unite(spark):
    df = spark.range(0, 60_000, 1, 6).select(
        (F.col("id") % 20_000).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, F.lit(1.5)).alias("b"),
        F.lit(None).cast("double").alias("c"), (F.col("id") % 7).alias("k"))
    spec = ExperimentSpec(features=("a", "b", "c"), keys=("k",))
    whole = replace(spec, keys=())
    united = by(quality.united_cardinality(quality.cardinality_sketches(df, spec), spec), "feature")
    sketch, exact = (by(quality.feature_cardinality(df, whole, exact=e), "feature") for e in (False, True))
    assert {f: r["distinct_values"] for f, r in exact.items()} == {"a": 20_000, "b": 1, "c": 0}
    for f, r in exact.items():
        assert united[f]["distinct_values"] == pytest.approx(r["distinct_values"], rel=0.04)
        assert sketch[f]["distinct_values"] == pytest.approx(r["distinct_values"], rel=0.04)
    per_key = by(quality.feature_cardinality(df, spec, exact=True), "k", "feature")
    assert per_key[(0, "a")]["distinct_values"] == df.where("k = 0").select("a").distinct().count()


def test_fixed_size_sample_is_exact_and_holds_both_arms(spark, tmp_path):
    df = spark.range(0, 50_000, 1, 12).select("id", (F.col("id") < 20_000).cast("int").alias("treatment"))
    sample = samples.fixed_size_sample(df, 3_000, seed=5).cache()
    assert sample.count() == 3_000 and sample.select("id").distinct().count() == 3_000
    cover = by(samples.arm_coverage(sample, SPEC), "treatment")
    assert cover[0]["covered"] and cover[1]["covered"]
    head = by(samples.arm_coverage(df.filter("treatment = 1"), SPEC), "treatment")
    assert head[0]["n"] == 0 and not head[0]["covered"]
    logs.write_csv_log(sample, str(tmp_path / "sample"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sample")).count() == 3_000
    assert samples.fixed_size_sample(df.limit(10), 3_000, seed=5).count() == 10
    assert samples.arm_sample(df, SPEC, {0: 0.0, 1: 1.0}, 1).count() == 20_000
    assert samples.fraction_sample(df, 0.5, 1).count() == pytest.approx(25_000, rel=0.05)


def test_csv_log_plain_gzip_malformed_and_missing(spark, tmp_path):
    pdf = small_log(2, 200)
    columns = [*logs.STANDARD_FEATURES, *logs.STANDARD_FLAGS]
    text = pdf[columns].to_csv(index=False)
    plain, packed, broken = tmp_path / "log.csv", tmp_path / "log.csv.gz", tmp_path / "bad.csv"
    packed.write_bytes(gzip.compress(text.encode()))
    zipped = logs.read_csv_log(spark, [str(plain), str(packed)], gzip_partitions=4)
    assert zipped.count() == 200 and zipped.rdd.getNumPartitions() == 4
    plain.write_text(text)
    df = logs.read_csv_log(spark, [str(plain), str(packed)])
    assert df.schema == logs.log_schema() and df.count() == 200
    broken.write_text(text.replace("\n", "\nx,", 1))
    with pytest.raises(Exception):
        logs.read_csv_log(spark, str(broken)).collect()
    with pytest.raises(FileNotFoundError):
        logs.read_csv_log(spark, str(tmp_path / "none.csv"))


def test_cells_are_stored_reused_and_replaced(spark, tmp_path):
    path, calls = str(tmp_path / "cells"), []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(1, 2.0)], "treatment int, n double")

    with pytest.raises(FileNotFoundError):
        logs.load_cells(spark, path)
    for _ in range(2):
        assert one(logs.cells_or_compute(spark, path, compute))["n"] == 2.0
    assert len(calls) == 1
    logs.write_cells(spark.createDataFrame([(1, 3.0)], "treatment int, n double"), path)
    assert one(logs.load_cells(spark, path))["n"] == 3.0


def test_folds_keep_copies_together_and_ignore_the_outcome(spark):
    df = spark.createDataFrame(small_log(3, 2_000, distinct=300))
    folded = with_fold(df, STANDARD)
    assert folded.groupBy(*logs.STANDARD_FEATURES).agg(F.count_distinct(FOLD).alias("k")).filter("k > 1").count() == 0
    flipped = with_fold(df.withColumn("conversion", 1 - F.col("conversion")), STANDARD)
    assert folded.groupBy(FOLD).count().exceptAll(flipped.groupBy(FOLD).count()).count() == 0


def test_fold_complement_adds_the_other_folds(spark):
    df = spark.createDataFrame(small_log(4, 1_000)).withColumn("k", F.pmod(F.monotonically_increasing_id(), F.lit(3)).cast("int"))
    spec = ExperimentSpec(features=("f1",), fold="k", n_folds=3)
    cells = models.fold_cells(df, spec).cache()
    whole = by(suffstats.merge_cells(cells, spec), "treatment")
    own = by(cells, FOLD, "treatment")
    for (fold, arm), row in by(suffstats.fold_complement(cells, spec), FOLD, "treatment").items():
        assert row["n"] == whole[arm]["n"] - own[fold, arm]["n"]
        assert row["sum_f1_f1"] == pytest.approx(whole[arm]["sum_f1_f1"] - own[fold, arm]["sum_f1_f1"], rel=1e-9)


def test_choice_cells_match_pandas_with_a_hot_record(spark):
    pdf = small_log(5, 3_000, distinct=900)
    pdf = pd.concat([pdf, pd.concat([pdf.iloc[:1]] * 1_500)], ignore_index=True)
    spec = ExperimentSpec(features=("f0", "f1"), covariate="f0", post_covariate="visit", exposure="exposure")
    df = spark.createDataFrame(pdf)
    collapsed = quality.collapse(df, df.columns)
    got = by(robustness.spec_cells(collapsed, spec), "spec", "treatment")
    sizes = pdf.groupby(list(pdf.columns)).size().rename("m").reset_index()
    for name, weight in (("all", sizes.m), ("dedup", 1), ("singleton", (sizes.m == 1).astype(int))):
        w = sizes.assign(w=weight)
        for arm, g in w.groupby("treatment"):
            row = got[name, arm]
            assert row["n"] == g.w.sum()
            assert row["sum_y"] == (g.w * g.conversion).sum()
            assert row["sum_f0_f1"] == pytest.approx((g.w * g.f0 * g.f1).sum(), rel=1e-9)
            assert row["sum_exposure"] == (g.w * g.exposure).sum()


def test_spec_curve_summary_on_published_lifts(spark):
    """Published lifts and bounds of three row-handling choices."""
    rows = [
        ("all", True, 0.5944881177252619, 0.5436975672882334, 0.4736454982691847, 0.4318497710310485),
        ("dedup", False, 0.7338171985709434, 0.6785905715274012, 0.44244121607846454, 0.4046478108129994),
        ("singleton", False, 0.8537354028055766, 0.7946912016507248, 0.4210800837421358, 0.38598573422323534),
    ]
    curve = spark.createDataFrame(rows, "spec string, srm_passed boolean, lift_unadjusted double, "
                                  "lift_unadjusted_ci_low double, lift_cuped double, lift_cuped_ci_low double")
    r = one(robustness.spec_curve_summary(curve, SPEC))
    assert r["spread_factor_unadjusted"] == pytest.approx(1.4360848894, abs=1e-9)
    assert r["spread_factor_cuped"] == pytest.approx(1.1248347204, abs=1e-9)
    assert r["adjustment_stability_gain"] == pytest.approx(3.4932980822, abs=1e-8)
    assert r["spread_factor"] == pytest.approx(2.0274893916, abs=1e-9)
    assert r["lowest_ci_bound"] == pytest.approx(0.3859857342, abs=1e-9)
    assert not r["srm_stable"] and r["sign_stable"]


# A published decile table (bin, n_t, n_c, conversions_t, conversions_c, mean score).
DECILES = [
    (0, 1182074, 214586, 293.0, 42.0, -0.0009300843447951582),
    (1, 1180749, 214096, 330.0, 48.0, -0.000663823587262359),
    (2, 1186401, 213385, 177.0, 19.0, -0.00047334360013267856),
    (3, 1185090, 211711, 127.0, 11.0, -0.0003824835085125236),
    (4, 1187658, 211288, 170.0, 10.0, -0.00027391542959554095),
    (5, 1186267, 211334, 247.0, 31.0, -0.00012919036762308177),
    (6, 1183806, 212086, 374.0, 42.0, 8.835197455225526e-05),
    (7, 1186587, 211282, 1050.0, 126.0, 0.0006334986658401722),
    (8, 1191390, 207548, 2504.0, 303.0, 0.002095857727790546),
    (9, 1212633, 189621, 31439.0, 3431.0, 0.010008443151196113),
]


def test_uplift_report_on_a_published_decile_table(spark):
    rows = [(b, a, n, y, s) for b, nt, nc, yt, yc, s in DECILES for a, n, y in ((1, nt, yt), (0, nc, yc))]
    bins = spark.createDataFrame(rows, "bin int, treatment int, n long, conversions double, mean_score double")
    for order in ("pooled", "treatment"):
        table = uplift.uplift_table(bins, SPEC, order)
        r = one(uplift.uplift_summary(table, SPEC))
        assert r["qini_ratio"] == pytest.approx(0.8143314034, abs=1e-9)
        assert r["ate_absolute"] == pytest.approx(0.0011518731, abs=1e-9)
        assert r["chi2"] == pytest.approx(13915.2, abs=0.05) and r["heterogeneity_p"] == 0.0
        assert r["top_vs_bottom_ratio"] == pytest.approx(150.2049310, abs=1e-6)
        assert r["share_of_effect_in_top_bins"] == pytest.approx(0.9463901016, abs=1e-9)
    curve = by(uplift.qini_curve(table, SPEC), "step")
    assert curve[0]["population_share"] == 0.0 and curve[10]["population_share"] == pytest.approx(1.0)
    assert curve[1]["incremental_conversions"] == pytest.approx(10982.791015957693, rel=1e-9)
    assert curve[10]["incremental_conversions"] == pytest.approx(12979.868897375367, rel=1e-9)


def test_bins_follow_the_strictly_below_rule_and_drop_missing_scores(spark):
    rows = [(0.0,), (1.0,), (1.0,), (2.0,), (float("inf"),), (None,)]
    scored = spark.createDataFrame(rows, "uplift_score double").withColumns(
        {"treatment": F.lit(1), "conversion": F.lit(0)})
    edges = spark.createDataFrame([([1.0, 2.0],)], "edges array<double>")
    binned = uplift.assign_bins(scored, edges, SPEC, 10)
    assert [r.bin for r in binned.collect()] == [0, 0, 0, 1, 2, None]
    assert {r.bin: r.n for r in uplift.bin_stats(binned, SPEC).collect()} == {0: 3, 1: 1, 2: 1}
    assert one(uplift.unscored(scored, SPEC))["n_unscored"] == 1


def test_uplift_bins_with_one_arm_only_are_left_out(spark):
    rows = [(0, 1, 10, 3.0, 0.1), (0, 0, 10, 1.0, 0.1), (1, 1, 5, 1.0, 0.2)]
    bins = spark.createDataFrame(rows, "bin int, treatment int, n long, conversions double, mean_score double")
    assert [r.bin for r in uplift.uplift_table(bins, SPEC).collect()] == [0]


def test_uplift_finds_planted_heterogeneity(spark):
    rng = np.random.default_rng(6)
    n = 40_000
    pdf = pd.DataFrame({"f0": rng.normal(size=n), "f1": rng.normal(size=n), "treatment": np.arange(n) % 2})
    pdf["conversion"] = (rng.random(n) < 0.2 + pdf.treatment * 0.1 * (pdf.f0 > 0.5)).astype(int)
    spec = ExperimentSpec(features=("f0", "f1"))
    df = spark.createDataFrame(pdf)
    sketch = one(uplift.uplift_summary(uplift.uplift_table(uplift.uplift_bins(df, spec), spec), spec))
    exact = one(uplift.uplift_summary(uplift.uplift_table(uplift.uplift_bins(df, spec, exact=True), spec), spec))
    for r in (sketch, exact):
        assert r["heterogeneity_detected"] and r["qini_ratio"] > 0.3 and r["n_bins"] == 10
    assert exact["qini_ratio"] == pytest.approx(sketch["qini_ratio"], abs=0.05)


@pytest.mark.parametrize("keys", [(), ("seg",)])
def test_report_builds_and_writes_every_table(spark, tmp_path, keys):
    pdf = small_log(7, 6_000, distinct=3_000).assign(seg=lambda d: np.where(d.f3 > 3, "hi", "lo"))
    spec = replace(STANDARD, features=("f0", "f1", "f2"), keys=keys)
    report = ExperimentReport(spark.createDataFrame(pdf), spec)
    report.write(str(tmp_path / "out"))
    groups = 2 if keys else 1
    assert report.summary.count() == groups and report["spec_curve"].count() == 3 * groups
    stored = spark.read.json(str(tmp_path / "out" / "decision"))
    assert stored.count() == groups and "worst_case_lower_bound" in stored.columns
    assert logs.load_cells(spark, str(tmp_path / "out" / "cells")).count() == 2 * groups
    plain = ExperimentReport(spark.createDataFrame(pdf), spec, choices=False)
    with_choices, without = by(report["effects"], *keys, "estimator"), by(plain["effects"], *keys, "estimator")
    for key, row in without.items():
        assert with_choices[key]["absolute_effect"] == pytest.approx(row["absolute_effect"], rel=1e-9)
    with pytest.raises(KeyError):
        plain["spec_curve"]
