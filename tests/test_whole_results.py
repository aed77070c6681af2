"""No row, fold or key is lost on the way through the operators."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from armlens import ExperimentReport, ExperimentSpec
from armlens.operators import guardrails, models, position, selection, sequential, suffstats, uplift
from armlens.operators.quality import FlagDomainError

from .conftest import by


def frame(spark, n=4000, folds=5):
    rng = np.random.default_rng(11)
    t = (rng.random(n) < 0.85).astype(int)
    f = rng.normal(size=n).round(2)
    return spark.createDataFrame(pd.DataFrame({
        "treatment": t, "conversion": (rng.random(n) < 0.2 + 0.05 * t).astype(int), "f0": f, "f1": rng.normal(size=n),
        "fold": rng.integers(0, folds, n) + 10, "segment": np.where(rng.random(n) < 0.3, None, "a"),
    }))


SPEC = ExperimentSpec(features=("f0",), fold="fold")


def test_any_number_of_folds_and_null_keys_are_binned(spark):
    df = frame(spark)
    for spec in (SPEC, replace(SPEC, keys=("segment",))):
        bins = uplift.uplift_bins(df, spec)
        assert bins.agg(F.sum("n")).first()[0] == df.count()
        per_fold = models.fold_cells(df, spec)
        cells = models.index_cells(per_fold, models.covariate_models(per_fold, spec), spec)
        assert cells.where("sum_xs IS NULL").count() == 0
        assert cells.agg(F.sum("n")).first()[0] == df.count()


def test_a_null_fold_is_counted_as_dropped(spark):
    df = frame(spark).withColumn("fold", F.when(F.col("f0") > 1, None).otherwise(F.col("fold")))
    counts = suffstats.completeness(df, SPEC).first()
    assert counts.n_dropped == df.where("fold IS NULL").count() > 0
    assert uplift.uplift_bins(df, SPEC).agg(F.sum("n")).first()[0] == counts.n_complete


def test_null_key_passes_the_gate_and_has_a_verdict(spark):
    spec = replace(SPEC, keys=("segment",), fold=None)
    df = frame(spark)
    cells = suffstats.sufficient_stats(df, spec)
    assert set(by(guardrails.balance_check(cells, spec), "segment")) == {None, "a"}
    srm = guardrails.srm_check(suffstats.arm_counts(df, spec), spec)
    rows = srm.select("segment", F.lit(1).alias("x"))
    assert {r.segment for r in guardrails.gate(rows, srm.withColumn("passed", F.lit(True)), spec).collect()} == {None, "a"}


def test_report_keeps_a_failing_key_and_the_identity_of_rows(spark):
    good = frame(spark).withColumn("segment", F.lit("good"))
    bad = frame(spark).where("treatment = 0 OR f1 < 0").withColumn("segment", F.lit("bad"))
    log = good.unionByName(bad)
    spec = ExperimentSpec(features=("f0",), keys=("segment",))
    report = ExperimentReport(log, spec)
    found = by(report["decision"], "segment")
    assert found["bad"]["decision"] == "withheld" and found["bad"]["lift"] is None
    assert found["good"]["decision"] != "withheld" and found["good"]["lift"] is not None
    # f1 tells rows apart that agree in what is analysed.
    found = report["duplicates"].first().asDict()
    assert found["distinct_rows"] == log.distinct().count()


def test_bad_flags_stop_the_report(spark):
    log = frame(spark).withColumn("treatment", F.when(F.col("f0") > 1, 2).otherwise(F.col("treatment")))
    report = ExperimentReport(log, ExperimentSpec(features=("f0",)))
    with pytest.raises(FlagDomainError):
        report["effects"]
    assert report["quality"].first().bad_treatment > 0


def test_stored_order_over_files_of_unequal_size(spark, tmp_path):
    start = 0
    for name, n in (("a", 200), ("b", 50_000), ("c", 7_000)):
        spark.range(start, start + n, 1, 1).withColumn("treatment", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / name))
        start += n
    df = spark.read.parquet(*(str(tmp_path / name) for name in "abc"))
    got = position.with_block(df.select("id", "treatment"), 9)
    assert got.where(F.col("block") != F.floor(F.col("id") * 9 / start)).count() == 0


@pytest.mark.parametrize("codec", ["none", "gzip"])
def test_stored_order_over_text_files_of_unequal_size(spark, tmp_path, codec):
    start = 0
    for name, n in (("a", 200), ("b", 50_000), ("c", 3_000)):
        rows = spark.range(start, start + n, 1, 1).withColumn("treatment", F.lit(1)).coalesce(1)
        rows.write.option("header", True).option("compression", codec).csv(str(tmp_path / name))
        start += n
    reader = spark.read.option("header", True).schema("id long, treatment int")
    # Small splits, so that a plain file is read by several tasks and a task reads several files.
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = reader.csv([str(tmp_path / name) for name in "bca"])
        got = position.with_block(df, 9)
        assert got.where(F.col("block") != F.floor(F.col("id") * 9 / start)).count() == 0
        later = position.with_block(df.where("id % 3 = 0"), 4)
        n = -(-start // 3)
        assert later.where(F.col("block") != F.floor(F.col("id") / 3 * 4 / n)).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert not position.has_stored_order(df.repartition(3))
    with pytest.raises(ValueError, match="stored order"):
        position.with_block(df.repartition(3), 9)
    log = df.withColumn("conversion", F.lit(0))
    spec = ExperimentSpec(features=("id",))
    assert "position" in ExperimentReport(log, spec).tables and "position" not in ExperimentReport(log.repartition(3), spec).tables


def test_exact_cut_points_per_key(spark):
    rng = np.random.default_rng(8)
    groups = {
        "normal": rng.normal(size=5_001), "ties": np.repeat([1.0, 2.0, 3.0], 40), "one": np.array([7.5]),
        None: np.concatenate([rng.normal(size=300) * 1e-12, [1e9, -1e9, np.inf, -np.inf]]), "nan": np.array([np.nan, np.nan]),
        "large": 1e15 + rng.integers(0, 9, 700), "halves": np.array([-0.0, 0.0, 5e-324, -5e-324]),
    }
    rows = pd.DataFrame([(k, v) for k, vs in groups.items() for v in vs], columns=["k", "x"])
    df = spark.createDataFrame(rows.sample(frac=1, random_state=1), "k string, x double").unionByName(
        spark.createDataFrame([("normal", None), ("none", None)], "k string, x double"))
    ranks = [(i, 10) for i in range(0, 11)]
    for parts in (4, 4096):
        got = {(r.k, r.at): r.value for r in selection.values_at_ranks(df, "x", ranks, ["k"], parts).collect()}
        wanted = {}
        for k, values in groups.items():
            values = np.sort(values[~np.isnan(values)])
            if len(values):
                wanted |= {(k, i): values[max(1, -(-i * len(values) // 10)) - 1] for i in range(11)}
        assert got == wanted
    whole = np.sort(np.concatenate([v[~np.isnan(v)] for v in groups.values()]))
    got = {r.at: r.value for r in selection.values_at_ranks(df, "x", ranks[1:]).collect()}
    assert got == {i - 1: whole[-(-i * len(whole) // 10) - 1] for i in range(1, 11)}


def test_replicates_follow_the_design_share_without_multiplying_units(spark):
    units = spark.range(20_000).select("id", F.lit(1).alias("look"), F.lit(1).alias("n"), F.lit(0.0).alias("sum_y"))
    looks = sequential.aa_replicates(units, replace(SPEC, design_share=0.85), "id", 5)
    for r in looks.collect():
        assert r.n_treatment + r.n_control == 20_000 and abs(r.n_treatment / 20_000 - 0.85) < 0.01
    assert sequential.tuned_rho(ExperimentSpec().n_planned) > 0
