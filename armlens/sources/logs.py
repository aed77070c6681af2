"""Reading experiment logs, storing and reusing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..spec import ExperimentSpec

STANDARD_FEATURES = tuple(f"f{i}" for i in range(12))
STANDARD_FLAGS = ("treatment", "conversion", "visit", "exposure")


def log_schema(
    features: Sequence[str] = STANDARD_FEATURES, flags: Sequence[str] = STANDARD_FLAGS
) -> StructType:
    """Declared schema of a flat log: double features, integer flags, all nullable."""
    return StructType(
        [StructField(f, DoubleType(), True) for f in features]
        + [StructField(f, IntegerType(), True) for f in flags]
    )


def read_csv_log(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: StructType | None = None,
    gzip_partitions: int | None = None,
) -> DataFrame:
    """CSV log with a header. The schema is declared, so there is no inference
    pass and a malformed row is an error.

    ``paths`` is one path or a list in order of preference: the first that exists
    is read (plain before compressed). A gzip file is one task to read; with
    ``gzip_partitions`` its rows are spread right after the scan, which gives
    up their stored order: the position check then asks for an order key.
    """
    candidates = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("header", True).option("mode", "FAILFAST").schema(schema or log_schema())
    for path in candidates:
        try:
            df = reader.csv(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        return df.repartition(gzip_partitions) if gzip_partitions and path.endswith(".gz") else df
    raise FileNotFoundError(f"no experiment log at {', '.join(candidates)}")


def write_csv_log(log: DataFrame, path: str) -> None:
    """Store a log or a sample of one as CSV with a header, replacing an earlier one."""
    log.write.mode("overwrite").option("header", True).csv(path)


def write_cells(cells: DataFrame, path: str) -> None:
    """Store a result-sized table of sums, replacing an earlier one."""
    cells.write.mode("overwrite").parquet(path)


def load_cells(spark: SparkSession, path: str) -> DataFrame:
    """Stored cells; an absent table is an error that says so."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no stored cells at {path}; write them first") from error


def cells_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """Reuse stored cells when present; otherwise compute, store and read them back."""
    try:
        return load_cells(spark, path)
    except FileNotFoundError:
        write_cells(compute(), path)
        return load_cells(spark, path)


def result_documents(table: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Each row as one JSON document beside its keys."""
    return table.select(*spec.keys, F.to_json(F.struct("*")).alias("document"))


def write_result(table: DataFrame, path: str) -> None:
    """Store a result table as JSON lines, replacing an earlier one."""
    table.write.mode("overwrite").option("ignoreNullFields", False).json(path)
