"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts can be megabytes long, so Arrow batches are kept to few rows.
BATCH_ROWS = "400"


def tuned(spark: SparkSession) -> SparkSession:
    """Bound the bytes that one Arrow batch of whole texts can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def whole_text(column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_ids(start: int, count: int) -> np.ndarray:
    """Ids for rows made in this task, unique over tasks; store the rows before using them twice."""
    return (TaskContext.get().partitionId() << 36) + np.arange(start, start + count, dtype=np.int64)


def batches_of(schema: pa.Schema, columns: dict, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``rows`` rows from equally long columns."""
    arrays = [pa.array(columns[f.name], type=f.type) for f in schema]
    whole = pa.RecordBatch.from_arrays(arrays, schema=schema)
    for start in range(0, whole.num_rows, rows):
        yield whole.slice(start, rows)
