"""Session settings and materialisation of small intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that can also be changed on a running session.
SESSION_CONF = {
    # The sums of 12 features are more than 100 output fields, the point at which
    # Spark stops compiling a stage by default.
    "spark.sql.codegen.maxFields": "400",
    # The JVM never compiles a method over 8000 bytes, so a wider generated stage
    # is interpreted for good; below the limit Spark uses its smaller, compiled parts.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

RECOMMENDED_CONF = {
    **SESSION_CONF,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.sql.session.timeZone": "UTC",
    # Call-site capture on every column operation triples the time to build wide plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the recommended settings to a session builder."""
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    return builder


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended runtime settings to a session made elsewhere."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors can reach.

    It is the one named in ``spark.checkpoint.dir``. A local session without
    that setting (tests, a notebook) uses a folder below its warehouse; on a
    cluster the setting is required, because a machine-local folder would not
    be seen by the other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage.

    Used for small but expensive tables (per-arm sums, model coefficients) and
    for order keys, so a lost executor costs a read and not another pass over
    the log.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Unlike ``durable`` the result is columnar, compressed and of known size, so
    Spark prunes its columns and chooses joins by its bytes. The files go when
    the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/armlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
