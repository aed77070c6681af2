import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from armlens.sources.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("armlens-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def one(df):
    """The single row of a result as a dict."""
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def by(df, *keys):
    """Rows as dicts, indexed by key columns."""
    pick = lambda r: r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)
    return {pick(r): r.asDict() for r in df.collect()}
