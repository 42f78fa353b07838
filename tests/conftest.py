import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from flowsieve.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "flowsieve-tests")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def arrivals(spark):
    """(scope, letter) pairs in arrival order -> a dedupe view."""
    from pyspark.sql import functions as F

    def make(pairs):
        rows = [(i, t, "", f) for i, (t, f) in enumerate(pairs)]
        df = spark.createDataFrame(rows, "seq bigint, tenant string, log_type string, name string")
        return df.withColumn("fp", F.unhex(F.sha2("name", 256)))

    return make


def verdicts(df, column="is_dup"):
    return [r[column] for r in df.select("seq", column).orderBy("seq").collect()]
