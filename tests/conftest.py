import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from inkweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=os.environ.get("BENCH_CPUS", "8"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one expression over one row of named strings."""
    from pyspark.sql import functions as F

    def run(make, **columns):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
        return row.select(make(*[F.col(k) for k in columns]).alias("v")).first()["v"]

    return run
