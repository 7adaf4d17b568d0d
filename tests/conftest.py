import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sensorframe.session import clear_scratch  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    spark = (
        SparkSession.builder.master("local[8]").appName("sensorframe-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    clear_scratch(spark)
    spark.stop()


@pytest.fixture
def make_events(spark):
    """Event table from ``(user, seconds after 2024-01-01 UTC, rssi, ssid)`` rows."""
    from sensorframe.schema import EVENT

    def make(rows):
        start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
        data = [(i, u, start + dt.timedelta(seconds=s), r, a) for i, (u, s, r, a) in enumerate(rows)]
        return spark.createDataFrame(data, EVENT)

    return make


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def scan_lines(df):
    """The file scans of a plan after it ran, one line each."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "FileScan" in line]
