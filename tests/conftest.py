import datetime as dt

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def candles(spark):
    """A maker of one-minute bars from (open, high, low, close[, minute]) rows, from 2024-01-01 on, numbered."""
    from tidemark.operators.bars import numbered

    def make(rows, start="2024-01-01T00:00:00", payouts=None):
        first = dt.datetime.fromisoformat(start).replace(tzinfo=dt.UTC)
        data = []
        for i, row in enumerate(rows):
            minute = row[4] if len(row) > 4 else i
            data.append((first + dt.timedelta(minutes=minute), *map(float, row[:4]), None if payouts is None else payouts[i]))
        return numbered(spark.createDataFrame(data, "ts timestamp, open double, high double, low double, close double, payout double"))

    return make
