import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.stream import ewm, first_free

MINUTE = 60_000_000


def series(spark, xs, name="A", start=0):
    rows = [(name, "all", i + start, x) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "series_id string, slice string, minute long, x double").withColumn("ts", F.timestamp_micros(F.col("minute") * MINUTE))


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_means_do_not_depend_on_blocks(spark, block):
    pick = random.Random(block)
    long = [pick.gauss(1, 1) if pick.random() < 0.6 else None for _ in range(150)]
    every = {"A": long, "B": [None] * 20 + [2.0] + [None] * 30 + [5.0, None], None: [None, None, 3.0], "C": [None] * 5}
    df = None
    for name, xs in every.items():
        one = series(spark, xs, name, 3)
        df = one if df is None else df.unionByName(one)
    got = ewm(df, {"y": ("x", 0.3, 4), "z": ("x", 0.05, 1)}, block_us=block * MINUTE).toPandas()
    assert len(got) == df.count() and [*got.columns] == [*df.columns, "y", "z"]
    for name, xs in every.items():
        mine = got[got["series_id"].isna()] if name is None else got[got["series_id"] == name]
        mine = mine.sort_values("minute")
        for column, alpha, least in (("y", 0.3, 4), ("z", 0.05, 1)):
            want = pd.Series(xs, dtype=float).ewm(alpha=alpha, adjust=False, min_periods=least).mean()
            np.testing.assert_allclose(mine[column].to_numpy(float), want.to_numpy(), rtol=1e-9)


@pytest.mark.parametrize("block", [1, 5, 1000])
@pytest.mark.parametrize("waits", ["same", "mixed", "free"])
def test_trades_do_not_depend_on_blocks(spark, block, waits):
    pick = random.Random(f"{block}{waits}")
    rows, want = [], {}
    for name in ("A", "B", None):
        last = -1
        for start in sorted(pick.sample(range(1, 200), 80)):
            end = start + pick.randint(0, 12)
            wait = {"same": 2, "free": -(2**62)}.get(waits, pick.randint(0, 4))
            kept = start > last + wait
            last = end if kept else last
            rows.append((name, "all", start, end, wait))
            want[name, start] = kept
    df = spark.createDataFrame(rows, "series_id string, slice string, entry_idx long, exit_idx long, wait long").repartition(3)
    got = first_free(df, "entry_idx", "exit_idx", "wait", "entry_idx", block_bars=block).collect()
    assert {(r["series_id"], r["entry_idx"]): r["kept"] for r in got} == want and len(got) == len(rows)


def test_one_series_is_spread_over_tasks(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions would be put together again
    spark.conf.set(name, "false")
    try:
        _spread(spark)
    finally:
        spark.conf.unset(name)


def _spread(spark):
    df = series(spark, [float(i) for i in range(400)])
    spread = ewm(df, {"y": ("x", 0.1, 1)}, block_us=10 * MINUTE).withColumn("task", F.spark_partition_id())
    assert spread.select("task").distinct().count() > 1
    free = first_free(spark.range(400).selectExpr("'A' AS series_id", "'all' AS slice", "id AS s", "id + 3 AS e", "0 AS w"), "s", "e", "w", "s", block_bars=10)
    assert free.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1
    assert ewm(df.limit(0), {"y": ("x", 0.1, 1)}).count() == 0
