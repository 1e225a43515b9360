"""Joins of ledgers and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def enrich_at_signal(trades: DataFrame, context: DataFrame, columns: list[str], keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Left join of context columns at the signal's time; a repeated context time fails, as the match must be one.

    Only the named columns are shuffled; whether a side is small enough to broadcast is left to statistics.
    """
    at = context.groupBy(*keys, F.col("ts").alias("signal_ts")).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in columns])
    joined = trades.join(at, [*keys, "signal_ts"], "left")
    one = F.when(F.col("_n") > 1, F.raise_error(F.lit("context times are not unique")).cast("long")).otherwise(F.col("_n"))
    return joined.withColumn("_n", one).filter(F.col("_n").isNull() | (F.col("_n") > 0)).drop("_n")


def asof_backward(events: DataFrame, observations: DataFrame, tolerance_seconds: float, key: str = "asset",
                  event_ts: str = "ts", observed: str = "observed_at", value: str = "payout") -> DataFrame:
    """Events with the last observation of their key at or before their time, at most the tolerance old.

    Both sides are united and each event takes the last observation seen in the order of time:
    one shuffle by key and no pairs. An earlier column of the value's name gives way. Of equal
    observation times the greatest value counts. To spread a busy key over tasks, time is cut
    into spans; the last observation of each earlier span is carried over, one row a span.
    """
    span = F.date_trunc("day", "at")
    left = events.drop(value, observed, f"{value}_age_seconds")
    rows = left.select(F.col(key).alias("k"), F.col(event_ts).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<o:timestamp,v:double>").alias("obs"), F.struct(*left.columns).alias("row"))
    seen = observations.select(
        F.col(key).alias("k"), F.col(observed).alias("at"), F.lit(0).alias("kind"),
        F.struct(F.col(observed).cast("timestamp").alias("o"), F.col(value).cast("double").alias("v")).alias("obs"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"),
    )
    both = rows.unionByName(seen).withColumn("span", span)
    w = Window.partitionBy("k", "span").orderBy("at", "kind", "obs.v").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("inside", F.last("obs", ignorenulls=True).over(w))
    spans = both.groupBy("k", "span").agg(F.max("obs").alias("last_obs"))
    carry = Window.partitionBy("k").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("k", "span", F.last("last_obs", ignorenulls=True).over(carry).alias("carried"))
    out = both.filter("kind = 1").join(spans, ["k", "span"], "left").withColumn("hit", F.coalesce("inside", "carried"))
    age = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros("hit.o")) / 1e6
    out = out.withColumn("age", F.when(age <= tolerance_seconds, age))
    fresh = lambda c: F.when(F.col("age").isNotNull(), F.col(c))
    return out.select("row.*", fresh("hit.v").alias(value), fresh("hit.o").alias(observed), F.col("age").alias(f"{value}_age_seconds"))


def left_one_to_one(left: DataFrame, right: DataFrame, key: str, prefix: str, flag: str) -> DataFrame:
    """Left join on a key that must be unique on the right; right columns get the prefix, `flag` tells a match."""
    names = [c for c in right.columns if c != key]
    once = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(prefix + c) for c in names])
    joined = left.join(once, key, "left").withColumn(flag, F.col("_n").isNotNull())
    one = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{key} is not unique")).cast("boolean")).otherwise(F.col(flag))
    return joined.withColumn(flag, one).drop("_n")


def signal_by_index(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Bars with the signal of their bar_idx, none where there is no row."""
    keys = ["series_id", "slice", "bar_idx"]
    return bars.join(signals.select(*keys, "signal"), keys, "left").fillna({"signal": 0})


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two providers' candles on shared minutes: overlap, close deviation, agreement of bar direction."""
    both = left.select("ts", F.col("open").alias("o1"), F.col("close").alias("c1")).join(right.select("ts", F.col("open").alias("o2"), F.col("close").alias("c2")), "ts")
    return both.agg(
        F.count(F.lit(1)).alias("shared"), F.avg(F.abs(F.col("c1") - F.col("c2"))).alias("mean_close_deviation"),
        F.max(F.abs(F.col("c1") - F.col("c2"))).alias("max_close_deviation"),
        F.avg((F.signum(F.col("c1") - F.col("o1")) == F.signum(F.col("c2") - F.col("o2"))).cast("double")).alias("direction_agreement"),
    )


def new_only(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_anti")
