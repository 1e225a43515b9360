"""Validation, gap diagnostics and fingerprints of candle tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bars import numbered, require_columns, series, with_interval
from tidemark.schemas import KEYS, PRICES


def normalize(frame: DataFrame) -> DataFrame:
    """Five required columns, time as timestamp, prices as double; text that is no number fails; NaN becomes null."""
    require_columns(frame, ["ts", *PRICES])
    if dict(frame.dtypes)["ts"] not in ("timestamp", "timestamp_ntz"):
        frame = frame.withColumn("ts", F.col("ts").cast("timestamp"))
    return frame.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in PRICES})


def invalid_ohlc():
    return (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))


def diagnose(frame: DataFrame) -> DataFrame:
    """One row a series: counts, interval, gaps (all and those that touch a weekend day), largest gap, fingerprint."""
    bars = numbered(normalize(frame))
    rows = with_interval(bars).withColumn("before", F.lag("ts").over(series())).withColumnRenamed("step_us", "step")
    missing = F.greatest(F.lit(1), F.bround(F.col("step") / F.col("interval_us"))).cast("long") - 1
    gap = F.col("step") > F.col("interval_us")
    weekend = F.exists(F.sequence(F.to_date("before"), F.to_date("ts")), lambda d: F.weekday(d) >= 5)
    rows = rows.withColumns({"missing": F.when(gap, missing).otherwise(0), "gap": gap & (missing > 0), "wk": gap & (missing > 0) & weekend})
    count = lambda c: F.count_if(c)
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        (F.count(F.lit(1)) - F.count_distinct("ts")).alias("duplicate_timestamps"),
        count(invalid_ohlc()).alias("invalid_ohlc"), F.first("interval_us").alias("interval_us"),
        F.sum("missing").alias("missing_intervals"), count(F.col("gap")).alias("gap_events"),
        F.max(F.when(F.col("gap"), F.col("step"))).alias("largest_gap_us"),
        F.coalesce(F.sum(F.when(F.col("wk"), F.col("missing"))), F.lit(0)).alias("weekend_missing"), count(F.col("wk")).alias("weekend_gap_events"),
    )


def validate(frame: DataFrame, allow_gaps: bool = True) -> DataFrame:
    """The normalised frame; raises on repeated timestamps, invalid OHLC, or gaps unless allowed. One aggregate.

    Only series that must raise are taken, so allowed gaps hide none of them; the first by name is reported.
    """
    clean = normalize(frame)
    wrong = "duplicate_timestamps > 0 OR invalid_ohlc > 0" + ("" if allow_gaps else " OR missing_intervals > 0")
    for r in diagnose(frame).filter(wrong).orderBy(*KEYS).limit(1).collect():
        if r["duplicate_timestamps"]:
            raise ValueError(f"{r['series_id']}: {r['duplicate_timestamps']} duplicate timestamps")
        if r["invalid_ohlc"]:
            raise ValueError(f"{r['series_id']}: {r['invalid_ohlc']} bars with invalid OHLC")
        raise ValueError(f"{r['series_id']}: {r['missing_intervals']} missing intervals")
    return clean


def row_text(columns: list[str]):
    """Canonical text of a row, one for one set of cells: each cell's length, a colon and its text; a null is a dash."""
    text = [F.col(c).cast("string") for c in columns]
    return F.concat_ws(",", *[F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def fingerprint(frame: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """SHA-256 identity of a table that does not depend on row order, in one partially aggregated pass.

    The row hashes' low and high parts are summed, with the count; so no task gathers the rows.
    """
    columns = sorted(frame.columns)
    h = F.sha2(row_text(columns), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = frame.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), *[part(1 + 12 * k).alias(f"s{k}") for k in range(5)])
    text = F.concat_ws("|", F.lit(",".join(columns)), F.col("row_count").cast("string"), *[F.coalesce(f"s{k}", F.lit("0")) for k in range(5)])
    return sums.select(*by, "row_count", F.sha2(text, 256).alias("fingerprint"))


