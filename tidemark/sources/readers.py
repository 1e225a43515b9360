"""Readers and writers of candle and payout files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import require_columns
from tidemark.operators.validate import fingerprint, validate
from tidemark.schemas import PAYOUT, PRICES

PUBLIC_COLUMNS = ["ts", *PRICES, "volume", "spread", "real_volume"]
#: Times in text, to the microsecond.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
#: Milliseconds from this number of units on, seconds below.
MILLIS_FROM = 1_000_000_000_000


def suffix_of(path: str) -> str:
    for name, kind in ((".csv", "csv"), (".csv.gz", "csv"), (".parquet", "parquet"), (".pq", "parquet")):
        if path.lower().endswith(name):
            return kind
    raise ValueError(f"unsupported file type: {path}")


def read_frame(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV (with a header) or Parquet, by suffix; `timestamp` is read as `ts`."""
    kinds = {suffix_of(p) for p in paths}
    if len(kinds) != 1:
        raise ValueError("paths of one file type are needed")
    df = spark.read.option("header", True).csv(list(paths)) if kinds == {"csv"} else spark.read.parquet(*paths)
    return df.withColumnRenamed("timestamp", "ts") if "ts" not in df.columns else df


def load_dataset(spark: SparkSession, path: str, allow_gaps: bool = True) -> DataFrame:
    return validate(read_frame(spark, path), allow_gaps)


def read_public_csv(spark: SparkSession, path: str, rename: dict[str, str] | None = None, timestamp: str = "timestamp") -> DataFrame:
    """A third party's candles: columns renamed, the time column found, known columns kept, validated."""
    df = spark.read.option("header", True).csv(path)
    rename = rename or {}
    df = df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})
    name = rename.get(timestamp, timestamp)
    require_columns(df, [name])
    df = df.withColumnRenamed(name, "ts")
    require_columns(df, ["ts", *PRICES])
    kept = [c for c in PUBLIC_COLUMNS if c in df.columns]
    return validate(df.select(*kept).withColumns({c: F.col(c).cast("double") for c in kept[5:]}))


def read_weekly_quotes(spark: SparkSession, path: str, side: str = "mid") -> DataFrame:
    """Weekly (gzipped) CSV of bid and ask candles, columns in any case: side's OHLC, volume, open, close and mean spread."""
    return weekly_quotes(spark.read.option("header", True).csv(path), side)


def weekly_quotes(df: DataFrame, side: str = "mid") -> DataFrame:
    """The same from a table of text columns."""
    if side not in ("mid", "bid", "ask"):
        raise ValueError("side must be mid, bid or ask")
    have = {c.lower(): c for c in df.columns}
    at = next((have[k] for k in ("datetime", "date", "time") if k in have), None)
    if at is None:
        raise ValueError("no date column")
    missing = [f"{q}{p}" for q in ("bid", "ask") for p in PRICES if f"{q}{p}" not in have]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    quote = lambda q, p: F.col(have[f"{q}{p}"]).cast("double")
    price = lambda p: (quote("bid", p) + quote("ask", p)) / 2 if side == "mid" else quote(side, p)
    ticks = next((have[k] for k in ("tickqty", "tick_volume", "volume") if k in have), None)
    stamp = F.coalesce(F.try_to_timestamp(F.col(at)), F.to_timestamp(F.col(at), "MM/dd/yyyy HH:mm:ss.SSS"))
    out = df.select(
        stamp.alias("ts"), *[price(p).alias(p) for p in PRICES],
        *([F.coalesce(F.col(ticks).try_cast("double"), F.lit(0.0)).alias("volume")] if ticks else []),
        (quote("ask", "open") - quote("bid", "open")).alias("spread_open"), (quote("ask", "close") - quote("bid", "close")).alias("spread_close"),
    )
    return validate(out.withColumn("spread_mean_proxy", (F.col("spread_open") + F.col("spread_close")) / 2))


def epoch(value: Column) -> Column:
    """Timestamp of a number of seconds, or of milliseconds where it is that large."""
    x = value.cast("double")
    return F.timestamp_micros(F.when(F.abs(x) >= MILLIS_FROM, x * 1e3).otherwise(x * 1e6).cast("long"))


def payout_share(value: Column) -> Column:
    """A payout as a share: above 1 it is a percentage; outside [0, 1] it fails."""
    x = value.cast("double")
    x = F.when(x > 1, x / 100).otherwise(x)
    return F.when(x.between(0, 1), x).when(x.isNotNull(), F.raise_error(F.lit("unexpected payout")).cast("double"))


def parse_candle_payloads(payloads: DataFrame) -> DataFrame:
    """Candles of (payload, asset, period_seconds, payout) rows; payload is JSON text.

    The payload is a list, or an object with it under `candles`; an item is an array [time,
    open, close, high, low] or an object with timestamp, time or from, and prices. Items that
    are neither are skipped.
    """
    body = F.coalesce(F.get_json_object("payload", "$.candles"), F.col("payload"))
    rows = payloads.withColumn("item", F.explode(F.from_json(body, "array<string>")))
    get = lambda path: F.get_json_object("item", path).try_cast("double")
    is_array = F.col("item").startswith("[")
    cell = lambda i, *names: F.when(is_array, get(f"$[{i}]")).otherwise(F.coalesce(*[get(f"$.{n}") for n in names]))
    rows = rows.select(
        "asset", "period_seconds", payout_share(F.col("payout")).alias("payout"), cell(0, "timestamp", "time", "from").alias("_t"),
        cell(1, "open").alias("open"), cell(3, "high").alias("high"), cell(4, "low").alias("low"), cell(2, "close").alias("close"),
    ).filter("_t IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL")
    kind = F.when(F.lower("asset").endswith("_otc"), "otc").otherwise("regular")
    return rows.select(epoch(F.col("_t")).alias("ts"), *PRICES, "asset", kind.alias("market_type"), "period_seconds", "payout")


def read_payouts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of payout observations; a payout outside [0, 1] fails."""
    return checked_payouts(spark.read.schema(PAYOUT).json(path))


def append_payouts(observations: DataFrame, path: str) -> None:
    """Add observations to a directory of JSON lines."""
    checked_payouts(observations).write.mode("append").option("timestampFormat", MICROS).json(path)


def checked_payouts(df: DataFrame) -> DataFrame:
    require_columns(df, ["asset", "observed_at", "payout"])
    ok = F.col("payout").between(0, 1)
    return df.withColumn("payout", F.when(ok, F.col("payout").cast("double")).otherwise(F.raise_error(F.lit("payout must be between 0 and 1")).cast("double")))


def read_manifest(spark: SparkSession, path: str, asset: str, period_seconds: int) -> DataFrame:
    """Snapshot entries of an asset and period, each snapshot once."""
    df = spark.read.json(path)
    return df.filter((F.col("asset") == asset) & (F.col("period_seconds") == period_seconds)).dropDuplicates(["snapshot_id"])


def write_frame(df: DataFrame, path: str) -> None:
    """CSV or Parquet by suffix, with a header for CSV."""
    writer = df.write.mode("errorifexists").option("timestampFormat", MICROS).option("timestampNTZFormat", MICROS.removesuffix("XXX"))
    writer.option("header", True).csv(path) if suffix_of(path) == "csv" else writer.parquet(path)


def write_metadata(df: DataFrame, path: str, **provenance) -> dict:
    """A JSON sidecar with fingerprint, bounds and provenance, in a directory beside the data."""
    print_ = fingerprint(df).first()
    ends = df.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    meta = {"rows": print_["row_count"], "fingerprint": print_["fingerprint"], "start": str(ends["lo"]), "end": str(ends["hi"]), **provenance}
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(meta, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")
    return meta


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(report, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
