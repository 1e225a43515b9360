"""Acquisition of hourly and weekly objects: a table of URLs, fetched by tasks, retried, and kept with provenance."""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import lzma
import time
import urllib.error
import urllib.request
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import normalize_symbol, price_divisor, ticks_to_candles
from tidemark.sources.readers import weekly_quotes

RETRY_STATUS = (429, 500, 502, 503, 504)
#: Fixed value: a tick record, big-endian: milliseconds in the hour, ask and bid in points, volumes.
TICK_RECORD = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])
PROVENANCE = "url string, status string, attempts int, sha256 string, error string, payload binary"
PERIODS = ("m1", "H1")


class AcquisitionError(RuntimeError):
    """Objects that could not be had: `count` of them. The rows of `manifest` with status failed are all; `failures` has (url, error) of some."""

    def __init__(self, failures: list[tuple[str, str]], count: int, manifest: str):
        super().__init__(f"{count} objects could not be fetched, all with status failed in {manifest}; one: {failures[0]}")
        self.failures, self.count, self.manifest = failures, count, manifest


def hourly_url(base: str, symbol: str) -> F.Column:
    """URL of column `hour`; months count from 0."""
    part = lambda f, text: F.lpad(f.cast("string"), 2, "0") if text else f.cast("string")
    return F.concat(
        F.lit(f"{base.rstrip('/')}/{normalize_symbol(symbol)}/"), part(F.year("hour"), False), F.lit("/"), part(F.month("hour") - 1, True), F.lit("/"),
        part(F.day("hour"), True), F.lit("/"), part(F.hour("hour"), True), F.lit("h_ticks.bi5"),
    )


def weekly_url(base: str, symbol: str, year: int, week: int, period: str = "m1") -> str:
    if not 1 <= week <= 53 or period not in PERIODS:
        raise ValueError("week must be 1 to 53 and period one of " + ", ".join(PERIODS))
    return f"{base.rstrip('/')}/{period}/{normalize_symbol(symbol)}/{year}/{week}.csv.gz"


def hours(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(hour): the hours that [start, end) touches."""
    ends = f"date_trunc('hour', timestamp'{start}') AS lo, date_trunc('hour', timestamp'{end}' - INTERVAL 1 MICROSECOND) AS hi"
    return spark.sql(f"SELECT explode(sequence(lo, hi, INTERVAL 1 HOUR)) AS hour FROM (SELECT {ends})")


def fetch(url: str, attempts: int = 5, backoff: float = 1.0, open_url: Callable = urllib.request.urlopen, wait: Callable = time.sleep) -> tuple[bytes | None, int]:
    """(payload, attempts made); None where the object does not exist. Only passing errors are retried."""
    for n in range(1, attempts + 1):
        try:
            with open_url(url) as r:
                return r.read(), n
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None, n
            if e.code not in RETRY_STATUS or n == attempts:
                raise
        except (urllib.error.URLError, TimeoutError) as e:
            if isinstance(getattr(e, "reason", None), FileNotFoundError):
                return None, n
            if n == attempts:
                raise
        wait(backoff * 2 ** (n - 1))
    raise ValueError("attempts must be >= 1")


def fetch_objects(urls: DataFrame, attempts: int = 5, backoff: float = 1.0, open_url: Callable = urllib.request.urlopen) -> DataFrame:
    """PROVENANCE rows of (url); status is ok, missing or failed. A failure is a row, not a failed task."""
    names = [x.split()[0] for x in PROVENANCE.split(", ")]

    def run(batches):
        for b in batches:
            for url in b.column("url").to_pylist():
                try:
                    payload, n = fetch(url, attempts, backoff, open_url)
                    row = (url, "missing" if payload is None else "ok", n, payload and hashlib.sha256(payload).hexdigest(), None, payload)
                except Exception as e:  # recorded for the manifest
                    row = (url, "failed", attempts, None, f"{type(e).__name__}: {e}", None)
                types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

    return urls.select("url").mapInArrow(run, PROVENANCE)


def acquire(urls: DataFrame, path: str, passes: int = 3, **options) -> DataFrame:
    """Fetch into `path`, failed objects again in later passes; if some remain, nothing is returned."""
    spark = urls.sparkSession
    for n in range(passes):
        fetch_objects(urls, **options).write.parquet(f"{path}/pass{n}")
        done = spark.read.schema(PROVENANCE).parquet(f"{path}/pass{n}")
        urls = done.filter("status = 'failed'").select("url")
        if urls.isEmpty():
            return spark.read.schema(PROVENANCE).parquet(*[f"{path}/pass{i}" for i in range(n + 1)]).filter("status <> 'failed'")
    failed = done.filter("status = 'failed'").select("url", "error")
    raise AcquisitionError([(r["url"], r["error"]) for r in failed.limit(1000).collect()], failed.count(), f"{path}/pass{n}")


def decode_ticks(objects: DataFrame, symbol: str) -> DataFrame:
    """Ticks of (hour, payload) rows: LZMA records with offsets from their hour; empty payloads have none."""
    divisor = price_divisor(symbol)
    names = ["ts", "ask", "bid", "ask_volume", "bid_volume"]

    def run(batches):
        for b in batches:
            for hour_us, payload in zip(b.column("hour_us").to_pylist(), b.column("payload").to_pylist(), strict=True):
                raw = lzma.decompress(payload) if payload else b""
                if len(raw) % TICK_RECORD.itemsize:
                    raise ValueError("tick payload is not a whole number of records")
                r = np.frombuffer(raw, TICK_RECORD)
                ts = pa.array(hour_us + r["ms"].astype(np.int64) * 1000, pa.int64()).cast(pa.timestamp("us", tz="UTC"))
                cells = [r["ask"].astype(float) / divisor, r["bid"].astype(float) / divisor, r["ask_volume"].astype(float), r["bid_volume"].astype(float)]
                yield pa.RecordBatch.from_arrays([ts, *[pa.array(c) for c in cells]], names)

    return objects.select(F.unix_micros("hour").alias("hour_us"), "payload").mapInArrow(run, "ts timestamp, ask double, bid double, ask_volume double, bid_volume double")


def download_candles(spark: SparkSession, base: str, symbol: str, start: str, end: str, path: str, width: str = "1 minute", price: str = "mid", **options) -> DataFrame:
    """Candles of [start, end): hours fetched, decoded and aggregated as one plan, so no bucket splits at an hour."""
    spine = hours(spark, start, end).withColumn("url", hourly_url(base, symbol))
    got = acquire(spine, path, **options)
    ticks = decode_ticks(got.filter("status = 'ok'").join(spine, "url"), symbol).filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return ticks_to_candles(ticks.withColumn("series_id", F.lit(normalize_symbol(symbol))), width, price)


#: The columns of a weekly object, in lower case.
WEEKLY_COLUMNS = ("datetime", *(f"{q}{p}" for q in ("bid", "ask") for p in ("open", "high", "low", "close")), "tickqty")
WEEKS = 53


def decode_weeks(objects: DataFrame) -> DataFrame:
    """Rows of gzipped CSV payloads as text columns; columns are found by name in any case, an unknown one is left out."""

    def run(batches):
        for b in batches:
            for payload in b.column("payload").to_pylist():
                rows = csv.reader(io.StringIO(gzip.decompress(payload).decode("utf-8-sig")))
                names = [n.strip().lower() for n in next(rows, [])]
                cells = list(zip(*(r for r in rows if len(r) == len(names)), strict=True)) or [()] * len(names)
                found = dict(zip(names, cells, strict=True))
                n = len(cells[0]) if cells else 0
                yield pa.RecordBatch.from_arrays([pa.array(found.get(c, [None] * n), pa.string()) for c in WEEKLY_COLUMNS], list(WEEKLY_COLUMNS))

    return objects.select("payload").mapInArrow(run, ", ".join(f"{c} string" for c in WEEKLY_COLUMNS))


def download_year(spark: SparkSession, base: str, symbol: str, year: int, path: str, period: str = "m1", side: str = "mid", **options) -> tuple[DataFrame, list[int]]:
    """(validated candles of a year, the weeks that do not exist).

    All weeks are fetched as one table, with provenance in `path`; a week that could not be fetched fails the year, one
    that is not there is listed. A year without any week fails.
    """
    weeks = spark.createDataFrame([(w, weekly_url(base, symbol, year, w, period)) for w in range(1, WEEKS + 1)], "week int, url string")
    got = acquire(weeks, path, **options).join(weeks, "url")
    missing = sorted(r["week"] for r in got.filter("status = 'missing'").select("week").collect())
    if len(missing) == WEEKS:
        raise ValueError(f"no week of {year} exists for {symbol}")
    return weekly_quotes(decode_weeks(got.filter("status = 'ok'")), side), missing


def read_tick_files(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Ticks of stored hourly objects; the hour is in the file's path, months from 0."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*h_ticks.bi5").load(path)
    part = lambda i: F.regexp_extract("path", r"(\d{4})/(\d{2})/(\d{2})/(\d{2})h_ticks", i).cast("int")
    hour = F.make_timestamp(part(1), part(2) + 1, part(3), part(4), F.lit(0), F.lit(0))
    return decode_ticks(files.select(hour.alias("hour"), F.col("content").alias("payload")), symbol)
