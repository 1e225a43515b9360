"""Hourly tick objects as a Spark data source, for batch and stream.

    register(spark)
    spark.read.format("tick_objects").option("base", url).option("symbol", "EURUSD").option("start", "2024-01-01").option("end", "2024-02-01").load()

One partition an object (or `objects_per_partition`). Comparisons of `ts` or `hour` with constants reach the list of objects, so
hours outside are never asked for. An object that does not exist has no rows; one that cannot be had after `attempts`
fails its task, and after the task's own retries the job: no hour is left out in silence. With option rows=provenance
the rows are the objects themselves: status, bytes, SHA-256 and number of ticks.

As a stream the offset is the next hour to read. A batch takes the hours that are over (by `delay_seconds`, 60 unless given) and
before `end`, if given; a restarted query goes on after the last hour of its checkpoint.
"""

from __future__ import annotations

import hashlib
import lzma
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from tidemark.operators.bars import normalize_symbol, price_divisor
from tidemark.sources.objects import TICK_RECORD, fetch

HOUR_US = 3_600_000_000
TICKS = "ts timestamp, ask double, bid double, ask_volume double, bid_volume double, hour timestamp"
PROVENANCE = "hour timestamp, url string, status string, bytes long, sha256 string, ticks long"
UTC_US = pa.timestamp("us", tz="UTC")


def micros_of(value) -> int:
    """Of a time; one without a zone is UTC."""
    at = value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    whole = at.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)
    return (whole.days * 86_400 + whole.seconds) * 1_000_000 + whole.microseconds


def object_url(base: str, symbol: str, hour_us: int) -> str:
    """URL of an hour's object; months count from 0."""
    at = datetime.fromtimestamp(hour_us // 1_000_000, UTC)
    return f"{base.rstrip('/')}/{symbol}/{at.year}/{at.month - 1:02}/{at.day:02}/{at.hour:02}h_ticks.bi5"


@dataclass
class Hours(InputPartition):
    first_us: int
    count: int


class _Objects:
    """What the batch and the stream reader share: options, partitions and reading them."""

    def __init__(self, options: dict[str, str]):
        self.base, self.symbol = options["base"], normalize_symbol(options["symbol"])
        self.attempts, self.backoff = int(options.get("attempts", 5)), float(options.get("backoff", 1.0))
        self.per_partition = int(options.get("objects_per_partition", 1))
        self.provenance = options.get("rows", "ticks") == "provenance"
        self.low_us = micros_of(options["start"])
        self.high_us = micros_of(options["end"]) if "end" in options else None
        self.delay_us = int(float(options.get("delay_seconds", 60)) * 1_000_000)
        if self.high_us is not None and self.high_us <= self.low_us:
            raise ValueError("end must be after start")

    def split(self, low_us: int, high_us: int) -> list[Hours]:
        """The hours that [low, high) touches."""
        first, last = low_us // HOUR_US, -(-high_us // HOUR_US)
        return [Hours(h * HOUR_US, min(self.per_partition, last - h)) for h in range(first, last, self.per_partition)]

    def rows(self, partition: Hours | None) -> Iterator[pa.RecordBatch]:
        """Spark gives None for a list of partitions that is empty."""
        if partition is None:
            return
        divisor = price_divisor(self.symbol)
        for hour_us in range(partition.first_us, partition.first_us + partition.count * HOUR_US, HOUR_US):
            url = object_url(self.base, self.symbol, hour_us)
            payload, _ = fetch(url, self.attempts, self.backoff)
            raw = lzma.decompress(payload) if payload else b""
            if len(raw) % TICK_RECORD.itemsize:
                raise ValueError(f"{url} is not a whole number of records")
            r = np.frombuffer(raw, TICK_RECORD)
            if self.provenance:
                row = [hour_us, url, "missing" if payload is None else "ok", len(payload or b""), None if payload is None else hashlib.sha256(payload).hexdigest(), len(r)]
                kinds = [UTC_US, pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [f.split()[0] for f in PROVENANCE.split(", ")])
                continue
            us = hour_us + r["ms"].astype(np.int64) * 1000
            keep = us >= self.low_us if self.high_us is None else (us >= self.low_us) & (us < self.high_us)
            r, us = r[keep], us[keep]
            cells = [r["ask"].astype(float) / divisor, r["bid"].astype(float) / divisor, r["ask_volume"].astype(float), r["bid_volume"].astype(float)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(us).cast(UTC_US), *map(pa.array, cells), pa.array(np.full(len(us), hour_us)).cast(UTC_US)], [f.split()[0] for f in TICKS.split(", ")])


class TickReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.objects = _Objects(options)
        if self.objects.high_us is None:
            raise ValueError("a batch read needs end")
        self.low, self.high = self.objects.low_us, self.objects.high_us

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of time narrow the list of objects; Spark still applies all filters to the rows."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("ts",), ("hour",)) and isinstance(f.value, datetime):
                at = micros_of(f.value)
                width = HOUR_US if f.attribute == ("hour",) else 1
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, at)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.high = min(self.high, at + width)
                if isinstance(f, LessThan):
                    self.high = min(self.high, at)
            yield f

    def partitions(self) -> list[Hours]:
        return self.objects.split(self.low, self.high) if self.low < self.high else []

    def read(self, partition: Hours) -> Iterator[pa.RecordBatch]:
        return self.objects.rows(partition)


class TickStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.objects = _Objects(options)

    def initialOffset(self) -> dict:
        return {"hour_us": self.objects.low_us // HOUR_US * HOUR_US}

    def latestOffset(self) -> dict:
        over = (micros_of(datetime.now(UTC)) - self.objects.delay_us) // HOUR_US * HOUR_US
        end = over if self.objects.high_us is None else min(over, -(-self.objects.high_us // HOUR_US) * HOUR_US)
        return {"hour_us": max(end, self.initialOffset()["hour_us"])}

    def partitions(self, start: dict, end: dict) -> list[Hours]:
        return self.objects.split(start["hour_us"], end["hour_us"]) if start["hour_us"] < end["hour_us"] else []

    def read(self, partition: Hours) -> Iterator[pa.RecordBatch]:
        return self.objects.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class TickObjects(DataSource):
    """Options: base, symbol, start, end, rows (ticks or provenance), attempts, backoff, objects_per_partition, delay_seconds."""

    @classmethod
    def name(cls) -> str:
        return "tick_objects"

    def schema(self) -> str:
        return PROVENANCE if self.options.get("rows", "ticks") == "provenance" else TICKS

    def reader(self, schema: StructType) -> TickReader:
        return TickReader(dict(self.options.items()))

    def streamReader(self, schema: StructType) -> TickStream:
        return TickStream(dict(self.options.items()))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TickObjects)
