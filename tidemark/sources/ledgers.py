"""Append-only ledgers: a hash chain of records, forward-test events, and the snapshot manifest.

A ledger is a directory of JSON lines with one writer. Record n holds the JSON text of its
payload and the SHA-256 of the previous record's hash, a line end and that text. The chain is
verified by a join of each record with its predecessor, so a long ledger is checked in parallel.

Events are appended as tables: all rows of a batch are checked by named rules, which are column
expressions, in one action; the chain is verified once a batch; and the batch is hashed as a stream, as a
chain of hashes has to be. A batch of which one row breaks a rule adds nothing.
"""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.operators.bars import require_columns
from tidemark.operators.joins import left_one_to_one
from tidemark.operators.validate import fingerprint
from tidemark.session import written
from tidemark.sources.readers import MICROS

GENESIS = "GENESIS"
RECORD = "seq long, payload string, previous_hash string, record_hash string"


def utc(value) -> datetime:
    """A time with a zone, in UTC; text is parsed, times without a zone are refused."""
    at = datetime.fromisoformat(value) if isinstance(value, str) else value
    if at.tzinfo is None:
        raise ValueError("timestamps need a time zone")
    return at.astimezone(UTC)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows; blank lines are skipped, a line that is no record fails."""
    try:
        lines = spark.read.text(path).filter(F.trim("value") != "")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RECORD)
    return lines.select(F.from_json("value", RECORD, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def chain_faults(records: DataFrame) -> DataFrame:
    """Records that do not follow from their predecessor or whose hash is not their own."""
    before = records.select((F.col("seq") + 1).alias("seq"), F.col("record_hash").alias("want"))
    rows = records.join(before, "seq", "left").withColumn("want", F.when(F.col("seq") == 0, GENESIS).otherwise(F.col("want")))
    own = F.sha2(F.concat_ws("\n", "previous_hash", "payload").cast("binary"), 256)
    return rows.filter(F.col("want").isNull() | (F.col("want") != F.col("previous_hash")) | (own != F.col("record_hash")))


def verify(spark: SparkSession, path: str) -> bool:
    return chain_faults(read_ledger(spark, path)).isEmpty()


def json_text(*columns: str) -> Column:
    """The columns as JSON, by name, nulls too: one text for one set of values."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false", "timestampFormat": MICROS})


def append_all(rows: DataFrame, path: str, order: list[str]) -> None:
    """Verify the chain, then add a record for each row, in the given order; the single writer is the caller."""
    spark = rows.sparkSession
    records = read_ledger(spark, path)
    if not chain_faults(records).isEmpty():
        raise ValueError("ledger hash chain is invalid; refusing to append")
    last = records.orderBy(F.desc("seq")).limit(1).collect()
    head, start = (last[0]["record_hash"], last[0]["seq"] + 1) if last else (GENESIS, 0)

    def chain(batches):
        previous, seq = head, start
        for b in batches:
            out = []
            for text in b.column("payload").to_pylist():
                own = hashlib.sha256(f"{previous}\n{text}".encode()).hexdigest()
                out.append((seq, text, previous, own))
                previous, seq = own, seq + 1
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i else pa.int64()) for i, c in enumerate(columns)], ["seq", "payload", "previous_hash", "record_hash"])

    stamped = rows.withColumns({"run_id": F.uuid(), "recorded_at": F.current_timestamp()})
    texts = stamped.select(*order, json_text(*stamped.columns).alias("payload")).repartition(1).sortWithinPartitions(*order)
    texts.select("payload").mapInArrow(chain, RECORD).write.mode("append").json(path)


def append(spark: SparkSession, path: str, payload: dict) -> None:
    """Add one record: a dictionary's JSON under `report`."""
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"), allow_nan=False, default=str)
    append_all(spark.createDataFrame([(text,)], "report string"), path, ["report"])


#: The event columns of the two phases, and the columns that make a candidate's identity.
CANDIDATE = {
    "model_version": "string", "asset": "string", "market_type": "string", "signal_timestamp": "timestamp", "direction": "string", "probability": "double",
    "probability_threshold": "double", "expiry_bars": "int", "entry_offset_bars": "int", "payout": "double", "payout_observed_at": "timestamp", "dataset_fingerprint": "string",
}
OUTCOME = {"candidate_id": "string", "entry_timestamp": "timestamp", "expiry_timestamp": "timestamp", "entry_price": "double", "exit_price": "double", "result": "string", "pnl": "double"}
IDENTITY = ["model_version", "asset", "market_type", "signal_timestamp", "direction", "expiry_bars", "entry_offset_bars", "probability_threshold"]

c = F.col


def candidate_rules() -> dict[str, Column]:
    """What holds for every candidate; `copies` counts the candidates of its identity, old and new."""
    return {
        "side": c("direction").isin("call", "put"),
        "threshold": (c("probability_threshold") > 0.5) & (c("probability_threshold") < 1),
        "probability": c("probability").between(0, 1),
        "horizon": F.least("expiry_bars", "entry_offset_bars") >= 1,
        "conviction": F.when(c("direction") == "call", c("probability")).otherwise(1 - c("probability")) >= c("probability_threshold"),
        "payout": F.coalesce(c("payout"), F.lit(0.0)).between(0, 1),
        "no payout from the future": F.coalesce(c("payout_observed_at"), c("signal_timestamp")) <= c("signal_timestamp"),
        "first of its identity": c("copies") == 1,
    }


def outcome_rules() -> dict[str, Column]:
    """What holds for every outcome, joined with its candidate; `copies` counts the outcomes of its candidate, old and new."""
    return {
        "one candidate": c("candidates") == 1,
        "first outcome": c("copies") == 1,
        "result": c("result").isin("win", "loss", "tie"),
        "entry after signal": c("entry_timestamp") > c("signal_timestamp"),
        "expiry after entry": c("expiry_timestamp") >= c("entry_timestamp"),
        "sign of pnl": F.signum(F.coalesce(c("pnl"), F.lit(0.0))) == F.when(c("pnl").isNull() | (c("result") == "tie"), 0).when(c("result") == "win", 1).otherwise(-1),
    }


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows, if all hold to all rules; a rule that gives null is broken. One action, which names rules and one row of each."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    found = rows.select(F.explode(broken).alias("rule"), json_text(*rows.columns).alias("row")).groupBy("rule").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    if wrong := found.orderBy("rule").collect():  # at most one row a rule
        raise ValueError("; ".join(f"{r['rule']}: {r['n']} events, such as {r['row']}" for r in wrong))
    return rows


def typed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The event's columns, those that may be left out as null; times must be instants, not text or local times."""
    optional = {"payout", "payout_observed_at", "dataset_fingerprint", "pnl"}
    require_columns(rows, [n for n in columns if n not in optional])
    for name, kind in rows.dtypes:
        if columns.get(name) == "timestamp" and kind != "timestamp":
            raise ValueError(f"{name} must be a timestamp, which has a time zone, not {kind}")
    return rows.select(*[(c(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in columns.items()])


def candidate_id(model_version: str, asset: str, market_type: str, signal_timestamp, direction: str, expiry_bars: int, entry_offset_bars: int, probability_threshold: float) -> str:
    """SHA-256 of the identity as JSON, names sorted, no spaces."""
    values = (str(model_version), str(asset), str(market_type), utc(signal_timestamp).isoformat(), direction, int(expiry_bars), int(entry_offset_bars), float(probability_threshold))
    return hashlib.sha256(json.dumps(dict(zip(IDENTITY, values, strict=True)), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _ids(*columns: pd.Series) -> pd.Series:
    times = IDENTITY.index("signal_timestamp")
    rows = (list(r) for r in zip(*columns, strict=True))
    return pd.Series([candidate_id(*r[:times], datetime.fromtimestamp(0, UTC) + pd.Timedelta(r[times], "us").to_pytimedelta(), *r[times + 1 :]) for r in rows])


def with_identity(candidates: DataFrame) -> DataFrame:
    of = F.pandas_udf(_ids, "string")
    return candidates.withColumn("candidate_id", of(*[F.unix_micros(n) if n == "signal_timestamp" else n for n in IDENTITY]))


def events(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Candidates or outcomes so far."""
    fields = {"event_type": "string", "candidate_id": "string"} | (CANDIDATE if kind == "candidate" else OUTCOME)
    rows = read_ledger(spark, path).select(F.from_json("payload", ", ".join(f"{n} {t}" for n, t in fields.items())).alias("e")).select("e.*")
    return rows.filter(c("event_type") == kind).drop("event_type")


def append_candidates(rows: DataFrame, path: str) -> None:
    """Decisions before their outcomes are known; they are never edited, and there is one of each identity."""
    made = with_identity(typed(rows.withColumn("entry_offset_bars", F.lit(1)) if "entry_offset_bars" not in rows.columns else rows, CANDIDATE))
    before = events(rows.sparkSession, path, "candidate").select("candidate_id")
    copies = before.unionByName(made.select("candidate_id")).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("copies"))
    checked(made.join(copies, "candidate_id"), candidate_rules())
    append_all(made.withColumns({"event_type": F.lit("candidate"), "outcome_known_at_append": F.lit(False)}), path, ["signal_timestamp", "candidate_id"])


def append_outcomes(rows: DataFrame, path: str) -> None:
    """The one settlement of each of some earlier candidates."""
    made = typed(rows, OUTCOME)
    spark = rows.sparkSession
    known = events(spark, path, "candidate").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("candidates"), F.min("signal_timestamp").alias("signal_timestamp"))
    copies = events(spark, path, "outcome").select("candidate_id").unionByName(made.select("candidate_id")).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("copies"))
    checked(made.join(known, "candidate_id", "left").join(copies, "candidate_id"), outcome_rules())
    append_all(made.withColumn("event_type", F.lit("outcome")), path, ["entry_timestamp", "candidate_id"])


def append_settled(rows: DataFrame, path: str) -> None:
    """Outcomes that a stream gave: what it could not settle stays open, and a batch that comes again adds nothing."""
    known = events(rows.sparkSession, path, "outcome").select("candidate_id")
    fresh = rows.filter(c("result").isin("win", "loss", "tie")).join(known, "candidate_id", "left_anti")
    append_outcomes(written(fresh, "settled"), path)


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def forward_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Candidates with their outcome, if any, under outcome_*; `settled` tells."""
    return left_one_to_one(events(spark, path, "candidate"), events(spark, path, "outcome"), "candidate_id", "outcome_", "settled")


def manifest_entry(frame: DataFrame, asset: str, period_seconds: int, observed_at, account_mode: str, relative_path: str) -> dict:
    """Identity and extent of a stored snapshot."""
    _need(period_seconds >= 1, "period_seconds must be positive")
    _need(account_mode in ("demo", "live"), "account_mode must be demo or live")
    mark = fingerprint(frame).first()
    ends = frame.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    observed = utc(observed_at).isoformat()
    key = "|".join([asset, str(period_seconds), observed, account_mode, mark["fingerprint"], relative_path])
    return {
        "snapshot_id": hashlib.sha256(key.encode()).hexdigest(), "asset": asset, "period_seconds": period_seconds, "observed_at": observed, "account_mode": account_mode,
        "relative_path": relative_path, "rows": mark["row_count"], "candle_fingerprint": mark["fingerprint"], "start": ends["lo"] and str(ends["lo"]), "end": ends["hi"] and str(ends["hi"]),
    }


def append_manifest(spark: SparkSession, path: str, entry: dict) -> None:
    """Add an entry; a snapshot that is there already is refused."""
    try:
        known = spark.read.json(path).filter(F.col("snapshot_id") == entry["snapshot_id"])
        _need(known.isEmpty(), f"snapshot {entry['snapshot_id']} already exists")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    spark.createDataFrame([(json.dumps(entry, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)
