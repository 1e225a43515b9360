"""Queries of readers, writers, ledgers and streams: what was written is read back, and compared with SQL."""

from __future__ import annotations

import lzma
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import joins
from tidemark.queries import MOMENTUM, bars, bars_sql, momentum, query, r, rounded, trades_sql
from tidemark.operators.bars import ticks_to_candles
from tidemark.operators.settle import settle
from tidemark.schemas import PRICES
from tidemark.session import shared_folder, written
from tidemark.sources import ledgers, objects, readers, synthetic, tick_source
from tidemark.streaming import jobs, settlement

BACK_SQL = f"WITH {bars_sql()} SELECT ts, {r(*PRICES, 'volume')} FROM b"


def local(df):
    """Times without a zone, as the tables have them."""
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


for _kind in ("csv", "parquet"):
    @query(f"dataset_round_trip_{_kind}", BACK_SQL)
    def _round_trip(spark, sf, kind=_kind):
        path = f"{shared_folder(spark, 'dataset')}/bars.{kind}"
        readers.write_frame(local(bars(spark, sf)).select("ts", *PRICES, "volume"), path)
        return rounded(local(readers.load_dataset(spark, path).withColumn("volume", F.col("volume").cast("double"))).select("ts", *PRICES, "volume"))


@query("public_csv_round_trip", BACK_SQL)
def public_csv_round_trip(spark, sf):
    path = f"{shared_folder(spark, 'public')}/bars.csv"
    made = bars(spark, sf).select(F.col("ts").alias("datetime"), *PRICES, F.col("volume").alias("tick_volume"), F.lit("x").alias("note"))
    readers.write_frame(made, path)
    return rounded(local(readers.read_public_csv(spark, path, {"tick_volume": "volume"}, "datetime")).select("ts", *PRICES, "volume"))


@query("weekly_quotes_round_trip", f"""WITH {bars_sql()}, q AS (SELECT ts, 'mid' AS side, 0.0::DOUBLE AS d, * EXCLUDE (ts) FROM b UNION ALL SELECT ts, 'bid', -0.25, * EXCLUDE (ts) FROM b UNION ALL SELECT ts, 'ask', 0.25, * EXCLUDE (ts) FROM b)
SELECT ts, side, {', '.join(f'round({c} + d, 6) + 0.0 AS {c}' for c in PRICES)}, round(volume, 6) AS volume, 0.5::DOUBLE AS spread_mean_proxy FROM q""")
def weekly_quotes_round_trip(spark, sf):
    path = f"{shared_folder(spark, 'weekly')}/w.csv"
    quotes = [(F.col(p) + d).alias(f"{q}{p.title()}") for q, d in (("Bid", -0.25), ("Ask", 0.25)) for p in PRICES]
    readers.write_frame(bars(spark, sf).select(F.col("ts").alias("DateTime"), *quotes, F.col("volume").alias("TickQty")), path)
    columns = ["ts", "side", *PRICES, "volume", "spread_mean_proxy"]
    mid, bid, ask = (local(readers.read_weekly_quotes(spark, path, s)).withColumn("side", F.lit(s)).select(*columns) for s in ("mid", "bid", "ask"))
    return rounded(mid.unionByName(bid).unionByName(ask))


@query("candle_payloads_parsed", f"WITH {bars_sql(60, 'event_type')} SELECT series_id AS asset, 'regular' AS market_type, ts, {r(*PRICES)}, 0.92::DOUBLE AS payout FROM b")
def candle_payloads_parsed(spark, sf):
    """Half of the assets' payloads hold arrays, half objects; times are seconds or milliseconds."""
    b = bars(spark, sf, 60, True).withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))
    odd = F.length("series_id") % 2 == 1
    item = F.when(odd, F.to_json(F.array(F.col("t").cast("double"), "open", "close", "high", "low"))).otherwise(F.to_json(F.struct((F.col("t") * 1000).alias("time"), *PRICES)))
    text = F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]"))
    sent = b.groupBy(F.col("series_id").alias("asset"), F.to_date("ts").alias("day")).agg(text.alias("list"))
    body = F.when(F.dayofmonth("day") % 2 == 0, F.concat(F.lit('{"candles":'), F.col("list"), F.lit("}"))).otherwise(F.col("list"))
    got = readers.parse_candle_payloads(sent.select(body.alias("payload"), "asset", F.lit(60).alias("period_seconds"), F.lit(92.0).alias("payout")))
    return rounded(local(got).select("asset", "market_type", "ts", *PRICES, "payout"))


@query("payout_lines_round_trip", """SELECT 'A' || (user_id % 3) AS asset, ts AS observed_at, round(json_extract_string(props, '$.k')::DOUBLE / 100, 6) AS payout
FROM events WHERE event_type = 'purchase' AND json_extract_string(props, '$.k')::DOUBLE BETWEEN 0 AND 100""")
def payout_lines_round_trip(spark, sf):
    from tidemark.queries import observations

    path = f"{shared_folder(spark, 'payouts')}/lines"
    rows = observations(spark, sf).filter("payout BETWEEN 0 AND 1").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    for part in (rows.filter("asset = 'A0'"), rows.filter("asset <> 'A0'")):
        readers.append_payouts(part, path)
    return rounded(readers.read_payouts(spark, path).select("asset", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), "payout"))


@query("snapshot_manifest", f"WITH {bars_sql(60, 'event_type')} SELECT series_id AS asset, 60::BIGINT AS period_seconds, 'demo' AS account_mode, count(*) AS \"rows\", 64::BIGINT AS fingerprint_length FROM b WHERE series_id IN ('click', 'view') GROUP BY series_id")
def snapshot_manifest(spark, sf):
    path, b = f"{shared_folder(spark, 'manifest')}/entries", bars(spark, sf, 60, True)
    for asset in ("click", "view"):
        entry = ledgers.manifest_entry(b.filter(F.col("series_id") == asset).select("ts", *PRICES), asset, 60, "2024-02-01T00:00:00+00:00", "demo", f"{asset}.parquet")
        ledgers.append_manifest(spark, path, entry)
    both = readers.read_manifest(spark, path, "click", 60).unionByName(readers.read_manifest(spark, path, "view", 60))
    return both.select("asset", "period_seconds", "account_mode", "rows", F.length("candle_fingerprint").cast("long").alias("fingerprint_length"))


@query("registry_chain", "SELECT row_number() OVER (ORDER BY n_regionkey >= 3, n_nationkey) - 1 AS seq, n_name AS name, 1 AS valid FROM nation")
def registry_chain(spark, sf):
    """Two batches of records: all are there in order, and the chain holds."""
    path = f"{shared_folder(spark, 'registry')}/records"
    nation = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    for batch in (nation.filter("n_regionkey < 3"), nation.filter("n_regionkey >= 3")):
        ledgers.append_all(batch, path, ["n_nationkey"])
    valid = int(ledgers.verify(spark, path))
    return ledgers.read_ledger(spark, path).select("seq", F.get_json_object("payload", "$.n_name").alias("name"), F.lit(valid).alias("valid"))


@query("forward_ledger", f"""WITH {trades_sql()} SELECT signal_ts, CASE WHEN direction = 1 THEN 'call' ELSE 'put' END AS direction, (bar_idx % 3 > 0)::INT AS settled,
  CASE WHEN bar_idx % 3 > 0 THEN result END AS result, CASE WHEN bar_idx % 3 > 0 THEN round(pnl, 6) END AS pnl FROM tr""")
def forward_ledger(spark, sf):
    """Every trade as a candidate, two of three settled later."""
    path = f"{shared_folder(spark, 'forward')}/events"
    t = settle(momentum(bars(spark, sf))).withColumns({c: F.col(c).cast("timestamp") for c in ("signal_ts", "entry_ts", "exit_ts")})
    up = F.col("direction") == 1
    made = t.select(
        F.lit("momentum-1").alias("model_version"), F.lit("ALL").alias("asset"), F.lit("regular").alias("market_type"), F.col("signal_ts").alias("signal_timestamp"),
        F.when(up, "call").otherwise("put").alias("direction"), F.when(up, 0.7).otherwise(0.3).alias("probability"), F.lit(0.625).alias("probability_threshold"), F.lit(3).alias("expiry_bars"), "payout")
    ledgers.append_candidates(made, path)
    known = ledgers.events(spark, path, "candidate").select("candidate_id", F.col("signal_timestamp").alias("signal_ts"))
    done = t.filter("(entry_idx - 1) % 3 > 0").join(known, "signal_ts")
    ledgers.append_outcomes(done.select("candidate_id", F.col("entry_ts").alias("entry_timestamp"), F.col("exit_ts").alias("expiry_timestamp"), "entry_price", "exit_price", "result", "pnl"), path)
    got = ledgers.forward_ledger(spark, path)
    return rounded(got.select(F.col("signal_timestamp").cast("timestamp_ntz").alias("signal_ts"), "direction", "settled", F.col("outcome_result").alias("result"), F.col("outcome_pnl").alias("pnl")))


@query("one_to_one_join", "SELECT c_custkey, c_nationkey, n_name AS nation_n_name, (n_name IS NOT NULL)::INT AS known FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 > 0) n ON n_nationkey = c_nationkey")
def one_to_one_join(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet").filter("n_nationkey % 4 > 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return rounded(joins.left_one_to_one(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey"), nation, "c_nationkey", "nation_", "known"))


@query("new_keys_only", "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 > 0)")
def new_keys_only(spark, sf):
    """Customers that a registry of keys lacks; it was built from the orders of two of three."""
    known = spark.read.parquet(f"{sf}/orders.parquet").filter("o_custkey % 3 > 0").select(F.col("o_custkey").alias("key"))
    return joins.new_only(spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("key")), known, "key")


def _hours(spark, sf):
    """The hours that the events span."""
    ends = spark.read.parquet(f"{sf}/events.parquet").agg(F.min("ts").cast("string").alias("lo"), (F.max("ts") + F.expr("INTERVAL 1 MICROSECOND")).cast("string").alias("hi")).first()
    return objects.hours(spark, ends["lo"], ends["hi"])


SPINE_SQL = "SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS hour FROM events"


@query("hour_spine", f"SELECT hour, count(ts) AS ticks FROM ({SPINE_SQL}) LEFT JOIN events ON date_trunc('hour', ts) = hour GROUP BY hour")
def hour_spine(spark, sf):
    """Every hour of the events' span, with the ticks it has."""
    found = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.count(F.lit(1)).alias("ticks"))
    return _hours(spark, sf).join(found, "hour", "left").select(F.col("hour").cast("timestamp_ntz").alias("hour"), F.coalesce("ticks", F.lit(0)).alias("ticks"))


@query("object_urls", f"""SELECT strftime(hour, 'http://x/EURUSD/%Y/') || lpad((month(hour) - 1)::VARCHAR, 2, '0') || strftime(hour, '/%d/%Hh_ticks.bi5') AS url FROM ({SPINE_SQL})
UNION ALL SELECT 'http://x/m1/EURUSD/' || y || '/' || w || '.csv.gz' FROM (SELECT DISTINCT year(ts) AS y FROM events), range(1, 54) t(w)""")
def object_urls(spark, sf):
    """The objects that the events' span asks for: by hour, and by week of each year."""
    years = [r["y"] for r in spark.read.parquet(f"{sf}/events.parquet").select(F.year("ts").alias("y")).distinct().collect()]
    weekly = spark.createDataFrame([(objects.weekly_url("http://x", "EUR_USD", y, w),) for y in years for w in range(1, 54)], "url string")
    return _hours(spark, sf).select(objects.hourly_url("http://x/", "eur/usd").alias("url")).unionByName(weekly)


def _packed(spark, sf):
    """(hour, payload): the ticks of events by hour as compressed binary records."""
    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ms")
        record = np.zeros(len(rows), objects.TICK_RECORD)
        record["ms"], record["ask"], record["bid"], record["ask_volume"] = rows["ms"], rows["p"] + 2, rows["p"], 1.0
        return pd.DataFrame({"hour_us": [key[0]], "payload": [lzma.compress(record.tobytes(), lzma.FORMAT_ALONE)]})

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    hour = us - us % 3_600_000_000
    ticks = spark.read.parquet(f"{sf}/events.parquet").select(hour.alias("hour_us"), ((us - hour) / 1000).cast("long").alias("ms"), F.round(F.col("value") * 1000).cast("long").alias("p"))
    return ticks.groupBy("hour_us").applyInPandas(pack, "hour_us long, payload binary").select(F.timestamp_micros("hour_us").alias("hour"), "payload")


def _hourly_store(spark, sf) -> str:
    """A file URL below which the events lie as hourly objects; tasks write them to the shared folder."""
    root = shared_folder(spark, "objects")
    if not root.startswith(("/", "file:")):
        raise ValueError("objects can be stored by tasks in a shared file system only")
    path = "/" + root.removeprefix("file:").lstrip("/")

    def store(batches):
        for b in batches:
            for hour_us, payload in zip(b.column("us").to_pylist(), b.column("payload").to_pylist(), strict=True):
                target = tick_source.object_url(path, "USDJPY", hour_us)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.{os.getpid()}", "wb") as f:
                    f.write(payload)
                os.replace(f.name, target)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    _packed(spark, sf).select(F.unix_micros("hour").alias("us"), "payload").mapInArrow(store, "n long").agg(F.sum("n")).collect()
    return f"file://{path}"


def _source(reader, base: str, **options):
    return reader.format("tick_objects").options(base=base, symbol="usd/jpy", start="2024-01-01", end="2024-02-01", attempts=1, objects_per_partition=24, **options).load()


DECODED_SQL = """WITH t AS (SELECT date_trunc('hour', ts) AS ts, round(value * 1000) AS p FROM events {where})
SELECT ts, count(*) AS n, round(max(p + 1) / 1000, 6) + 0.0 AS high, round(min(p + 1) / 1000, 6) + 0.0 AS low FROM t GROUP BY ts"""


@query("tick_objects_decoded", DECODED_SQL.format(where=""))
def tick_objects_decoded(spark, sf):
    """Ticks packed by hour into compressed binary records, then decoded and aggregated."""
    candles = ticks_to_candles(objects.decode_ticks(_packed(spark, sf), "USDJPY").withColumn("series_id", F.lit("X")), "1 hour")
    return rounded(local(candles).select("ts", F.col("volume").cast("long").alias("n"), "high", "low"))


@query("tick_source_filtered", DECODED_SQL.format(where="WHERE date_trunc('millisecond', ts) >= TIMESTAMP '2024-01-10 06:30:00' AND ts < TIMESTAMP '2024-01-20'"))
def tick_source_filtered(spark, sf):
    """A stretch of the hourly objects read through the data source; bounds of time choose the objects."""
    tick_source.register(spark)
    ticks = _source(spark.read, _hourly_store(spark, sf)).filter("ts >= '2024-01-10 06:30:00' AND ts < '2024-01-20'")
    candles = ticks_to_candles(ticks.withColumn("series_id", F.lit("X")), "1 hour")
    return rounded(local(candles).select("ts", F.col("volume").cast("long").alias("n"), "high", "low"))


@query("tick_source_streamed", DECODED_SQL.format(where="").replace("GROUP BY ts", "GROUP BY ts HAVING ts + INTERVAL 2 HOUR <= (SELECT max(date_trunc('millisecond', ts)) FROM events)"))
def tick_source_streamed(spark, sf):
    """The same objects as a stream, half in one run and the rest in another, through watermarked candles."""
    tick_source.register(spark)
    base, root = _hourly_store(spark, sf), shared_folder(spark, "stream")
    for end in ("2024-01-16", "2024-02-01"):
        ticks = spark.readStream.format("tick_objects").options(base=base, symbol="usd/jpy", start="2024-01-01", end=end, attempts=1, objects_per_partition=24).load()
        candles = jobs.stream_candles(ticks.drop("hour").withColumn("series_id", F.lit("X")), "1 hour", "60 minutes")
        jobs.catch_up(candles, f"{root}/out", f"{root}/checkpoint")
    return rounded(local(spark.read.parquet(f"{root}/out")).select("ts", F.col("volume").cast("long").alias("n"), "high", "low"))


@query("tick_source_provenance", """WITH h AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31 23:00:00', INTERVAL 1 HOUR)) AS hour), e AS (
  SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1
) SELECT hour, CASE WHEN n IS NULL THEN 'missing' ELSE 'ok' END AS status, coalesce(n, 0) AS ticks, strftime(hour, '/USDJPY/2024/00/%d/%Hh_ticks.bi5') AS object, (n IS NOT NULL)::INT AS has_digest FROM h LEFT JOIN e USING (hour)""")
def tick_source_provenance(spark, sf):
    """Every hour's object: there or missing, its ticks, and whether its digest is known."""
    tick_source.register(spark)
    base = _hourly_store(spark, sf)
    rows = _source(spark.read, base, rows="provenance")
    return rounded(rows.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "status", "ticks", F.substring("url", len(base) + 1, 100).alias("object"), F.col("sha256").isNotNull().alias("has_digest")))


U = lambda name, col: f"((('0x' || substr(md5('42|{name}|' || {col}::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


@query("synthetic_ohlc", f"""WITH n AS (SELECT unnest(range((SELECT count(*) // 5 FROM events))) AS id), s AS (SELECT id, CAST(floor({U('r', '(id // 500)')} * 3) AS INT) - 1 AS sg,
  sqrt(-2 * ln({U('a', 'id')})) * cos(2 * pi() * {U('b', 'id')}) AS z FROM n), k AS (SELECT id, sg * 1.5e-5::DOUBLE + z * 1.8e-4::DOUBLE AS step FROM s
), c AS (SELECT *, 1.1::DOUBLE + sum(step) OVER (ORDER BY id) AS close FROM k), o AS (SELECT *, close - step AS open FROM c)
SELECT TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * id AS ts, {r('open', 'close')}, round(greatest(open, close) + {U('h', 'id')} * 1.8e-4, 6) AS high, round(least(open, close) - {U('l', 'id')} * 1.8e-4, 6) AS low,
  list_extract([0.7, 0.75, 0.8, 0.82, 0.85, 0.9, 0.92], CAST(floor({U('p', 'id')} * 7) AS INT) + 1)::DOUBLE AS payout FROM o""")
def synthetic_ohlc(spark, sf):
    """As many candles as a fifth of the events."""
    return rounded(synthetic.synthetic_ohlc(spark, spark.read.parquet(f"{sf}/events.parquet").count() // 5).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


# --- streams -----------------------------------------------------------------------------------------------------------------------------------------------


@query("streamed_candles", f"WITH {bars_sql()} SELECT ts, {r(*PRICES)} FROM b WHERE ts + INTERVAL '65 minutes' <= (SELECT max(ts) FROM events)")
def streamed_candles(spark, sf):
    """The tick stream drained through a watermarked aggregation: hours that the watermark has closed."""
    root = shared_folder(spark, "stream")
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    t = stream.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("value") + 0.01).alias("ask"), (F.col("value") - 0.01).alias("bid"), F.lit(1.0).alias("ask_volume"), F.lit(1.0).alias("bid_volume"), F.lit("ALL").alias("series_id"))
    jobs.drain(jobs.stream_candles(t, "60 minutes"), f"{root}/out", f"{root}/checkpoint")
    return rounded(spark.read.parquet(f"{root}/out").select(F.col("ts").cast("timestamp_ntz").alias("ts"), *PRICES))


def _snapshot_stream(spark, sf, root: str):
    """Two overlapping snapshots as files of a stream; every fiftieth candle of the second differs."""
    b = bars(spark, sf).select("series_id", F.col("ts").cast("timestamp").alias("ts"), "bar_idx", *PRICES)
    late = b.filter("bar_idx >= 300").withColumn("high", F.col("high") + F.when(F.col("bar_idx") % 50 == 0, 1.0).otherwise(0.0))
    both = b.filter("bar_idx < 400").unionByName(late).drop("bar_idx")
    both.write.parquet(f"{root}/in")
    return spark.readStream.schema(both.schema).parquet(f"{root}/in")


@query("streamed_snapshots", f"""WITH {bars_sql()}, u AS (SELECT ts, high FROM b WHERE bar_idx < 400 UNION ALL SELECT ts, high + CASE WHEN bar_idx % 50 = 0 THEN 1 ELSE 0 END FROM b WHERE bar_idx >= 300)
SELECT ts, round(min(high), 6) + 0.0 AS high, (max(high) <> min(high))::INT AS conflict, count(*) AS copies FROM u GROUP BY ts HAVING ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM b)""")
def streamed_snapshots(spark, sf):
    root = shared_folder(spark, "stream")
    jobs.drain(jobs.stream_snapshots(_snapshot_stream(spark, sf, root)), f"{root}/out", f"{root}/checkpoint")
    return rounded(local(spark.read.parquet(f"{root}/out")).select("ts", "high", "conflict", "copies"))


@query("streamed_first_seen", f"WITH {bars_sql()} SELECT series_id, ts FROM b")
def streamed_first_seen(spark, sf):
    root = shared_folder(spark, "stream")
    jobs.drain(jobs.first_seen(_snapshot_stream(spark, sf, root)), f"{root}/out", f"{root}/checkpoint")
    return local(spark.read.parquet(f"{root}/out")).select("series_id", "ts")


def _all_signals(spark, sf):
    """The five-minute momentum signals as candidates, whether or not their candles will come."""
    b = momentum(bars(spark, sf, 5)).filter("signal <> 0")
    return b.select(F.concat(F.lit("c"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string")).alias("candidate_id"), F.lit("ALL").alias("asset"), F.col("ts").cast("timestamp").alias("signal_timestamp"),
                    F.when(F.col("signal") > 0, "call").otherwise("put").alias("direction"), F.lit(3).alias("expiry_bars"), F.lit(1).alias("entry_offset_bars"), F.lit(0.82).alias("payout"))


@query("streamed_settlement", f"""WITH {bars_sql(5)}, s AS (SELECT ts, {MOMENTUM} AS d FROM b), o AS (
  SELECT s.ts, d, x.open AS en, z.close AS ex, x.ts IS NOT NULL AND y.ts IS NOT NULL AND z.ts IS NOT NULL AS whole, (SELECT max(ts) + INTERVAL 5 MINUTE FROM b) - INTERVAL 10 MINUTE AS mark FROM s
  LEFT JOIN b x ON x.ts = s.ts + INTERVAL 5 MINUTE LEFT JOIN b y ON y.ts = s.ts + INTERVAL 10 MINUTE LEFT JOIN b z ON z.ts = s.ts + INTERVAL 15 MINUTE WHERE d <> 0
)
SELECT ts AS signal_ts, CASE WHEN whole AND (ex - en) * d > 0 THEN 'win' WHEN whole AND (ex - en) * d < 0 THEN 'loss' WHEN whole THEN 'tie' ELSE 'missing' END AS result,
  CASE WHEN whole THEN CASE WHEN (ex - en) * d > 0 THEN 0.82::DOUBLE WHEN (ex - en) * d < 0 THEN -1.0 ELSE 0.0 END END AS pnl FROM o WHERE whole OR ts + INTERVAL 20 MINUTE <= mark""")
def streamed_settlement(spark, sf):
    """Every signal waits for its three candles in keyed state; the query is stopped halfway and goes on from its checkpoint."""
    root = shared_folder(spark, "settlement")
    made = written(_all_signals(spark, sf), "candidates")
    candles = written(bars(spark, sf, 5).select(F.lit("ALL").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), "open", "close"), "candles")
    half = candles.agg(F.timestamp_micros(F.expr("percentile_approx(unix_micros(ts), 0.5)")).alias("half"))
    stream = lambda name, like: spark.readStream.schema(like.schema).parquet(f"{root}/{name}")
    for part in ("first", "second"):
        for rows, at, name in ((made, "signal_timestamp", "candidates"), (candles, "ts", "candles")):
            cut = rows.join(F.broadcast(half)).filter((F.col(at) < F.col("half")) == (part == "first")).drop("half")
            cut.coalesce(1).write.mode("append").parquet(f"{root}/{name}")
        with settlement.keyed_state(spark):
            outcomes = settlement.settle_stream(stream("candidates", made), stream("candles", candles), 300, "10 minutes", horizon_bars=12, block_bars=48)
            jobs.drain(outcomes, f"{root}/out", f"{root}/checkpoint")
    got = spark.read.parquet(f"{root}/out").join(made.select("candidate_id", "signal_timestamp"), "candidate_id")
    return rounded(got.select(F.col("signal_timestamp").cast("timestamp_ntz").alias("signal_ts"), "result", "pnl"))
