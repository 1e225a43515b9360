import datetime as dt
import gzip
import json
import lzma
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import consolidate, joins, resample
from tidemark.operators.bars import ticks_to_candles
from tidemark.plans import models
from tidemark.sources import ledgers, objects, readers, synthetic

T = "2024-01-01 00:0"


def test_ticks_to_candles(spark):
    rows = [(T + "0:00", 1.1002, 1.1000, 1.0, 2.0), (T + "0:30", 1.1004, 1.1002, 1.0, 2.0), (T + "1:00", 1.2, 1.1998, 5.0, 5.0)]
    t = spark.createDataFrame(rows, "ts string, ask double, bid double, ask_volume double, bid_volume double").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("series_id", F.lit("X"))
    got = ticks_to_candles(t).orderBy("ts").collect()
    assert len(got) == 2
    assert (got[0]["open"], got[0]["high"], got[0]["close"], got[0]["volume"], got[0]["spread_mean"]) == pytest.approx((1.1001, 1.1003, 1.1003, 6.0, 0.0002))
    assert ticks_to_candles(t, price="bid").orderBy("ts").first()["open"] == 1.1000


def payload(*ticks):
    return lzma.compress(np.array(list(ticks), objects.TICK_RECORD).tobytes(), lzma.FORMAT_ALONE)


def test_hourly_objects(spark, tmp_path):
    base = tmp_path / "EURUSD/2024/00/02"
    base.mkdir(parents=True)
    (base / "13h_ticks.bi5").write_bytes(payload((500, 110025, 110015, 1.5, 2.5), (61_000, 110030, 110020, 1.0, 1.0)))
    (base / "14h_ticks.bi5").write_bytes(b"")
    root = f"file://{tmp_path}"
    got = objects.read_tick_files(spark, root, "eur/usd").orderBy("ts").collect()
    assert (got[0]["ask"], str(got[0]["ts"])) == (1.10025, "2024-01-02 13:00:00.500000")
    out = objects.download_candles(spark, root, "EURUSD", "2024-01-02 13:00:00", "2024-01-02 16:00:00", str(tmp_path / "got"), backoff=0.0)
    assert [str(r["ts"]) for r in out.orderBy("ts").collect()] == ["2024-01-02 13:00:00", "2024-01-02 13:01:00"]
    (base / "15h_ticks.bi5").write_bytes(lzma.compress(b"123", lzma.FORMAT_ALONE))
    with pytest.raises(Exception, match="whole number"):
        objects.read_tick_files(spark, root, "EURUSD").collect()


def test_fetch_retries_only_passing_errors():
    waits, answers = [], []

    def opener(url):
        x = answers.pop(0)
        if isinstance(x, int):
            raise urllib.error.HTTPError(url, x, "", None, None)
        if isinstance(x, Exception):
            raise x

        class R:
            def __enter__(self):
                return self

            def __exit__(self, *a):
                return None

            def read(self):
                return x

        return R()

    answers[:] = [503, 503, b"ok"]
    assert objects.fetch("u", 5, 0.25, opener, waits.append) == (b"ok", 3) and waits == [0.25, 0.5]
    answers[:] = [404]
    assert objects.fetch("u", 5, 0.25, opener, waits.append) == (None, 1)
    answers[:] = [403]
    with pytest.raises(urllib.error.HTTPError):
        objects.fetch("u", 5, 0, opener, waits.append)
    answers[:] = [TimeoutError()] * 3
    with pytest.raises(TimeoutError):
        objects.fetch("u", 3, 0, opener, waits.append)


def test_acquisition_fails_closed(spark, tmp_path):
    urls = spark.createDataFrame([("nosuch://x/1",), ("nosuch://x/2",)], "url string")
    with pytest.raises(objects.AcquisitionError) as e:
        objects.acquire(urls, str(tmp_path / "got"), passes=2, attempts=1, backoff=0.0)
    assert len(e.value.failures) == 2
    assert objects.weekly_url("http://h/", "eur_usd", 2015, 7).endswith("/m1/EURUSD/2015/7.csv.gz")
    with pytest.raises(ValueError):
        objects.weekly_url("http://h", "EURUSD", 2015, 54)


def test_acquisition_counts_all_failures(spark, tmp_path):
    urls = spark.range(1205).select(F.concat(F.lit("nosuch://x/"), "id").alias("url"))
    with pytest.raises(objects.AcquisitionError, match="^1205 objects") as e:
        objects.acquire(urls, str(tmp_path / "got"), passes=2, attempts=1, backoff=0.0)
    assert e.value.count == 1205 and e.value.manifest in str(e.value) and e.value.manifest.endswith("/pass1")
    assert spark.read.parquet(e.value.manifest).filter("status = 'failed'").select("url").distinct().count() == 1205


def test_weekly_quotes(spark, tmp_path):
    text = "DateTime,BidOpen,BidHigh,BidLow,BidClose,AskOpen,AskHigh,AskLow,AskClose,TickQty\n"
    text += "2015-01-05 00:00:00,1.1000,1.1004,1.0998,1.1002,1.1002,1.1006,1.1000,1.1004,100\n2015-01-05 00:01:00,1.1002,1.1004,1.0998,1.1003,1.1004,1.1006,1.1000,1.1005,50\n"
    (tmp_path / "w.csv.gz").write_bytes(gzip.compress(text.encode()))
    mid, bid, ask = (readers.read_weekly_quotes(spark, str(tmp_path / "w.csv.gz"), s).orderBy("ts").collect() for s in ("mid", "bid", "ask"))
    assert (mid[0]["open"], mid[0]["spread_mean_proxy"], mid[0]["volume"]) == pytest.approx((1.1001, 0.0002, 100.0))
    assert (bid[1]["close"], ask[1]["close"]) == (1.1003, 1.1005)


def test_year_of_weeks(spark, tmp_path):
    from tidemark.sources.objects import download_year

    head = "DateTime,BidOpen,BidHigh,BidLow,BidClose,AskOpen,AskHigh,AskLow,AskClose"
    row = lambda day: f"\n{day} 00:00:00,1.1,1.2,1.0,1.15,1.102,1.202,1.002,1.152"
    folder = tmp_path / "m1/EURUSD/2015"
    folder.mkdir(parents=True)
    (folder / "2.csv.gz").write_bytes(gzip.compress((head + row("2015-01-05") + row("2015-01-06")).encode()))
    (folder / "3.csv.gz").write_bytes(gzip.compress((head.lower() + row("2015-01-12")).encode()))
    got, missing = download_year(spark, f"file://{tmp_path}", "eur/usd", 2015, str(tmp_path / "got"), attempts=1, backoff=0.0)
    rows = got.orderBy("ts").collect()
    assert missing == [w for w in range(1, 54) if w not in (2, 3)]
    assert [str(r["ts"])[:10] for r in rows] == ["2015-01-05", "2015-01-06", "2015-01-12"] and rows[0]["open"] == pytest.approx(1.101)
    assert spark.read.parquet(str(tmp_path / "got/pass0")).filter("status = 'ok' AND sha256 IS NOT NULL").count() == 2
    with pytest.raises(ValueError, match="no week"):
        download_year(spark, f"file://{tmp_path}", "GBPUSD", 2015, str(tmp_path / "none"), attempts=1, backoff=0.0)
    (folder / "4.csv.gz").write_bytes(gzip.compress((head + row("2015-01-05")).encode()))
    with pytest.raises(ValueError, match="duplicate"):
        download_year(spark, f"file://{tmp_path}", "EURUSD", 2015, str(tmp_path / "again"), attempts=1, backoff=0.0)


def test_candle_payloads(spark):
    arrays = json.dumps({"candles": [[1704067200, 1.0, 1.2, 1.3, 0.9], [1704067260000, 1.2, 1.1, 1.25, 1.0], ["x"], [1, 2]]})
    objects_ = json.dumps([{"time": 1704067200, "open": 1, "high": 2, "low": 0.5, "close": 1.5}, {"time": 1}])
    df = spark.createDataFrame([(arrays, "EURUSD_otc", 60, 92.0), (objects_, "GBPUSD", 60, 0.8), ("[]", "Z", 60, None)], "payload string, asset string, period_seconds int, payout double")
    got = readers.parse_candle_payloads(df).orderBy("asset", "ts").collect()
    assert [(r["asset"], r["market_type"], r["open"], r["high"], r["low"], r["close"], r["payout"]) for r in got] == [
        ("EURUSD_otc", "otc", 1.0, 1.3, 0.9, 1.2, 0.92), ("EURUSD_otc", "otc", 1.2, 1.25, 1.0, 1.1, 0.92), ("GBPUSD", "regular", 1.0, 2.0, 0.5, 1.5, 0.8)]
    assert str(got[1]["ts"]) == "2024-01-01 00:01:00"


def test_public_csv_and_sidecar(spark, tmp_path):
    (tmp_path / "p.csv").write_text("datetime,open,high,low,close,tick_volume,other\n2025-03-03T00:00:00Z,1,2,0.5,1.5,7,x\n2025-03-03T00:01:00Z,1,2,0.5,1.5,8,y\n")
    got = readers.read_public_csv(spark, str(tmp_path / "p.csv"), {"tick_volume": "volume"}, "datetime")
    assert got.columns == ["ts", "open", "high", "low", "close", "volume"] and got.count() == 2
    readers.write_frame(got, str(tmp_path / "out.parquet"))
    meta = readers.write_metadata(got, str(tmp_path / "out.parquet"), source="test")
    assert meta["rows"] == 2 and len(meta["fingerprint"]) == 64
    assert readers.load_dataset(spark, str(tmp_path / "out.parquet")).count() == 2
    with pytest.raises(ValueError):
        readers.read_frame(spark, "x.txt")


def test_consolidation(spark, candles):
    bars = candles([(1, 2, 0.5, 1.5)] * 4).select("ts", "open", "high", "low", "close")
    first, second = bars.limit(3), bars.orderBy(F.desc("ts")).limit(2)
    assert consolidate.consolidate([first, second]).count() == 4
    wrong = second.withColumn("close", F.lit(1.6))
    with pytest.raises(ValueError, match="conflicting"):
        consolidate.consolidate([bars, wrong])
    assert consolidate.consolidate([bars, wrong], "prefer_last").filter("close = 1.6").count() == 2


def test_payouts_as_of_never_use_the_future(spark):
    e = spark.createDataFrame([("A", "2024-01-01 12:00:30"), ("A", "2024-01-01 12:01:30"), ("A", "2024-01-02 00:00:10"), ("B", "2024-01-01 12:00:00")], "asset string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    o = spark.createDataFrame([("A", "2024-01-01 12:00:00", 0.82), ("A", "2024-01-01 12:02:00", 0.92), ("A", "2024-01-01 23:59:50", 0.7)], "asset string, observed_at string, payout double").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    got = [(r["payout"], r["payout_age_seconds"]) for r in joins.asof_backward(e, o, 120).orderBy("asset", "ts").collect()]
    assert got == [(0.82, 30.0), (0.82, 90.0), (0.7, 20.0), (None, None)]
    assert joins.asof_backward(e, o.limit(0), 120).filter("payout IS NOT NULL").count() == 0


CANDIDATES = "model_version string, asset string, market_type string, signal_timestamp timestamp, direction string, probability double, probability_threshold double, expiry_bars int, payout double, payout_observed_at timestamp"
OUTCOMES = "candidate_id string, entry_timestamp timestamp, expiry_timestamp timestamp, entry_price double, exit_price double, result string, pnl double"


def test_ledger_chain_and_rules(spark, tmp_path):
    path = str(tmp_path / "ledger")
    at = dt.datetime(2026, 1, 1, 12, 0, tzinfo=dt.UTC)
    good = dict(model_version="v", asset="A", market_type="otc", signal_timestamp=at, direction="call", probability=0.7, probability_threshold=0.625, expiry_bars=3,
                payout=0.9, payout_observed_at=at - dt.timedelta(seconds=5))
    add = lambda *rows: ledgers.append_candidates(spark.createDataFrame([tuple((good | r).values()) for r in rows], CANDIDATES), path)
    add({}, {"asset": "B", "payout": None, "payout_observed_at": None})
    for wrong, rule in (({}, "identity"), ({"direction": "put"}, "conviction"), ({"direction": "up"}, "side"), ({"probability": 0.6}, "conviction"), ({"payout": 1.5}, "payout"),
                        ({"probability_threshold": 0.5}, "threshold"), ({"expiry_bars": 0}, "horizon"), ({"payout_observed_at": at + dt.timedelta(seconds=1)}, "future"), ({"probability": None}, "probability")):
        with pytest.raises(ValueError, match=rule):
            add({"asset": "C"}, wrong if not wrong else {"asset": "D"} | wrong)
    with pytest.raises(ValueError, match="identity"):
        add({"asset": "E"}, {"asset": "E"})
    with pytest.raises(ValueError, match="time zone"):
        ledgers.append_candidates(spark.createDataFrame([tuple(good.values())], CANDIDATES).withColumn("signal_timestamp", F.lit("2026-01-01 12:00:00")), path)
    known = {r["asset"]: r["candidate_id"] for r in ledgers.events(spark, path, "candidate").collect()}
    assert known["A"] == ledgers.candidate_id("v", "A", "otc", at, "call", 3, 1, 0.625) and len(known) == 2

    done = dict(candidate_id=known["A"], entry_timestamp=at + dt.timedelta(minutes=1), expiry_timestamp=at + dt.timedelta(minutes=3), entry_price=1.0, exit_price=1.1, result="win", pnl=0.9)
    settle = lambda *rows: ledgers.append_outcomes(spark.createDataFrame([tuple((done | r).values()) for r in rows], OUTCOMES), path)
    for wrong, rule in (({"pnl": -1.0}, "sign"), ({"result": "tie"}, "sign"), ({"result": "draw"}, "result"), ({"candidate_id": "none"}, "one candidate"),
                        ({"entry_timestamp": at}, "after signal"), ({"expiry_timestamp": at}, "after entry")):
        with pytest.raises(ValueError, match=rule):
            settle(wrong)
    settle({})
    with pytest.raises(ValueError, match="first outcome"):
        settle({})
    rows = {r["asset"]: r for r in ledgers.forward_ledger(spark, path).collect()}
    assert rows["A"]["settled"] and rows["A"]["outcome_result"] == "win" and not rows["B"]["settled"] and ledgers.verify(spark, path)
    records = ledgers.read_ledger(spark, path)
    assert [r["seq"] for r in records.orderBy("seq").collect()] == [0, 1, 2]
    tampered = records.withColumn("payload", F.when(F.col("seq") == 0, F.regexp_replace("payload", "0.7", "0.8")).otherwise(F.col("payload")))
    assert ledgers.chain_faults(tampered).count() == 1


def test_manifest(spark, tmp_path, candles):
    frame = candles([(1, 2, 0.5, 1.5)] * 3)
    entry = ledgers.manifest_entry(frame, "A", 60, "2026-01-01T00:00:00+00:00", "demo", "a.parquet")
    path = str(tmp_path / "manifest")
    ledgers.append_manifest(spark, path, entry)
    with pytest.raises(ValueError, match="exists"):
        ledgers.append_manifest(spark, path, entry)
    assert readers.read_manifest(spark, path, "A", 60).count() == 1


def test_bootstraps(spark):
    rows = [(i, "win" if i % 3 else "loss", 0.8 if i % 3 else -1.0) for i in range(120)]
    t = spark.createDataFrame(rows, "entry_ts int, result string, pnl double").withColumn("signal_ts", F.col("entry_ts"))
    a, b = resample.bootstrap_expectancy(t, 200).first(), resample.bootstrap_expectancy(t, 200).first()
    assert a == b and a["p2_5"] <= a["median"] <= a["p97_5"] and a["median"] == pytest.approx(0.2, abs=0.05)
    k = resample.block_bootstrap_expectancy(t, 20, 200).first()
    assert k["p2_5"] <= k["median"] <= k["p97_5"] and k["simulations"] == 200
    with pytest.raises(ValueError):
        resample.bootstrap_expectancy(t, 50)


def test_long_ledgers_are_drawn_by_joins_alike(spark, monkeypatch):
    rows = [(i, "win" if i % 3 else "loss", 0.8 + i / 1000 if i % 3 else -1.0) for i in range(130)]
    t = spark.createDataFrame(rows, "entry_ts int, result string, pnl double").withColumn("signal_ts", F.col("entry_ts"))
    jobs = [lambda: resample.bootstrap_expectancy(t, 150), lambda: resample.block_bootstrap_expectancy(t, 20, 150), lambda: resample.monte_carlo(t, 150),
            lambda: resample.bootstrap_expectancy(t.limit(0), 150), lambda: resample.block_bootstrap_expectancy(t.limit(10), 20, 150)]
    short = [j().first() for j in jobs]
    monkeypatch.setattr(resample, "PACKED", -1)
    for job, a in zip(jobs, short, strict=True):
        b = job().first()
        assert [*b.asDict()] == [*a.asDict()] and all(x is y is None or x == pytest.approx(y, rel=1e-9) for x, y in zip(a, b, strict=True))


class Always:
    """A model that gives every eligible bar one probability."""

    def __init__(self, p):
        self.p = p

    def transform(self, rows):
        return rows.withColumn("probability_up", F.when(F.col("eligible"), self.p))


@pytest.mark.parametrize("p,as_of,direction,reason", [
    (0.7, "2024-01-01 00:02:05", "call", "frozen_signal_with_fresh_payout"), (0.3, "2024-01-01 00:02:05", "put", "frozen_signal_with_fresh_payout"),
    (0.5, "2024-01-01 00:02:05", "no_trade", "frozen_probability_threshold_not_cleared"), (0.7, "2024-01-01 00:02:40", "no_trade", "completed_candle_is_stale"),
    (0.7, "2024-01-01 00:00:05", "no_trade", "no_completed_candle"), (None, "2024-01-01 00:02:05", "no_trade", "insufficient_causal_feature_history"),
])
def test_latest_completed_bar(spark, candles, p, as_of, direction, reason):
    c = candles([(1, 2, 0.5, 1.5)] * 2 + [(99, 100, 98, 99)]).withColumn("asset", F.lit("X_otc")).withColumn("f", F.lit(1.0) if p else F.lit(None).cast("double"))
    o = spark.createDataFrame([("X_otc", "2024-01-01 00:01:59", 0.9), ("X_otc", "2024-01-01 00:02:01", 0.1)], "asset string, observed_at string, payout double").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    got = models.score_latest(Always(p or 0.5), c, o, as_of, features=["f"]).first()
    assert (got["direction"], got["reason"]) == (direction, reason)
    if direction != "no_trade":
        assert (got["payout"], got["payout_age_seconds"], got["delay_seconds"]) == (0.9, 1.0, 5.0)


def test_synthetic_is_reproducible(spark):
    a, b = (synthetic.synthetic_ohlc(spark, 600).orderBy("ts").collect() for _ in range(2))
    assert a == b and all(r["high"] >= max(r["open"], r["close"]) and r["low"] <= min(r["open"], r["close"]) for r in a)
