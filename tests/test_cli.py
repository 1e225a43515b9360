import json

import pytest

from tidemark import cli
from tidemark.plans import models, search
from tidemark.functions import signals
from tidemark.functions.indicators import add_core_features
from tidemark.operators.bars import numbered
from tidemark.plans.reports import BenchmarkPolicy, public_benchmark
from tidemark.sources import ledgers
from tidemark.sources.synthetic import synthetic_ohlc
from tidemark.streaming import jobs

SMALL = signals.Family("range_reversion", signals.range_reversion, add_core_features,
                       {"adx_max": (60.0,), "rsi_lower": (40.0, 48.0), "rsi_upper": (55.0,), "band_buffer_atr": (1.0,), "atr_pct_max": (1.0,)})


@pytest.fixture
def dataset(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    synthetic_ohlc(spark, 900).write.parquet(path)
    return path


def test_commands(spark, dataset, tmp_path, capsys):
    registry = str(tmp_path / "registry")
    out = cli.main(["search", dataset, "--family", "sweep_reversal", "--expiries", "1,3", "--min-trades", "5", "--payout-column", "none", "--registry", registry, "--report", str(tmp_path / "r")])
    assert out["status"] in ("no_development_candidate", "rejected_validation", "insufficient_locked_test", "tested")
    assert cli.main(["verify", registry]) == {"valid": True}
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()[0])["status"] == out["status"]
    merged = cli.main(["consolidate", str(tmp_path / "m.parquet"), dataset, dataset])
    assert merged["rows"] == 900
    with pytest.raises(SystemExit):
        cli.main(["search", dataset, "--family", "none"])
    assert ledgers.read_ledger(spark, registry).count() == 1


def test_locked_slice_opens_only_behind_the_gate(spark, monkeypatch):
    bars = numbered(synthetic_ohlc(spark, 900).drop("payout"))
    opened = []
    real = search.evaluate
    monkeypatch.setattr(search, "evaluate", lambda f, rule, cfg: opened.append(1) or real(f, rule, cfg))
    shut = search.run_experiment(bars, SMALL, [search.Variant(3)], search.Gate(10**6), "expectancy", 3, 3)
    assert shut["status"] == "rejected_validation" and len(opened) == 1 and "locked" not in shut
    opened.clear()
    free = search.run_experiment(bars, SMALL, [search.Variant(3)], search.Gate(0, -2.0, -1.0), "expectancy", 3, 1)
    assert free["status"] in ("tested", "insufficient_locked_test") and len(opened) == 2
    none = search.run_experiment(bars, SMALL, [search.Variant(3)], search.Gate(), "expectancy", 10**6)
    assert none == {"status": "no_development_candidate"}


def test_model_protocol(spark):
    bars = numbered(synthetic_ohlc(spark, 900).drop("payout"))
    inputs = ["return_1", "rsi_14", "adx_14"]
    rows = models.prepare(models.add_ml_features(bars), 3, 1, inputs)
    scored = models.oof_probabilities(rows, "logistic", 3, 3, inputs).select("bar_idx", "pos", "probability_up").toPandas()
    assert len(scored) == 900 and scored["probability_up"].between(0, 1).sum() > 300
    assert scored[scored["pos"] < scored["pos"].max() // 5]["probability_up"].isna().all()
    with pytest.raises(ValueError, match="fingerprint"):
        models.fit_frozen(bars, "0" * 64)


def test_folds_of_several_series(spark, monkeypatch):
    from datetime import UTC, datetime, timedelta

    from pyspark.sql import functions as F

    seen = []

    class Half:
        def transform(self, rows):
            return rows.withColumn("probability_up", F.lit(0.5))

    def fit(train, features):
        seen.append(train.agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).first())
        return Half()

    def scored(firsts, m, n_splits):
        seen.clear()
        rows = [(f"s{k}", "all", datetime(2024, 1, 1, tzinfo=UTC) + timedelta(hours=first + i), i % 2, True) for k, first in enumerate(firsts) for i in range(m)]
        table = spark.createDataFrame(rows, "series_id string, slice string, ts timestamp, target_up int, eligible boolean")
        return models.oof_probabilities(table, "logistic", n_splits, 2, []).orderBy("series_id", "ts").toPandas()

    monkeypatch.setitem(models.FITS, "logistic", (fit, 1))
    for k, n_splits in ((1, 5), (6, 5), (4, 3)):
        got = scored([0] * k, 48, n_splits)
        head = 48 // (n_splits + 1)
        assert len(got) == 48 * k and (got["probability_up"].isna() == (got["pos"] < head)).all()
        assert [r["n"] for r in seen] == [k * (head * i - 2) for i in range(1, n_splits + 1)]
    got = scored([0, 30], 50, 3)  # times 0 to 79, cut at 20, 40 and 60; training ends two rows earlier
    assert (got["probability_up"].isna() == ((got["series_id"] == "s0") & (got["pos"] < 20))).all()
    assert [r["n"] for r in seen] == [18, 38 + 8, 48 + 28]
    hours = lambda r: (r["last"] - datetime(2024, 1, 1)).total_seconds() / 3600
    assert all(hours(r) + 2 < cut for r, cut in zip(seen, (20, 40, 60), strict=True))
    with pytest.raises(ValueError, match="not enough"):
        scored([0, 0, 0, 0], 2, 3)


def test_benchmark_report(spark):
    bars = numbered(synthetic_ohlc(spark, 600).drop("payout"))
    report = public_benchmark(bars, "synthetic", BenchmarkPolicy(("sweep_reversal",), (1,)))
    assert report["evaluations"] == 48 and len(report["baselines"]) == 3 and report["diagnostics"]["row_count"] == 600


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    rows = [("A", f"2024-01-01 00:0{i}:00", 1.0, 2.0, 0.5, 1.5 + (i == 2) * k) for i in range(5) for k in (0, 1)] + [("A", "2024-01-01 02:30:00", 1.0, 2.0, 0.5, 1.0)]
    table = spark.createDataFrame(rows, "series_id string, ts string, open double, high double, low double, close double").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(src)
    stream = spark.readStream.schema(table.schema).parquet(src)
    jobs.drain(jobs.stream_snapshots(stream), out, cp)
    got = spark.read.parquet(out).orderBy("ts").collect()
    assert [(r["conflict"], r["copies"]) for r in got] == [(False, 2), (False, 2), (True, 2), (False, 2), (False, 2)]
    jobs.drain(jobs.first_seen(stream), out + "2", cp + "2")
    assert spark.read.parquet(out + "2").count() == 6
    assert jobs.poll_cycles(1, 60) == 60
    with pytest.raises(ValueError):
        jobs.poll_cycles(1, 5)
