"""Model research: prepared data, purged out-of-fold probabilities, thresholds, fitted models, gated experiments.

Models are fitted on distributed rows. A logistic model is kept as its numbers and
scores as one column expression; boosted trees are in `boosting`.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.context import ML_FEATURES, add_ml_features
from tidemark.functions.signals import probability_signal
from tidemark.operators.bars import with_breaks
from tidemark.operators.joins import asof_backward
from tidemark.operators.metrics import metrics, score
from tidemark.operators.settle import Settlement, direction_target, settle
from tidemark.operators.validate import fingerprint
from tidemark.plans.boosting import BoostedTrees, Settings, fit_trees
from tidemark.plans.search import split_slices
from tidemark.session import written


#: Fixed values of the published protocol.
THRESHOLDS = (0.55, 0.575, 0.60, 0.625, 0.65)
EXPIRIES = (1, 2, 3, 5)
FROZEN_EXPIRY, FROZEN_THRESHOLD, FROZEN_PERIOD_SECONDS = 3, 0.625, 60


def prepare(bars: DataFrame, expiry_bars: int, entry_offset_bars: int = 1, features: list[str] = ML_FEATURES) -> DataFrame:
    """Bars with model inputs, `target_up` and `eligible` (no input missing; the future has no say)."""
    rows = add_ml_features(bars) if features is ML_FEATURES else bars
    rows = with_breaks(rows).withColumn("target_up", direction_target(expiry_bars, entry_offset_bars)).drop("breaks")
    ok = F.lit(True)
    for f in features:
        ok = ok & F.col(f).isNotNull()
    return rows.withColumn("eligible", ok)


@dataclass(frozen=True)
class LogisticModel:
    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float

    def transform(self, rows: DataFrame) -> DataFrame:
        z = F.lit(self.intercept)
        for f, m, s, w in zip(self.features, self.mean, self.scale, self.weights, strict=True):
            z = z + w * (F.col(f) - m) / s
        return rows.withColumn("probability_up", F.when(F.col("eligible"), 1 / (1 + F.exp(-z))))

    def coefficients(self) -> list[tuple[str, float]]:
        return sorted(zip(self.features, self.weights, strict=True), key=lambda x: -abs(x[1]))


def fit_logistic(rows: DataFrame, features: list[str] = ML_FEATURES, c: float = 1.0) -> LogisticModel:
    """L2-regularised logistic regression on inputs scaled by their population deviation."""
    train = rows.filter("eligible AND target_up IS NOT NULL")
    s = train.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    mean, scale = [s[f"m_{f}"] for f in features], [s[f"s_{f}"] or 1.0 for f in features]
    scaled = train.select("target_up", *[((F.col(f) - m) / d).alias(f) for f, m, d in zip(features, mean, scale, strict=True)])
    data = VectorAssembler(inputCols=list(features), outputCol="x").transform(scaled)
    lr = LogisticRegression(featuresCol="x", labelCol="target_up", regParam=1 / (c * s["n"]), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-6)
    model = lr.fit(data)
    return LogisticModel(tuple(features), tuple(mean), tuple(scale), tuple(model.coefficients), float(model.intercept))


def fit_boosted(rows: DataFrame, features: list[str] = ML_FEATURES, rounds: int = 200) -> BoostedTrees:
    """The protocol's boosted trees: rate 0.05, 15 leaves of 100 rows at least, L2 1."""
    return fit_trees(rows.filter("eligible AND target_up IS NOT NULL"), list(features), Settings(rounds))


FITS = {"logistic": (fit_logistic, 50), "boosted": (fit_boosted, 200)}


DAY_US = 86_400_000_000


def micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def folds(rows: DataFrame, n_splits: int, gap: int) -> tuple[DataFrame, list[int]]:
    """Rows with `pos` among their series' eligible and `known_us`, and the microsecond at which each fold's test starts.

    All series share the folds, as one model learns from all: the distinct times of eligible rows are cut, so a fold's
    test is later than all its training. `known_us` is the time `gap` eligible rows later in the series, null at its
    end; a row may be learned from where that is before the test. Times are counted by day, and ranked only
    within the days that hold a cut.
    """
    order = Window.partitionBy("series_id", "eligible").orderBy("ts")
    rows = rows.withColumns({"pos": F.when(F.col("eligible"), F.row_number().over(order) - 1), "known_us": F.when(F.col("eligible"), F.lead(micros("ts"), gap).over(order))})
    times = rows.filter("eligible").select(micros("ts").alias("us")).distinct().withColumn("day", F.floor(F.col("us") / DAY_US))
    days = times.groupBy("day").count().orderBy("day").collect()
    ends = list(accumulate(r["count"] for r in days))
    n = ends[-1] if ends else 0
    size = n // (n_splits + 1)
    if size < 1:
        raise ValueError("not enough times of eligible rows for that many folds")
    cuts = []  # (day, rank within it)
    for s in range(n - n_splits * size, n, size):
        d = bisect_right(ends, s)
        cuts.append((days[d]["day"], s - ends[d] + days[d]["count"] + 1))
    ranked = times.filter(F.col("day").isin([d for d, _ in cuts])).withColumn("n", F.row_number().over(Window.partitionBy("day").orderBy("us")))
    is_cut = reduce(lambda a, b: a | b, [(F.col("day") == d) & (F.col("n") == k) for d, k in cuts])
    return rows, sorted(r["us"] for r in ranked.filter(is_cut).collect())


def oof_probabilities(rows: DataFrame, kind: str = "logistic", n_splits: int = 5, gap: int = 3, features: list[str] = ML_FEATURES, **options) -> DataFrame:
    """Add `probability_up` from models that saw only earlier rows, less the label horizon; null before the first fold."""
    fit, least = FITS[kind]
    rows, starts = folds(written(rows, "folds"), n_splits, gap)
    at = micros("ts")
    out = rows.filter(F.col("pos").isNull() | (at < starts[0])).withColumn("probability_up", F.lit(None).cast("double"))
    for start, stop in zip(starts, [*starts[1:], None], strict=True):
        train = rows.filter((F.col("known_us") < start) & F.col("target_up").isNotNull())
        test = rows.filter(F.col("pos").isNotNull() & (at >= start) & (F.lit(True) if stop is None else at < stop))
        known = train.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target_up").alias("k")).first()
        usable = known["n"] >= least and known["k"] == 2
        scored = fit(train, features, **options).transform(test) if usable else test.withColumn("probability_up", F.lit(None).cast("double"))
        out = out.unionByName(scored)
    return out.drop("known_us")


def threshold_scores(rows: DataFrame, cfg: Settlement, thresholds=THRESHOLDS, objective: str = "wilson_low", min_trades: int = 200, min_expectancy: float | None = 0.0) -> DataFrame:
    """Metrics and score of every threshold; all are settled in one pass as slices of their own."""
    each = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    each = each.withColumn("slice", F.concat_ws("/", "slice", F.col("threshold").cast("string"))).withColumn("signal", probability_signal("probability_up", F.col("threshold")))
    scored = metrics(settle(each, "signal", cfg, ("threshold",)), ["threshold"])
    return scored.withColumn("score", score(objective, min_trades, min_expectancy))


def best_threshold(scores: DataFrame) -> float | None:
    """Highest score, of equals the higher threshold."""
    top = scores.filter("score IS NOT NULL").orderBy(F.desc("score"), F.desc("threshold")).limit(1).collect()
    return top[0]["threshold"] if top else None


def ranked_cells(scores: DataFrame) -> DataFrame:
    """Development cells with a score, best first: by Wilson bound, then the shorter expiry, then the higher threshold. Cells are few."""
    order = Window.orderBy(F.desc("wilson_low"), "expiry_bars", F.desc("threshold"))
    return scores.filter("score IS NOT NULL").withColumn("rank", F.row_number().over(order))


def evaluate(model, rows: DataFrame, threshold: float, cfg: Settlement) -> DataFrame:
    signalled = model.transform(rows).withColumn("signal", probability_signal("probability_up", threshold))
    return metrics(settle(signalled, "signal", cfg))


def run_model_experiment(bars: DataFrame, kind: str = "logistic", expiries=EXPIRIES, payout: float = 0.82, min_trades: int = 200, min_resolved: int = 200,
                         features: list[str] = ML_FEATURES, **options) -> dict:
    """Choose expiry and threshold out of fold on development, gate on validation, then open the locked slice."""
    parts = written(split_slices(bars), "slices")
    of = lambda name, e: prepare(parts.filter(F.col("slice") == name), e, 1, features)
    tried = []
    for e in expiries:
        cfg = Settlement(e, payout=payout)
        rows = oof_probabilities(of("development", e), kind, gap=e, features=features, **options)
        tried.append(written(threshold_scores(rows, cfg, min_trades=min_trades).withColumn("expiry_bars", F.lit(e)), "cells"))
    top = ranked_cells(reduce(DataFrame.unionByName, tried)).filter("rank = 1").drop("rank").collect()
    if not top:
        return {"status": "no_development_candidate"}
    best = top[0].asDict()
    cfg = Settlement(best["expiry_bars"], payout=payout)
    model = FITS[kind][0](of("development", cfg.expiry_bars), features, **options)
    out = {"best": best, "validation": evaluate(model, of("validation", cfg.expiry_bars), best["threshold"], cfg).first().asDict()}
    if not passes_evidence(out["validation"], min_resolved, payout):
        return out | {"status": "rejected_validation"}
    out["locked"] = evaluate(model, of("locked", cfg.expiry_bars), best["threshold"], cfg).first().asDict()
    return out | {"status": "passed_locked" if passes_evidence(out["locked"], min_resolved, payout) else "failed_locked"}


def passes_evidence(m: dict, min_resolved: int, payout: float) -> bool:
    return m["wins"] + m["losses"] >= min_resolved and (m["expectancy"] or 0) > 0 and (m["wilson_low"] or 0) > 1 / (1 + payout)


def fit_frozen(bars: DataFrame, expected_fingerprint: str, **options) -> BoostedTrees:
    """The frozen boosted model, only of the data whose fingerprint was registered."""
    found = fingerprint(bars).first()["fingerprint"]
    if found != expected_fingerprint:
        raise ValueError(f"training data fingerprint {found} is not the registered one")
    return fit_boosted(prepare(bars, FROZEN_EXPIRY), **options)


def evaluate_frozen(model, bars: DataFrame, payout: float = 0.82) -> DataFrame:
    return evaluate(model, prepare(bars, FROZEN_EXPIRY), FROZEN_THRESHOLD, Settlement(FROZEN_EXPIRY, payout=payout))


def score_latest(model, candles: DataFrame, payouts: DataFrame, as_of: str, semantics: str = "open", period_seconds: int = FROZEN_PERIOD_SECONDS,
                 max_delay_seconds: int = 15, max_payout_age_seconds: int = 120, threshold: float = FROZEN_THRESHOLD, features: list[str] = ML_FEATURES) -> DataFrame:
    """One decision per asset on its latest candle complete at `as_of`; fails closed to no_trade with a reason.

    Later candles are cut off before inputs are built; the payout is the last one observed at or
    before the candle's end.
    """
    if period_seconds != FROZEN_PERIOD_SECONDS or semantics not in ("open", "close") or min(max_delay_seconds, max_payout_age_seconds) < 0:
        raise ValueError("frozen scoring needs one-minute candles, semantics open or close, and ages >= 0")
    c = F.col
    now = F.lit(as_of).cast("timestamp")
    ends = c("ts").cast("timestamp") + F.make_dt_interval(secs=F.lit(period_seconds if semantics == "open" else 0))
    rows = candles.withColumns({"series_id": c("asset"), "slice": F.lit("all"), "completed_at": ends})
    assets = rows.select("asset").distinct()
    done = rows.filter(c("completed_at") <= now)
    last = done.groupBy("asset").agg(F.max("completed_at").alias("completed_at"))
    made = prepare(done, FROZEN_EXPIRY, 1, features)
    latest = model.transform(made).join(last.withColumnRenamed("completed_at", "_last"), "asset").filter(c("completed_at") == c("_last"))
    latest = latest.select("asset", c("ts").alias("source_ts"), "completed_at", "eligible", "probability_up")
    priced = asof_backward(latest, payouts, max_payout_age_seconds, event_ts="completed_at")
    out = assets.join(priced, "asset", "left").withColumn("decision_ts", now)
    out = out.withColumn("delay_seconds", (F.unix_micros("decision_ts") - F.unix_micros("completed_at")) / 1e6)
    p = c("probability_up")
    reason = (
        F.when(c("completed_at").isNull(), "no_completed_candle").when(c("delay_seconds") > max_delay_seconds, "completed_candle_is_stale")
        .when(~c("eligible"), "insufficient_causal_feature_history").when((p < threshold) & (p > 1 - threshold), "frozen_probability_threshold_not_cleared")
        .when(c("payout").isNull(), "frozen_signal_without_fresh_payout").otherwise("frozen_signal_with_fresh_payout")
    )
    out = out.withColumn("reason", reason)
    live = c("reason").startswith("frozen_signal")
    side = F.when(live & (p >= threshold), "call").when(live, "put").otherwise("no_trade")
    win = F.when(c("direction") == "call", p).when(c("direction") == "put", 1 - p)
    for name in ("payout", "observed_at", "payout_age_seconds"):
        out = out.withColumn(name, F.when(live, c(name)))
    out = out.withColumn("direction", side).withColumn("implied_win_probability", win)
    kind = F.when(F.lower("asset").endswith("_otc"), "otc").otherwise("regular")
    return out.withColumns({"market_type": kind, "break_even_win_rate": 1 / (1 + c("payout"))}).withColumn(
        "above_break_even", c("implied_win_probability") > c("break_even_win_rate")).drop("eligible")
