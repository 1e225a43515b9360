"""Bootstraps and what-if repricing of trade ledgers.

Random draws are hashes of (seed, simulation, draw): reruns agree on any cluster, and SQL can
repeat them. The profits of at most PACKED trades are broadcast as one array and a task draws whole simulations from
it: a simulation is a row, and nothing is shuffled before the quantiles. Longer ledgers are looked up by position in
joins. Simulations spread over tasks either way.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import EXACT, block_of, metrics
from tidemark.operators.settle import Settlement, profit, settle_all
from tidemark.session import written

#: Trades whose profits are broadcast: 8 MB. Draws of a task.
PACKED, DRAWS_A_TASK = 1 << 20, 5_000_000
PAYOUTS = (0.70, 0.75, 0.80, 0.82, 0.85, 0.90, 0.92)


def hash_index(seed: int, n: Column, *parts: str) -> Column:
    """A number in [0, n): eight hex digits of an MD5 of seed and parts, modulo n."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % n


def numbered_pnl(trades: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(pos, pnl, upto) in the order of entry: position from 0 and the sum so far; a pnl that is not finite fails.

    Positions and sums are counted within blocks (days) and shifted by those of the blocks before, of which there is one row each.
    """
    order = order or ["entry_ts", "signal_ts"]
    pnl = F.when(F.col("pnl").isNull() | F.isnan("pnl") | (F.abs("pnl") == float("inf")), F.raise_error(F.lit("pnl must be finite")).cast("double")).otherwise(F.col("pnl"))
    rows = trades.select(block_of(trades, order[0]).alias("_block"), *order, pnl.alias("pnl"))
    w = Window.partitionBy("_block").orderBy(*order)
    rows = rows.select("_block", "pnl", F.row_number().over(w).alias("n"), F.sum("pnl").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("pnl").cast(EXACT)).alias("total"))
    blocks = blocks.select("_block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), F.coalesce(F.sum("total").over(before).cast("double"), F.lit(0.0)).alias("start"))
    return rows.join(blocks, "_block").select((F.col("first") + F.col("n") - 1).cast("long").alias("pos"), "pnl", (F.col("start") + F.col("sum")).alias("upto"))


def total(value: Column | str) -> Column:
    """A sum that does not depend on the order of rows."""
    return F.sum((F.col(value) if isinstance(value, str) else value).cast(EXACT)).cast("double")


def _simulations(trades: DataFrame, n: int) -> DataFrame:
    if n < 100:
        raise ValueError("simulations must be >= 100")
    return trades.sparkSession.range(n).withColumnRenamed("id", "sim")


def quantiles(sims: DataFrame, value: str, prefix: str) -> list[Column]:
    return [F.percentile(value, p).alias(f"{prefix}{name}") for p, name in ((0.025, "p2_5"), (0.5, "median"), (0.975, "p97_5"))]


def summary(sims: DataFrame, value: str) -> DataFrame:
    return sims.agg(F.count(F.lit(1)).alias("simulations"), *quantiles(sims, value, ""), F.avg((F.col(value) > 0).cast("double")).alias("probability_positive"))


def packed(pnl: DataFrame):
    """The profits of numbered_pnl() in order, broadcast. None beyond PACKED trades."""
    rows = pnl.select("pos", "pnl").limit(PACKED + 1).toPandas()
    return pnl.sparkSession.sparkContext.broadcast(rows.sort_values("pos")["pnl"].to_numpy(float)) if len(rows) <= PACKED else None


def simulated(pnl, simulations: int, seed: int, spark: SparkSession, ledger: Callable, fields: dict[str, Callable]) -> DataFrame:
    """A row of `fields` for each simulation: functions of the drawn profits, which ledger(profits, hashed) gives; hashed(n, count) are `count` draws below n."""
    size = len(pnl.value)
    tasks = max(spark.sparkContext.defaultParallelism, simulations * size // DRAWS_A_TASK)
    sims = spark.range(0, simulations, 1, tasks)

    def run(batches):
        profits = pnl.value
        for b in batches:
            rows = []
            for sim in b.column(0).to_pylist():
                begin = f"{seed}|{sim}|"

                def hashed(n, count, begin=begin):
                    raw = b"".join([hashlib.md5(f"{begin}{k}".encode(), usedforsecurity=False).digest()[:4] for k in range(count)])
                    return np.frombuffer(raw, ">u4").astype(np.int64) % n

                drawn = ledger(profits, hashed)
                rows.append([f(drawn) for f in fields.values()])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows, strict=True)], list(fields))

    out = sims.mapInArrow(run, ", ".join(f"{f} double" for f in fields))
    return out if size else out.limit(0)


def redrawn(profits: np.ndarray, hashed: Callable) -> np.ndarray:
    return profits[hashed(len(profits), len(profits))]


def mean(drawn: np.ndarray) -> float:
    return math.fsum(drawn) / len(drawn)


def deepest_fall(drawn: np.ndarray) -> float:
    equity = np.cumsum(drawn)
    return float((np.maximum.accumulate(np.maximum(equity, 0.0)) - equity).max())


def draws(pnl: DataFrame, simulations: DataFrame, seed: int) -> DataFrame:
    """(sim, draw, pnl): as many draws with replacement as there are trades, per simulation; a row for each."""
    size = pnl.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    rows = simulations.crossJoin(F.broadcast(size)).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.withColumn("pos", hash_index(seed, F.col("n"), "sim", "draw")).join(pnl.select("pos", "pnl"), "pos").select("sim", "draw", "pnl")


def bootstrap_expectancy(trades: DataFrame, simulations: int = 10_000, seed: int = 42) -> DataFrame:
    sims, pnl = _simulations(trades, simulations), written(numbered_pnl(trades), "pnl")
    row = packed(pnl)
    if row is None:
        means = draws(pnl, sims, seed).groupBy("sim").agg((total("pnl") / F.count(F.lit(1))).alias("mean"))
    else:
        means = simulated(row, simulations, seed, trades.sparkSession, redrawn, {"mean": mean})
    return summary(means, "mean")


def block_bootstrap_expectancy(trades: DataFrame, block: int = 20, simulations: int = 10_000, seed: int = 42) -> DataFrame:
    """Blocks of consecutive trades at drawn starts, cut to as many trades as there are."""
    sims, pnl = _simulations(trades, simulations), written(numbered_pnl(trades), "pnl")
    row = packed(pnl)
    if row is not None:
        def blocks(profits, hashed):
            start = hashed(len(profits) - block + 1, -(-len(profits) // block))
            return profits[(start[:, None] + np.arange(block)).ravel()[: len(profits)]]

        means = simulated(row, simulations, seed, trades.sparkSession, blocks if len(row.value) >= block else redrawn, {"mean": mean})
        return summary(means if len(row.value) >= block else means.limit(0), "mean")
    # A block's sum is the difference of two running sums.
    sums = pnl.select((F.col("pos") + 1).alias("pos"), "upto").unionByName(pnl.select(F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("upto")).limit(1))
    known = pnl.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= block)
    rows = sims.crossJoin(F.broadcast(known)).withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)))
    rows = rows.withColumn("start", hash_index(seed, F.col("n") - block + 1, "sim", "blk")).withColumn("end", F.col("start") + F.least(F.lit(block), F.col("n") - F.col("blk") * block))
    ends = rows.join(sums.withColumnsRenamed({"pos": "start", "upto": "s0"}), "start").join(sums.withColumnsRenamed({"pos": "end", "upto": "s1"}), "end")
    return summary(ends.groupBy("sim").agg((total(F.col("s1") - F.col("s0")) / F.first("n")).alias("mean")), "mean")


def monte_carlo(trades: DataFrame, simulations: int = 5_000, seed: int = 42) -> DataFrame:
    """Final profit and deepest drawdown of resampled ledgers."""
    sims, pnl = _simulations(trades, simulations), written(numbered_pnl(trades), "pnl")
    row = packed(pnl)
    if row is None:
        upto = Window.partitionBy("sim").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)
        rows = draws(pnl, sims, seed).withColumn("equity", F.sum("pnl").over(upto))
        rows = rows.withColumn("fall", F.greatest(F.lit(0.0), F.max("equity").over(upto)) - F.col("equity"))
        ends = rows.groupBy("sim").agg(total("pnl").alias("final"), F.max("fall").alias("fall"))
    else:
        ends = simulated(row, simulations, seed, trades.sparkSession, redrawn, {"final": math.fsum, "fall": deepest_fall})
    return ends.agg(F.count(F.lit(1)).alias("simulations"), *quantiles(ends, "final", "pnl_"), *quantiles(ends, "fall", "drawdown_"),
                    F.avg((F.col("final") > 0).cast("double")).alias("probability_profit"))


def payout_sensitivity(trades: DataFrame, payouts=PAYOUTS) -> DataFrame:
    """Metrics with every win repriced at each payout, at a stake of one."""
    table = F.explode(F.array(*[F.lit(float(p)) for p in payouts])).alias("scenario_payout")
    rows = trades.select("entry_ts", "signal_ts", "result", table)
    rows = rows.withColumn("pnl", profit(F.col("result"), F.col("scenario_payout")))
    return metrics(rows, ["scenario_payout"]).withColumn("break_even_win_rate", 1 / (1 + F.col("scenario_payout")))


def execution_sensitivity(bars: DataFrame, signal: str = "signal", base: Settlement = Settlement(), offsets=(1, 2), cooldowns=(0, 1)) -> DataFrame:
    """Metrics under later entries, with overlap, and without it under each cooldown; all are settled in one pass."""
    plans = [(offset, overlap, cooldown) for offset in offsets for overlap, cooldown in [(True, 0), *((False, x) for x in cooldowns)]]
    cfgs = [base.but(entry_offset_bars=o, allow_overlap=a, cooldown_bars=x) for o, a, x in plans]
    found = metrics(settle_all(bars, [(signal, cfg) for cfg in cfgs]), ["plan"])
    table = bars.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(plans)], "plan int, offset int, overlap boolean, cooldown int")
    zero = ["trades", "wins", "losses", "ties", "total_pnl", "max_drawdown", "max_losing_streak", "max_winning_streak"]
    return table.join(found, "plan", "left").fillna(0, zero).drop("plan")
