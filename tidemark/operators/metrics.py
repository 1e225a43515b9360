"""Evidence metrics of trade ledgers, whole or by groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054
BLOCK = 1 << 16
#: Sums of profits are decimals, so that they do not depend on the order in which tasks add.
EXACT = "decimal(28,12)"
#: Period labels by frequency: (unit of date_trunc, format).
PERIODS = {"D": ("day", "yyyy-MM-dd"), "W": ("week", "yyyy-MM-dd"), "M": ("month", "yyyy-MM"), "Y": ("year", "yyyy")}


def wilson(wins: Column, n: Column, side: int, z: float = Z95) -> Column:
    """Lower (-1) or upper (1) bound of the score interval, null for no trials."""
    p, nn = wins / F.nullif(n, F.lit(0)), F.nullif(n, F.lit(0)).cast("double")
    mid = p + z * z / (2 * nn)
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * nn)) / nn)
    return F.when(nn.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mid + side * half) / (1 + z * z / nn))))


def counts(trades: DataFrame, by: list[str]) -> DataFrame:
    """The metrics that need no order: partially aggregated, null keys kept."""
    of = lambda r: F.count_if(F.col("result") == r)
    out = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), of("win").alias("wins"), of("loss").alias("losses"), of("tie").alias("ties"),
        F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_pnl"), F.avg("pnl").alias("expectancy"),
    )
    n = F.col("wins") + F.col("losses")
    return out.withColumns({"win_rate": F.col("wins") / F.nullif(n, F.lit(0)), "wilson_low": wilson(F.col("wins"), n, -1), "wilson_high": wilson(F.col("wins"), n, 1)})


def block_of(trades: DataFrame, column: str):
    """Pieces of the order of trades: a day of times, a range of whole numbers."""
    kind = dict(trades.dtypes)[column]
    return F.to_date(column) if kind.startswith("timestamp") else F.floor(F.col(column) / BLOCK).cast("long")


def metrics(trades: DataFrame, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """All twelve metrics by group; without `by` one row, also for an empty ledger.

    One pass. The order of a group is cut into blocks (days), which tasks reduce to one row
    each: sums, the highest, lowest and deepest of the running sum, the longest streaks, and the streaks at
    both ends. A group's few blocks are then put together: running sums shift by what came before, and streaks that
    meet at the border of two blocks are joined.
    """
    by, order = by or [], order or ["entry_ts", "signal_ts"]
    c, keys = F.col, [f"_k{i}" for i in range(len(by))]
    rows = trades.select(*[c(k).alias(n) for k, n in zip(by, keys, strict=True)], block_of(trades, order[0]).alias("_block"), *[c(o).alias(f"_o{i}") for i, o in enumerate(order)], "result", "pnl")
    sort = [f"_o{i}" for i in range(len(order))]
    block = Window.partitionBy(*keys, "_block")
    along, upto = block.orderBy(*sort), block.orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"eq": F.sum("pnl").over(upto), "n": F.row_number().over(along), "same": F.row_number().over(Window.partitionBy(*keys, "_block", "result").orderBy(*sort))})
    rows = rows.withColumn("fall", F.greatest(F.lit(0.0), F.max("eq").over(upto)) - c("eq"))
    runs = rows.groupBy(*keys, "_block", "result", (c("n") - c("same")).alias("run")).agg(
        F.count(F.lit(1)).alias("len"), F.min("n").alias("at"), F.sum(F.col("pnl").cast(EXACT)).alias("sum"), F.max("eq").alias("high"), F.min("eq").alias("low"), F.max("fall").alias("fall"))
    of = lambda r, f, x: F.coalesce(f(F.when(c("result") == r, c(x))), F.lit(0))
    end = F.struct("result", "len")
    blocks = runs.groupBy(*keys, "_block").agg(
        *[of(r, F.sum, "len").alias(name) for r, name in (("win", "wins"), ("loss", "losses"), ("tie", "ties"))], F.sum("len").alias("trades"), F.sum("sum").alias("sum"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.max("fall").alias("fall"), of("loss", F.max, "len").alias("losing"), of("win", F.max, "len").alias("winning"),
        F.count(F.lit(1)).alias("runs"), F.min_by(end, "at").alias("first"), F.max_by(end, "at").alias("last"))
    # Blocks of a group in order, each with what came before it.
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("sum").over(before).cast("double"), F.lit(0.0)))
    blocks = blocks.withColumn("peak", F.greatest(F.lit(0.0), F.coalesce(F.max(c("start") + c("high")).over(before), F.lit(0.0))))
    blocks = blocks.withColumn("fall", F.greatest("fall", c("peak") - (c("start") + c("low"))))
    # Streaks at the ends: a block of several runs has two, which do not meet each other.
    ends = blocks.withColumn("ends", F.when(c("runs") == 1, F.array("first")).otherwise(F.array("first", "last"))).select("*", F.posexplode("ends").alias("end", "e"))
    border = group.orderBy("_block", "end")
    new = F.coalesce((c("end") == 1) | (c("e.result") != F.lag("e.result").over(border)), F.lit(True))
    ends = ends.withColumn("new", new.cast("int")).withColumn("streak", F.sum("new").over(border.rowsBetween(Window.unboundedPreceding, 0)))
    own = lambda f, x: f(F.when(c("end") == 0, c(x))).alias(x)
    streaks = ends.groupBy(*keys, "streak", c("e.result").alias("result")).agg(
        F.sum("e.len").alias("len"), *[own(F.sum, x) for x in ("trades", "wins", "losses", "ties", "sum")], *[own(F.max, x) for x in ("fall", "losing", "winning")])
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).alias(x)
    out = streaks.groupBy(*keys).agg(
        *[total(x) for x in ("trades", "wins", "losses", "ties")], F.coalesce(F.sum("sum").cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)")).alias("total"), F.coalesce(F.max("fall"), F.lit(0.0)).alias("max_drawdown"),
        F.greatest(of("loss", F.max, "len"), F.coalesce(F.max("losing"), F.lit(0))).alias("max_losing_streak"),
        F.greatest(of("win", F.max, "len"), F.coalesce(F.max("winning"), F.lit(0))).alias("max_winning_streak"))
    n = c("wins") + c("losses")
    return out.select(
        *[c(k).alias(name) for k, name in zip(keys, by, strict=True)], "trades", "wins", "losses", "ties", c("total").cast("double").alias("total_pnl"), (c("total") / F.nullif("trades", F.lit(0))).cast("double").alias("expectancy"),
        (c("wins") / F.nullif(n, F.lit(0))).alias("win_rate"), wilson(c("wins"), n, -1).alias("wilson_low"), wilson(c("wins"), n, 1).alias("wilson_high"),
        "max_drawdown", "max_losing_streak", "max_winning_streak")


def by_direction(trades: DataFrame) -> DataFrame:
    """Rows call and put, zeros where one has no trades; an empty ledger gives none."""
    sides = trades.limit(1).select(F.explode(F.array(F.lit("call"), F.lit("put"))).alias("side"))
    rows = metrics(trades.withColumn("side", F.when(F.col("direction") == 1, "call").otherwise("put")), ["side"])
    zero = ["trades", "wins", "losses", "ties", "total_pnl", "max_drawdown", "max_losing_streak", "max_winning_streak"]
    return sides.join(rows, "side", "left").fillna(0, zero)


def by_period(trades: DataFrame, frequency: str = "M") -> DataFrame:
    unit, text = PERIODS[frequency]
    return metrics(trades.withColumn("period", F.date_format(F.date_trunc(unit, "entry_ts"), text)), ["period"])


def breakdown(trades: DataFrame, by: list[str], min_trades: int = 1) -> DataFrame:
    """By any keys, nulls as a group of their own; groups of fewer trades are left out."""
    if not by:
        raise ValueError("at least one breakdown column is needed")
    return metrics(trades, by).filter(F.col("trades") >= min_trades)


def grouping_breakdown(trades: DataFrame, dimensions: list[str]) -> DataFrame:
    """Order-free metrics for each dimension alone, in one pass: (dimension, value, trades, ...)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    rows = trades.select("result", "pnl", F.explode(pairs).alias("d")).select("d.*", "result", "pnl")
    return counts(rows, ["dimension", "value"])


def volatility_bucket(column: str = "atr_percentile_100") -> Column:
    x = F.col(column)
    return F.when(x <= 0.25, "q1_low").when(x <= 0.50, "q2_mid_low").when(x <= 0.75, "q3_mid_high").when(x > 0.75, "q4_high")


def score(objective: str, min_trades: int, min_expectancy: float | None = None) -> Column:
    """The objective over a metrics row; null where too few trades or too little expectancy make it inviable."""
    if objective not in ("expectancy", "win_rate", "wilson_low"):
        raise ValueError(f"unknown objective {objective!r}")
    ok = F.col("trades") >= min_trades
    if min_expectancy is not None:
        ok = ok & (F.col("expectancy") > min_expectancy)
    return F.when(ok, F.col(objective))
