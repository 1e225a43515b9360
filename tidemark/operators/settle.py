"""Settlement of signals as fixed-expiry trades, by looking ahead along the bars; no join."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bars import series, contiguous_ahead, with_breaks
from tidemark.operators.stream import first_free
from tidemark.schemas import KEYS, TRADE

#: A cooldown at which every trade may start.
ALWAYS_FREE = -(2**62)
#: What a trade without a move counts as.
TIES = {"refund": "tie", "loss": "loss", "win": "win"}


@dataclass(frozen=True)
class Settlement:
    expiry_bars: int = 3
    entry_offset_bars: int = 1
    payout: float = 0.82
    payout_column: str | None = None
    min_payout: float | None = None
    stake: float = 1.0
    tie_policy: str = "refund"
    allow_overlap: bool = True
    cooldown_bars: int = 0
    require_contiguous: bool = True

    def __post_init__(self):
        if self.expiry_bars < 1 or self.entry_offset_bars < 1 or self.cooldown_bars < 0:
            raise ValueError("expiry and offset must be >= 1, cooldown >= 0")
        if not 0 <= self.payout <= 10 or self.min_payout is not None and not 0 <= self.min_payout <= 10:
            raise ValueError("payouts must be between 0 and 10")
        if self.stake <= 0 or self.tie_policy not in TIES:
            raise ValueError("stake must be positive and tie_policy one of " + ", ".join(TIES))

    def but(self, **changes) -> Settlement:
        return replace(self, **changes)


def break_even(payout: Column) -> Column:
    return 1 / (1 + payout)


def outcome(direction: Column, entry: Column, exit_: Column, tie: Column | str = "tie") -> Column:
    """win, loss, or what a tie counts as."""
    move = F.signum(exit_ - entry) * direction
    return F.when(move > 0, "win").when(move < 0, "loss").otherwise(tie)


def profit(result: Column, payout: Column, stake: Column | float = 1.0) -> Column:
    return F.when(result == "win", payout * stake).when(result == "loss", -F.lit(stake)).otherwise(F.lit(0.0))


def checked_signal(name: str) -> Column:
    """The signal cut to a whole number; what is then not -1, 0 or 1 fails. Null and NaN mean none."""
    x = F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))
    cut = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("int")
    return F.when((x != 0) & ~cut.isin(-1, 1), F.raise_error(F.lit("signals must be -1, 0 or 1")).cast("int")).otherwise(cut)


def settle(bars: DataFrame, signal: str = "signal", cfg: Settlement = Settlement(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Trades of a signal column over numbered bars: TRADE columns, series_id, slice, entry_idx, exit_idx and `keep`.

    Entry is the open of the bar `entry_offset_bars` ahead, exit the close expiry_bars - 1 later.
    Horizons that leave the slice or, if required, cross a gap between signal and exit give no
    trade. Of what remains every payout must lie in [0, 10]; min_payout then filters, and
    without overlap trades are taken greedily.
    """
    return settle_all(bars, [(signal, cfg)], keep).drop("plan")


def settle_all(bars: DataFrame, plans: list[tuple[str, Settlement]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Trades of several (signal column, settlement) plans in one pass over the bars; `plan` is the place in the list."""
    cfgs = [cfg for _, cfg in plans]
    ahead = lambda column, n: F.lead(column, n).over(series())
    rows = with_breaks(bars) if any(cfg.require_contiguous for cfg in cfgs) else bars
    cells = []
    for i, (signal, cfg) in enumerate(plans):
        off, out = cfg.entry_offset_bars, cfg.entry_offset_bars + cfg.expiry_bars - 1
        whole = contiguous_ahead(out) if cfg.require_contiguous else F.lit(True)
        direction, exit_ts = checked_signal(signal), ahead("ts", out)
        cell = F.struct(
            F.lit(i).alias("plan"), direction.alias("direction"), ahead("ts", off).alias("entry_ts"), exit_ts.alias("exit_ts"), ahead("open", off).alias("entry_price"),
            ahead("close", out).alias("exit_price"), (ahead(cfg.payout_column, off).cast("double") if cfg.payout_column else F.lit(float(cfg.payout))).alias("payout"),
            (F.col("bar_idx") + off).alias("entry_idx"), (F.col("bar_idx") + out).alias("exit_idx"))
        cells.append(F.when((direction != 0) & exit_ts.isNotNull() & whole, cell))
    rows = rows.withColumn("_trades", F.filter(F.array(*cells), lambda x: x.isNotNull())).filter(F.size("_trades") > 0)
    rows = rows.select(*KEYS, F.col("ts").alias("signal_ts"), *[F.col(k).alias(f"_keep_{k}") for k in keep], F.explode("_trades").alias("t"))
    rows = rows.select(*KEYS, "signal_ts", *[F.col(f"_keep_{k}") for k in keep], "t.*")
    bad = F.col("payout").isNull() | F.isnan("payout") | ~F.col("payout").between(0, 10)
    rows = rows.withColumn("payout", F.when(bad, F.raise_error(F.lit("payout must be finite and between 0 and 10")).cast("double")).otherwise(F.col("payout")))

    of = lambda values: F.lit(values[0]) if len(set(values)) == 1 else F.element_at(F.array(*[F.lit(v) for v in values]), F.col("plan") + 1)
    if any(cfg.min_payout is not None for cfg in cfgs):
        rows = rows.filter(F.col("payout") >= of([float(cfg.min_payout or 0) for cfg in cfgs]))
    rows = rows.withColumn("result", outcome(F.col("direction"), F.col("entry_price"), F.col("exit_price"), of([TIES[cfg.tie_policy] for cfg in cfgs])))
    rows = rows.withColumns({"pnl": profit(F.col("result"), F.col("payout"), of([float(cfg.stake) for cfg in cfgs])), "break_even_win_rate": break_even(F.col("payout"))})
    rows = rows.select("plan", *KEYS, *TRADE, "entry_idx", "exit_idx", *[F.col(f"_keep_{k}").alias(k) for k in keep])
    if all(cfg.allow_overlap for cfg in cfgs):
        return rows
    rows = rows.withColumn("_wait", of([ALWAYS_FREE if cfg.allow_overlap else cfg.cooldown_bars for cfg in cfgs]).cast("long"))
    return first_free(rows, "entry_idx", "exit_idx", "_wait", "entry_idx", ["plan", *KEYS]).filter("kept").drop("kept", "_wait")


def direction_target(expiry_bars: int, entry_offset_bars: int = 1) -> Column:
    """1 if the settled move is up, 0 if down; null for ties, ends and gaps. Over rows of with_breaks."""
    out = entry_offset_bars + expiry_bars - 1
    move = F.lead("close", out).over(series()) - F.lead("open", entry_offset_bars).over(series())
    return F.when(contiguous_ahead(out), F.when(move > 0, 1.0).when(move < 0, 0.0))
