"""Column layouts of the engine's tables."""

#: Every ordered operator works within one series and one slice of it (see plans.search.split_slices).
KEYS = ["series_id", "slice"]

CANDLE = (
    "series_id string, ts timestamp, open double, high double, low double, close double, volume double, "
    "spread_mean double, payout double, asset string, market_type string, source string"
)
TICK = "ts timestamp, ask double, bid double, ask_volume double, bid_volume double"
PAYOUT = "asset string, observed_at timestamp, payout double, account_mode string"
TRADE = [
    "signal_ts", "entry_ts", "exit_ts", "direction", "entry_price", "exit_price", "payout", "break_even_win_rate", "result", "pnl",
]
PRICES = ["open", "high", "low", "close"]
