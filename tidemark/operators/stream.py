"""Recursions along time that no window frame expresses, along a series or over blocks of it.

As a rule a series streams through one task in batches with carried state: bars are bounded by the time that they span. Where the session
sets `tidemark.blocks.days` (of means) or `tidemark.blocks.bars` (of trades), or a call names a block, a series is cut into blocks of
time that are dealt to tasks on their own. A first pass reduces a block to the map that takes the state before it to the state after it:
for exponential means an affine map, for trades taken one after the other a monotone step function. One row a block is then composed
in order along each series, and a second pass runs each block from the state that it begins with. The rows are written once for both passes.
A kernel sees rows as consecutive segments of Arrow batches, so memory is bounded by a batch (and for step functions by a block's trades).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import KEYS
from tidemark.session import written


DAY_US = 86_400_000_000


def block_setting(df: DataFrame, name: str) -> float:
    """0 where the session does not cut series into blocks."""
    return float(df.sparkSession.conf.get(f"tidemark.blocks.{name}", "0"))


def _segments(batches, keys: list[str]):
    """(whether a new group of equal keys begins, its rows in this batch, whether the batch ends) of sorted rows."""
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        new = np.zeros(len(pdf), bool)
        new[0] = True
        for k in keys:  # a change of any key, nulls being equal
            now = pdf[k].to_numpy(object)
            gone = pdf[k].isna().to_numpy()
            new[1:] |= (gone[1:] != gone[:-1]) | ((now[1:] != now[:-1]) & ~gone[1:])
        change = np.flatnonzero(new)
        for a, b in zip(change, [*change[1:], len(pdf)], strict=True):
            name = tuple(None if pd.isna(x) else x for x in (pdf[k].iloc[a] for k in keys))
            yield name != last, pdf.iloc[a:b], b == len(pdf)
            last = name


def ordered_stream(df: DataFrame, order: list[str], start: Callable[[pd.DataFrame], object], step: Callable, added: str, keys: list[str], drop: list[str] | None = None) -> DataFrame:
    """Append columns `added` (a schema string): start(first segment) -> state, step(state, segment) -> (state, columns) along each group of keys."""
    drop = drop or []
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in drop)

    def run(batches):
        state, out = None, []
        for new, part, ends in _segments(batches, keys):
            state = start(part) if new else state
            state, columns = step(state, part)
            out.append(part.drop(columns=drop).assign(**columns))
            if ends:
                yield pd.concat(out) if len(out) > 1 else out[0]
                out = []

    return df.sortWithinPartitions(*keys, *order).mapInPandas(run, f"{fields}, {added}")


def blocked_stream(df: DataFrame, order: list[str], block: Column | None, begin: Callable, summarize: Callable, advance: Callable, step: Callable, added: str, keys: list[str] | None = None) -> DataFrame:
    """ordered_stream() along each series, its blocks in parallel; without a block, each series in one task.

    begin() is the state before a series; summarize(summary or None, segment) reduces a block; advance(state, summary) is the
    state after it; step(state, segment) -> (state, columns) yields the columns.
    """
    keys = KEYS if keys is None else keys
    if block is None:
        return ordered_stream(df.repartition(*keys), order, lambda _: begin(), step, added, keys)
    names = [f"_k{i}" for i in range(len(keys))]
    rows = written(df.withColumn("_block", block.cast("long")), "blocks")
    kinds = [f"`{n}` {rows.schema[k].dataType.simpleString()}" for n, k in zip(names, keys, strict=True)]

    def reduce_blocks(batches):
        name, at, summary = None, None, None
        row = lambda: pd.DataFrame([[*name, at, pickle.dumps(summary)]], columns=[*names, "_at", "_map"])
        for new, part, _ in _segments(batches, [*keys, "_block"]):
            if new:
                if name is not None:
                    yield row()
                name, at, summary = tuple(part[k].iloc[0] for k in keys), part["_block"].iloc[0], None
            summary = summarize(summary, part)
        if name is not None:
            yield row()

    def compose(state, part):
        states = []
        for m in part["_map"]:
            states.append(pickle.dumps(state))
            state = advance(state, pickle.loads(m))
        return state, {"_state": states}

    maps = rows.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", *order).mapInPandas(reduce_blocks, ", ".join([*kinds, "_at long", "_map binary"]))
    states = ordered_stream(maps.repartition(*names), ["_at"], lambda _: begin(), compose, "_state binary", names, ["_map"])
    same = F.col("_block").eqNullSafe(F.col("_at"))
    for k, n in zip(keys, names, strict=True):
        same = same & rows[k].eqNullSafe(F.col(n))
    known = rows.join(states.hint("merge"), same).drop(*names, "_at").repartition(*keys, "_block")
    first = lambda part: pickle.loads(part["_state"].iloc[0])
    return ordered_stream(known, order, first, step, added, [*keys, "_block"], ["_block", "_state"])


def ewm(df: DataFrame, specs: dict[str, tuple[str, float, int]], order: str = "ts", block_us: int | None = None) -> DataFrame:
    """Exponentially weighted means: {output: (column, alpha, min_periods)}, all in one pass.

    y follows y + w * (x - y) from the first value on, w = alpha / (alpha + (1 - alpha) ** k) after k - 1
    nulls; null rows repeat y, and rows with fewer than min_periods values so far are null.
    """
    far = 20_000  # nulls after which an old mean has no weight left in double precision

    def begin():
        return {name: (None, 0, 0) for name in specs}

    def follow(mean, nulls, x, alpha):
        before = [] if mean is None else [mean, *[np.nan] * min(nulls, far)]
        return pd.Series(np.concatenate([before, x])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(before) :]

    def summarize(summary, part):
        """Per output (nulls before the first value, that value, a, b, nulls after the last, values): the mean y at the first value ends as a y + b."""
        out = {}
        for name, (column, alpha, _) in specs.items():
            lead, first, a, b, nulls, seen = summary[name] if summary else (0, None, 1.0, 0.0, 0, 0)
            x = part[column].to_numpy(np.float64, na_value=np.nan)
            there = np.flatnonzero(~np.isnan(x))
            if not len(there):
                out[name] = (lead + len(x), None, a, b, 0, 0) if first is None else (lead, first, a, b, nulls + len(x), seen)
                continue
            if first is None:
                lead, first = lead + int(there[0]), float(x[there[0]])
                a, b, nulls, x = 1.0, 0.0, 0, x[there[0] + 1 :]
            if len(x) and not np.isnan(x).all():
                b = float(follow(b, nulls, x, alpha)[-1])
                a = float(follow(a, nulls, np.where(np.isnan(x), np.nan, 0.0), alpha)[-1])
                nulls = len(x) - 1 - int(np.flatnonzero(~np.isnan(x))[-1])
            else:
                nulls += len(x)
            out[name] = (lead, first, a, b, nulls, seen + len(there))
        return out

    def advance(state, summary):
        after = {}
        for name, (_, alpha, _) in specs.items():
            (mean, nulls, seen), (lead, first, a, b, trailing, values) = state[name], summary[name]
            if first is None:
                after[name] = (mean, nulls + lead, seen)
            else:
                y = first if mean is None else float(follow(mean, nulls + lead, np.array([first]), alpha)[-1])
                after[name] = (a * y + b, trailing, seen + values)
        return after

    def step(state, part):
        columns, after = {}, {}
        for name, (column, alpha, least) in specs.items():
            mean, nulls, seen = state[name]
            x = part[column].to_numpy(np.float64, na_value=np.nan)
            y = follow(mean, nulls, x, alpha)
            there = ~np.isnan(x)
            count = seen + np.cumsum(there)
            last = np.flatnonzero(there)
            columns[name] = np.where(count >= least, y, np.nan)
            after[name] = (float(y[-1]), len(x) - 1 - last[-1], int(count[-1])) if len(last) else (mean, nulls + len(x), seen)
        return after, columns

    block_us = block_us or int(DAY_US * block_setting(df, "days"))
    block = F.floor(F.unix_micros(F.col(order).cast("timestamp")) / block_us) if block_us else None
    return blocked_stream(df, [order], block, begin, summarize, advance, step, ", ".join(f"{name} double" for name in specs))


def first_free(df: DataFrame, start_col: str, end_col: str, cooldown_col: str, order: str, keys: list[str] | None = None, block_bars: int | None = None) -> DataFrame:
    """Add `kept`: taken greedily, a row stays if it starts later than the last one kept ended, plus its cooldown.

    Before any row stayed the last end counts as -1, so a cooldown also holds back the first rows.
    """

    def free_at(part):
        """A row stays if the last end is before this."""
        return part[start_col].to_numpy(np.int64) - part[cooldown_col].to_numpy(np.int64), part[end_col].to_numpy(np.int64)

    def summarize(summary, part):
        free, end = free_at(part)
        return (free, end) if summary is None else (np.concatenate([summary[0], free]), np.concatenate([summary[1], end]))

    def jumps(free, end):
        """(bounds, last ends): of a last end below a bound, the first such, comes that last end after the block."""
        after = end.copy()
        follower = np.maximum(np.searchsorted(free, end, "right"), np.arange(1, len(free) + 1))
        for i in range(len(free) - 1, -1, -1):
            if follower[i] < len(free):
                after[i] = after[follower[i]]
        ends = np.flatnonzero(np.append(after[1:] != after[:-1], True))
        return free[ends], after[ends]

    def advance(last, summary):
        free, end = summary
        if np.any(free[1:] < free[:-1]):  # cooldowns that differ along a series
            for f, e in zip(free.tolist(), end.tolist(), strict=True):
                last = e if f > last else last
            return last
        bounds, after = jumps(free, end)
        i = int(np.searchsorted(bounds, last, "right"))
        return int(after[i]) if i < len(bounds) else last

    def step(last, part):
        kept = []
        for f, e in zip(*(x.tolist() for x in free_at(part)), strict=True):
            kept.append(f > last)
            last = e if kept[-1] else last
        return last, {"kept": np.array(kept, bool)}

    block_bars = block_bars or int(block_setting(df, "bars"))
    block = F.floor(F.col(start_col) / block_bars) if block_bars else None
    return blocked_stream(df, [order], block, lambda: -1, summarize, advance, step, "kept boolean", keys)
