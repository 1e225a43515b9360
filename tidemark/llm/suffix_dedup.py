"""Suffix-array dedup over bytes: remove what LENGTH-byte strings cover that also start earlier.

Depth-limited radix sort, most significant digit first. Suffixes are ordered only through
LENGTH bytes; after that many, equal groups are exactly the repeated strings. The first digit
is the suffix's anchor, a gram chosen by content, and its place (see anchors), so the shuffle by it
deals out runs of suffixes instead of one row per byte; anchors that occur once are dropped at
once, and runs that are equal as a whole go on as one, their later copies settled by an aggregate
with partial minima. Within an anchor and place suffixes are sorted by digits of DIGIT bytes, as
big-endian numbers, from the first byte on; groups of one are dropped after each pass.

The passes over an anchor with up to GATHERED different runs take place in one task's arrays. A larger one is dealt out by more
of its text first: a run is cut into blocks of neighbouring places, and a block is dealt by the bytes that all windows of those places
share. Blocks equal as a whole go on as one, blocks that share those bytes with none are dropped, and blocks get shorter until at most GATHERED share them. What is
larger after the shortest blocks is taken as single suffixes by Spark's passes: each groups by the next WIDE bytes, counts with
partial aggregates, and drops groups of one, so a string of any number of copies is a count and a join that adaptive execution splits.
A run becomes a few blocks where it used to become a row for each of its suffixes. All bytes of suffixes and blocks are compared;
runs that are equal as a whole are found by a 64-bit hash of their bytes, anchor and place.

Defined cases: null text is empty; a text shorter than LENGTH loses nothing; rows that repeat
a doc_id are documents of their own, ordered as the table's splits and rows are; a null doc_id comes
before all others; overlaps count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import anchors as A
from tidemark.llm.common import Workspace, lean
from tidemark.llm.hashing import decompress

LENGTH = 100
GRAM = 28
DIGIT = 8
WIDE = 32  # bytes of a pass over tasks
GATHERED = 1024
RUNS_AT_ONCE = 4096


def digits(text: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes (DIGIT at most) at each place as a number, first byte most significant."""
    out = np.zeros(len(at), np.uint64)
    for i in range(size):
        out = out << np.uint64(8) | text[at + i]
    return out


def radix_groups(text: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes equal through `length` bytes, in order: (indices into at, group numbers), groups of one left out.

    text: joined bytes. at: where each suffix begins. group: the first digit.
    """
    alive = np.arange(len(at))
    for depth in range(0, length, DIGIT):
        value = digits(text, at[alive] + depth, min(DIGIT, length - depth))
        order = np.lexsort((value, group))
        g, v = group[order], value[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
        number = np.cumsum(new) - 1
        several = np.bincount(number, minlength=1)[number] > 1
        alive, group = alive[order[several]], number[several]
        if not len(alive):
            break
    return alive, group


def _sort_runs(length: int):
    """From runs (a, d, k, at, no, bytes) sorted by anchor: spans (k, at, n) of suffixes that start earlier too."""
    names = ["k", "at", "n"]

    def settle(rows):
        a, d, k, at, no = (np.array([r[i] for r in rows], np.int64) for i in range(5))
        raw = [r[5] for r in rows]
        begin = np.cumsum([0, *map(len, raw[:-1])])
        n, place = no >> A.PLACE_BITS, no & ((1 << A.PLACE_BITS) - 1)
        ends = np.cumsum(n)
        step = np.arange(ends[-1]) - np.repeat(ends - n, n)
        run = np.repeat(np.arange(len(rows)), n)
        anchor = np.cumsum(np.append(True, a[1:] != a[:-1]))[run]
        group = anchor * (1 << A.PLACE_BITS) + place[run] - step  # equal suffixes have the anchor at the same place
        alive, same = radix_groups(np.frombuffer(b"".join(raw), np.uint8), begin[run] + step, group, length)
        if not len(alive):
            return None
        order = np.lexsort((at[run[alive]] + step[alive], k[run[alive]], d[run[alive]], same))
        alive, same = alive[order], same[order]
        late = alive[np.append(False, same[1:] == same[:-1])]  # all but the first of each group
        late.sort()
        new = np.ones(len(late), bool)
        new[1:] = (late[1:] != late[:-1] + 1) | (run[late[1:]] != run[late[:-1]])
        first = np.flatnonzero(new)
        head = late[first]
        return pa.RecordBatch.from_arrays(
            [pa.array(k[run[head]]), pa.array(at[run[head]] + step[head]), pa.array(np.diff(first, append=len(late)))], names)

    def work(batches):
        waiting = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("a", "d", "k", "at", "no", "bytes")), strict=True):
                if len(waiting) >= RUNS_AT_ONCE and row[0] != waiting[-1][0]:
                    if (out := settle(waiting)) is not None:
                        yield out
                    waiting = []
                waiting.append(row)
        if waiting and (out := settle(waiting)) is not None:
            yield out

    return work


def _neighbours(batches):
    """Spans (k, at, n) of neighbouring places (k, at), which come in order."""
    for b in batches:
        k, at = b.column("k").to_numpy(), b.column("at").to_numpy()
        first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1))) if len(k) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(at[first]), pa.array(np.diff(first, append=len(k)))], ["k", "at", "n"])


def later_suffixes(suffixes: DataFrame, length: int, work: Workspace, wide: int = WIDE) -> DataFrame:
    """Spans (k, at, n) of all but the first of suffixes (a, place, bytes, d, k, at) that are equal: passes by digits of `wide` bytes, groups of one dropped after each."""
    alive, before = suffixes, None
    group = ["a", "place", "digits"]
    for end in [*range(wide, length, wide), length]:
        keyed = alive.withColumn("digits", F.substring("bytes", 1, end))
        counted = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *([F.min(F.struct("d", "k", "at")).alias("first")] if end == length else [])).filter("n > 1").drop("n")
        counted = work.write(counted, f"digits{end}")
        kept = keyed.join(counted.hint("merge"), group)
        if end < length:
            alive = work.write(kept.select(*suffixes.columns), f"pass{end}")
            work.drop(f"digits{end}", *([before] if before else []))
            before = f"pass{end}"
    late = kept.filter(F.struct("d", "k", "at") != F.col("first")).select("k", "at")
    return late.repartition("k").sortWithinPartitions("k", "at").mapInArrow(lean(_neighbours), "k long, at long, n long")


def _cut_runs(length: int):
    """The bytes of the runs in items (a, at, no), one row a run."""
    names = ["a", "no", "bytes", "d", "k", "at"]

    def run(batches):
        for b in batches:
            out = [[] for _ in names]
            for k, d, z, items in zip(*(b.column(c).to_pylist() for c in A.ROW), A.item_arrays(b.column("items")), strict=True):
                text = decompress(z)
                for a, at, no in items.tolist():
                    for column, value in zip(out, (a, no, text[at : at + (no >> A.PLACE_BITS) - 1 + length], d, k, at), strict=True):
                        column.append(value)
                    if len(out[0]) > RUNS_AT_ONCE:
                        yield batch(out)
                        out = [[] for _ in names]
            yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i == 2 else pa.int64()) for i, x in enumerate(out)], names)

    return run


def cut_runs(texts: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    lists = A.by_text(runs, "a", "at", "no")
    return texts.join(lists.hint("merge"), "k").select(*A.ROW, "items").mapInArrow(lean(_cut_runs(length)), "a long, no long, bytes binary, d long, k long, at long")


def block_sizes(span: int) -> list[int]:
    """Places of a block, level by level, for windows that have their anchor at one of `span` places."""
    out = [4]
    while out[0] * 8 <= span:
        out.insert(0, out[0] * 4)
    return out if span >= 8 else []


def blocks(runs: DataFrame, size: int, length: int) -> DataFrame:
    """Runs (a, no, bytes, d, k, at) cut where the place of the anchor passes a multiple of `size`; a: hash of the old one, the block's number, and what all windows of its places share."""
    place, n = F.col("no").bitwiseAND((1 << A.PLACE_BITS) - 1), F.shiftright("no", A.PLACE_BITS)
    rows = runs.withColumn("top", place).withColumn("low", place - n + 1)
    rows = rows.withColumn("block", F.explode(F.sequence(F.expr(f"low DIV {size}"), F.expr(f"top DIV {size}"))))
    rows = rows.withColumn("skip", F.expr(f"top - least(top, block * {size} + {size - 1})"))
    rows = rows.withColumn("top", F.expr("top - skip")).withColumn("low", F.expr(f"greatest(low, block * {size})"))
    shared = f"substring(bytes, cast(skip + top - block * {size} + 1 AS int), {length - size + 1})"
    return rows.selectExpr(
        f"xxhash64(a, block, {shared}) AS a", f"shiftleft(top - low + 1, {A.PLACE_BITS}) | top AS no",
        f"substring(bytes, cast(skip + 1 AS int), cast(top - low + {length} AS int)) AS bytes", "d", "k", "at + skip AS at")


def single_suffixes(runs: DataFrame, length: int) -> DataFrame:
    """The suffixes (a, place, bytes, d, k, at) of runs."""
    rows = runs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("no", A.PLACE_BITS) - 1)))
    return rows.selectExpr("a", f"(no & {(1 << A.PLACE_BITS) - 1}) - i AS place", f"substring(bytes, cast(i + 1 AS int), {length}) AS bytes", "d", "k", "at + i AS at")


def later_copies(rows: DataFrame, groups: DataFrame, content: str) -> DataFrame:
    """Spans (k, at, n) of the runs that are equal, as a whole, to an earlier one; groups: context_groups of rows."""
    copies = groups.filter("n > 1").select("a", content, "no", F.col("k").alias("k0"), F.col("at").alias("at0"))
    whole = rows.join(copies.hint("merge"), ["a", content, "no"]).filter("k <> k0 OR at <> at0")
    return whole.select("k", "at", F.shiftright("no", A.PLACE_BITS).alias("n"))


def earlier_spans(texts: DataFrame, scheme: A.Scheme, work: Workspace, gathered: int = GATHERED) -> DataFrame:
    """(k, items of (at, n)): runs of suffixes that start earlier too."""
    length = scheme.length
    rows = A.repeated_anchors(texts, scheme, work)
    groups = work.write(A.context_groups(rows), "groups")
    spans = work.write(later_copies(rows, groups, "c"), "whole")
    work.drop("repeated")
    part = work.write(A.shared_anchors(groups, work).select("a", "k", "at", "no", "others"), "part")
    work.drop("groups", "shared")

    def settled(few: DataFrame, name: str) -> DataFrame:
        return work.write(few.repartition("a").sortWithinPartitions("a").mapInArrow(lean(_sort_runs(length)), "k long, at long, n long"), name)

    spans = spans.unionByName(settled(cut_runs(texts, part.filter(F.col("others") <= gathered), length), "settled"))
    large = part.filter(F.col("others") > gathered)
    if large.isEmpty():
        return work.write(A.by_text(spans, "at", "n"), "spans")
    large, before = work.write(cut_runs(texts, large, length), "large"), ["large"]
    for size in block_sizes(length - scheme.gram + 1):
        rows = work.write(blocks(large, size, length), f"blocks{size}")
        groups = work.write(A.context_groups(rows, "bytes"), f"groups{size}")
        spans = spans.unionByName(work.write(later_copies(rows, groups, "bytes"), f"whole{size}"))
        part = work.write(A.shared_anchors(groups, work, f"shared{size}"), f"part{size}")
        work.drop(*before, f"blocks{size}", f"groups{size}", f"shared{size}")
        spans = spans.unionByName(settled(part.filter(F.col("others") <= gathered), f"settled{size}"))
        large, before = part.filter(F.col("others") > gathered), [f"part{size}"]
        if large.isEmpty():
            break
    else:
        suffixes = work.write(single_suffixes(large, length), "suffixes")
        spans = spans.unionByName(work.write(later_suffixes(suffixes, length, work), "later"))
        work.drop("suffixes")
    work.drop(*before)
    return work.write(A.by_text(spans, "at", "n"), "spans")


def remove_earlier(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, gathered: int = GATHERED, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with_text the kept bytes)."""
    scheme = A.Scheme("bytes", length, min(gram, length))
    work = Workspace(docs.sparkSession, "suffix_dedup")
    texts = A.store_texts(docs, work)
    spans = earlier_spans(texts, scheme, work, gathered)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def cut(batches):
        for b in batches:
            out = [[] for _ in names]
            for doc_id, z, items in zip(b.column("doc_id").to_pylist(), b.column("z").to_pylist(), A.item_arrays(b.column("items")), strict=True):
                text = decompress(z)
                gone = A.covered(items, len(text), length)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text
                runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                for column, value in zip(out, (doc_id, len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=False)], names)

    joined = texts.join(spans.hint("merge"), "k", "left").select("doc_id", "z", "items")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return joined.mapInArrow(lean(cut), schema)
