"""Leaf-wise boosted trees on histograms, fitted on distributed rows.

Inputs are cut into at most BINS bins once. Every pass over the rows adds up gradients, second derivatives and counts by
(leaf, input, bin): a task reduces its rows to one histogram a leaf and input, and only sums of these reach the driver, which
picks the splits. A pass serves every leaf that may be split next, so a tree takes as many passes as it is deep, not one
a split. Trees grow best first to `leaves` leaves.

Sums are of whole numbers (multiples of 2^-30), so the trees do not depend on partitions, retries or the order of tasks; they stay exact
up to 8 * 10^9 rows. Rows are kept as packed blocks in a written table with the score that they have from all trees up to
then; it is written anew every REWRITE trees, and later trees are applied as a block is read. A lost executor costs its tasks of one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

BINS = 255
BIN_ROWS = 200_000  # rows that the bins are cut from: those that come first by a hash
UNIT = float(1 << 30)
REWRITE = 20
DRIVER_BYTES = 64 << 20  # histograms of single tasks that may meet on the driver; beyond, Spark adds them up first
LEAST_HESSIAN = 1e-3
BLOCK_SCHEMA = "bins binary, target binary, score binary"


def bin_edges(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Upper edges of all bins but the last: midpoints of few values, or midpoint percentiles."""
    distinct = np.unique(values)
    if len(distinct) <= bins:
        return (distinct[:-1] + distinct[1:]) * 0.5
    return np.unique(np.percentile(values, np.linspace(0, 100, bins + 1)[1:-1], method="midpoint"))


@dataclass
class Node:
    """sums: gradient, second derivative, rows; a split when edge is set: bin <= edge goes left."""

    sums: tuple[int, int, int]
    feature: int = -1
    edge: int = -1
    gain: float = 0.0
    left: int = -1
    right: int = -1
    known: bool = False
    parts: tuple = ()


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays; feature is -1 at leaves."""

    feature: np.ndarray
    edge: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """bins: inputs by rows."""
        at = np.zeros(bins.shape[1], np.int32)
        while True:
            live = np.flatnonzero(self.feature[at] >= 0)
            if not len(live):
                return at
            node = at[live]
            at[live] = np.where(bins[self.feature[node], live] <= self.edge[node], self.left[node], self.right[node])


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    rate: float = 0.05
    leaves: int = 15
    least_rows: int = 100
    l2: float = 1.0


@dataclass(frozen=True)
class BoostedTrees:
    features: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    base: float
    trees: tuple[Tree, ...] = field(repr=False)

    def bins_of(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x, "left").astype(np.uint8) for e, x in zip(self.edges, columns, strict=True)])

    def raw(self, columns: list[np.ndarray]) -> np.ndarray:
        bins = self.bins_of(columns)
        out = np.full(bins.shape[1], self.base)
        for t in self.trees:
            out += t.value[t.leaf_of(bins)]
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """Rows with probability_up, null where eligible is false."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def probability(x: pd.DataFrame) -> pd.Series:
            z = shared.value.raw([x[c].to_numpy(float) for c in x.columns])
            return pd.Series(1 / (1 + np.exp(-z)))

        inputs = F.struct(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(self.features)])
        return rows.withColumn("probability_up", F.when(F.col("eligible"), probability(inputs)))

    def table(self) -> list[tuple]:
        """(round, node, feature, threshold, left, right, value) of every node; of leaves the value, of others the split."""
        out = []
        for k, t in enumerate(self.trees):
            for i, f in enumerate(t.feature.tolist()):
                split = f >= 0
                out.append((k, i, self.features[f] if split else None, float(self.edges[f][t.edge[i]]) if split else None, *((int(t.left[i]), int(t.right[i]), None) if split else (None, None, float(t.value[i])))))
        return out


def cut_bins(train: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Edges of each input, from all rows up to BIN_ROWS; one group an input."""
    key = F.xxhash64(*features)
    sample = train.select(*features).orderBy(key, *features).limit(BIN_ROWS)
    long = sample.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).cast("double").alias("x")) for i, f in enumerate(features)])).alias("s")).select("s.*")

    def edges(key, rows):
        return pd.DataFrame({"i": [key[0]], "edges": [bin_edges(rows["x"].to_numpy()).tolist()]})

    found = {r["i"]: np.array(r["edges"], float) for r in long.groupBy("i").applyInPandas(edges, "i int, edges array<double>").collect()}
    return [found[i] for i in range(len(features))]


def pack(train: DataFrame, features: list[str], edges: list[np.ndarray], base: float) -> DataFrame:
    """Blocks of rows: bins (inputs by rows, a byte each), targets and scores."""
    shared = train.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                bins = np.stack([np.searchsorted(e, x, "left").astype(np.uint8) for e, x in zip(shared.value, columns[1:], strict=True)])
                yield _block(bins, columns[0].astype(np.uint8), np.full(b.num_rows, base))

    doubles = [F.col(f).cast("double").alias(f) for f in features]
    return train.select(F.col("target_up").cast("double").alias("target_up"), *doubles).mapInArrow(run, BLOCK_SCHEMA)


def _block(bins: np.ndarray, target: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, target, score)], ["bins", "target", "score"])


def _blocks(batches, trees: list[Tree], inputs: int):
    for b in batches:
        for bins, target, score in zip(*(c.to_pylist() for c in b.columns), strict=True):
            bins = np.frombuffer(bins, np.uint8).reshape(inputs, -1)
            score = np.frombuffer(score, float).copy()
            for t in trees:
                score += t.value[t.leaf_of(bins)]
            yield bins, np.frombuffer(target, np.uint8), score


def gradients(score: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the logistic loss, as whole multiples of 2^-30."""
    p = 1 / (1 + np.exp(-score))
    return np.rint((p - target) * UNIT), np.rint(p * (1 - p) * UNIT)


def histogram(bins: np.ndarray, slot: np.ndarray, slots: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums by (slot, input, bin): gradient, second derivative, rows. Rows of slot -1 count nowhere."""
    own = np.flatnonzero(slot >= 0)
    g, h, at = g[own], h[own], slot[own].astype(np.int64) * 256
    out = np.zeros((slots, len(bins), 256, 3), np.int64)
    for f in range(len(bins)):
        key = at + bins[f, own]
        for k, w in enumerate((g, h, None)):
            out[:, f, :, k] = np.bincount(key, w, slots * 256).reshape(slots, 256)
    return out


def add_up(blocks: DataFrame, trees: list[Tree], route: Tree, slot_of: np.ndarray, slots: int, inputs: int) -> np.ndarray:
    """One pass over the rows: histograms of the leaves of `route` that have a slot."""
    spec = "slot int, feature int, sums binary"
    shared = blocks.sparkSession.sparkContext.broadcast((trees, route, slot_of))

    def run(batches):
        earlier, tree, slot = shared.value
        total = None
        for bins, target, score in _blocks(batches, earlier, inputs):
            part = histogram(bins, slot[tree.leaf_of(bins)], slots, *gradients(score, target))
            total = part if total is None else total + part
        if total is not None:
            for s in range(slots):
                yield pa.RecordBatch.from_arrays([pa.array([s] * inputs, pa.int32()), pa.array(range(inputs), pa.int32()), pa.array([x.tobytes() for x in total[s]], pa.binary())], ["slot", "feature", "sums"])

    def add(key, rows):
        total = sum(np.frombuffer(x, np.int64) for x in rows.column("sums").to_pylist())
        return pa.table({"slot": [key[0].as_py()], "feature": [key[1].as_py()], "sums": [total.tobytes()]}, schema=pa.schema([("slot", pa.int32()), ("feature", pa.int32()), ("sums", pa.binary())]))

    parts = blocks.mapInArrow(run, spec)
    if blocks.rdd.getNumPartitions() * slots * inputs * 256 * 24 > DRIVER_BYTES:
        parts = parts.groupBy("slot", "feature").applyInArrow(add, spec)
    out = np.zeros((slots, inputs, 256 * 3), np.int64)
    for r in parts.collect():
        out[r["slot"], r["feature"]] += np.frombuffer(r["sums"], np.int64)
    shared.unpersist()
    return out.reshape(slots, inputs, 256, 3)


def best_split(node: Node, sums: np.ndarray, edges: list[np.ndarray], s: Settings) -> None:
    """Set the node's split of highest gain, ties to the first input and the lowest edge; none without gain."""
    node.known = True
    g, h, n = (float(node.sums[0]) / UNIT, float(node.sums[1]) / UNIT, node.sums[2])
    for f, e in enumerate(edges):
        if not len(e):
            continue
        left = np.cumsum(sums[f, : len(e)], axis=0)
        lg, lh, ln = left[:, 0] / UNIT, left[:, 1] / UNIT, left[:, 2]
        rg, rh, rn = (node.sums[0] - left[:, 0]) / UNIT, (node.sums[1] - left[:, 1]) / UNIT, n - ln
        gain = lg * lg / (lh + s.l2) + rg * rg / (rh + s.l2) - g * g / (h + s.l2)
        gain[(ln < s.least_rows) | (rn < s.least_rows) | (lh < LEAST_HESSIAN) | (rh < LEAST_HESSIAN)] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] > node.gain:
            rest = (node.sums[0] - int(left[k, 0]), node.sums[1] - int(left[k, 1]), int(rn[k]))
            node.feature, node.edge, node.gain, node.parts = f, k, float(gain[k]), ((int(left[k, 0]), int(left[k, 1]), int(ln[k])), rest)


def arrays(nodes: list[Node], s: Settings) -> Tree:
    inner = [n.left >= 0 for n in nodes]
    value = [0.0 if i else -s.rate * (n.sums[0] / UNIT) / (n.sums[1] / UNIT + s.l2) for n, i in zip(nodes, inner, strict=True)]
    col = lambda name: np.array([getattr(n, name) if i else -1 for n, i in zip(nodes, inner, strict=True)], np.int32)
    return Tree(col("feature"), col("edge"), col("left"), col("right"), np.array(value))


def grow(sums_of, edges: list[np.ndarray], s: Settings) -> Tree:
    """One tree, best first. sums_of(route, leaves) gives the histograms of leaves of a routing tree: one pass over the rows.

    `nodes` holds every node that a pass has met, split or not yet; a pass looks at the children of all leaves that could be
    split next, so what is popped afterwards is mostly known.
    """
    nodes = [Node((0, 0, 0))]

    def learn(unknown: list[int]) -> None:
        for i, sums in zip(unknown, sums_of(arrays(nodes, s), unknown), strict=True):
            if i == 0:
                nodes[0].sums = tuple(int(x) for x in sums[0].sum(axis=0))
            best_split(nodes[i], sums, edges, s)

    def children(i: int) -> list[int]:
        n = nodes[i]
        if n.left < 0:
            n.left, n.right = len(nodes), len(nodes) + 1
            nodes.extend(Node(p) for p in n.parts)
        return [n.left, n.right]

    def pending(i: int) -> bool:
        n = nodes[i]
        if not n.known and n.sums[2] and (n.sums[2] < 2 * s.least_rows or n.sums[1] / UNIT < LEAST_HESSIAN):
            n.known = True  # too few rows to be split
        return not n.known

    learn([0])
    leaves, taken = [0], set()
    while len(leaves) < s.leaves:
        unknown = [i for i in leaves if pending(i)]
        if unknown:
            ahead = [c for i in leaves if nodes[i].known and nodes[i].gain > 0 for c in children(i) if pending(c)]
            learn(sorted({*unknown, *ahead}))
            continue
        best = max(leaves, key=lambda i: (nodes[i].gain, -i))
        if nodes[best].gain <= 0:
            break
        leaves.remove(best)
        leaves += children(best)
        taken.add(best)
    # What was looked at ahead but not taken goes.
    order = [0]
    for i in order:
        if i in taken:
            order += [nodes[i].left, nodes[i].right]
    number = {i: k for k, i in enumerate(order)}
    kept = []
    for i in order:
        n = nodes[i]
        kept.append(Node(n.sums, n.feature, n.edge, n.gain, number[n.left], number[n.right]) if i in taken else Node(n.sums))
    return arrays(kept, s)


def fit_trees(train: DataFrame, features: list[str], s: Settings = Settings()) -> BoostedTrees:
    """train: rows without missing inputs, with target_up 0 or 1."""
    train = written(train.select("target_up", *features), "boosting")
    known = train.agg(F.count(F.lit(1)).alias("n"), F.sum("target_up").alias("up")).first()
    if not known["n"] or not 0 < known["up"] < known["n"]:
        raise ValueError("boosting needs rows of both targets")
    rate = known["up"] / known["n"]
    base = float(np.log(rate / (1 - rate)))
    edges = cut_bins(train, features)
    blocks = written(pack(train, features, edges, base), "boosting")
    trees: list[Tree] = []
    recent: list[Tree] = []
    inputs = len(features)

    def sums_of(route: Tree, leaves: list[int]) -> np.ndarray:
        slot_of = np.full(len(route.feature), -1, np.int32)
        slot_of[leaves] = np.arange(len(leaves))
        return add_up(blocks, recent, route, slot_of, len(leaves), inputs)

    for _ in range(s.rounds):
        trees.append(grow(sums_of, edges, s))
        recent = [*recent, trees[-1]]
        if len(recent) == REWRITE:
            blocks, recent = written(_rescored(blocks, recent, inputs), "boosting"), []
    return BoostedTrees(tuple(features), tuple(edges), base, tuple(trees))


def _rescored(blocks: DataFrame, trees: list[Tree], inputs: int) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for bins, target, score in _blocks(batches, shared.value, inputs):
            yield _block(bins, target, score)

    return blocks.mapInArrow(run, BLOCK_SCHEMA)
