import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk


def brute(rows, k):
    ok = [(v, [math.floor(64 * x) for x in e]) for v, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (q, a) in enumerate(ok):
        if q is not None and q % 20 == 0:
            scores = [(-sum(x * y for x, y in zip(a, b, strict=False)), math.inf if v is None else v) for j, (v, b) in enumerate(ok) if j != i]
            out += [(q, r + 1, None if v == math.inf else v, -s) for r, (s, v) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def check(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k).collect()), key=str)
    assert got == brute(rows, k)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BATCH", 16)
    monkeypatch.setattr(topk, "SLICE_ROWS", 90)
    monkeypatch.setattr(topk, "BLOCK_VALUES", 24 * 5)
    monkeypatch.setattr(topk, "SEED_VALUES", 24 * 40)
    rows = [(i, [math.sin(i * (j + 1)) * (1 + i % 7) for j in range(24)]) for i in range(300)]
    rows += [(500 + i, rows[i % 3][1]) for i in range(40)]
    check(spark, rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 0.0]), (80, [float("inf"), 0.0]), (None, [1.0, 2.0]),
            (0, [1.0, 2.0]), (3, []), (4, [1e12, -1e12, 3.0]), (100, [1e7, 1e7, 1e7]), (5, [0.0, 0.0])]
    check(spark, rows)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).count() == 0


def spread_norms(r):
    return r.standard_normal((3000, 48)) * np.exp(1.2 * r.standard_normal((3000, 1)))


def clustered(r):
    centres = r.standard_normal((20, 48))
    return centres[r.integers(0, 20, 3000)] + 0.1 * r.standard_normal((3000, 48))


@pytest.mark.parametrize("made", [spread_norms, clustered])
def test_most_pairs_are_never_multiplied(made):
    """One block meets all vectors by descending length: fewer than half of all pairs reach a whole product, and results stay exact."""
    ints = np.floor(64 * made(np.random.default_rng(2)))
    norms = np.sqrt((ints**2).sum(1))
    order = np.argsort(-norms, kind="stable")
    ids, q = np.arange(len(ints)), np.arange(0, len(ints), 20)
    turn = np.linalg.svd(ints, full_matrices=True)[2].T
    block = topk.Block(q, q, ints[q], norms[q], np.full(len(q), -np.inf), turn, 16, 20)
    for i in range(0, len(order), 250):
        some = order[i : i + 250]
        if not block.meet(ids[some], ids[some], ints[some], norms[some]):
            break
    assert block.multiplied < 0.5 * len(q) * len(ints)
    scores = ints[q] @ ints.T
    scores[np.arange(len(q)), q] = -np.inf
    for i in range(len(q)):
        best = np.lexsort((ids, -scores[i]))[:20]
        assert block.found[i] == [(-int(scores[i, j]), j, j) for j in best]


def test_the_given_vectors_are_pruned(spark):
    """With the thresholds that a tenth of the vectors gives, fewer than half of all pairs of the given table get a whole product."""
    rows = topk.integer_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).toPandas().sort_values("norm", ascending=False, kind="stable")
    ids, norms = rows["vec_id"].to_numpy(), rows["norm"].to_numpy()
    ints = topk._matrix([*rows["ints"]], len(rows["ints"].iloc[0]) // 8)
    q = np.flatnonzero(ids % 20 == 0)
    seeds = ints[q] @ ints[: len(ids) // 10].T
    seeds[q[:, None] == np.arange(len(ids) // 10)] = -np.inf
    least = np.sort(seeds, axis=1)[:, -20]
    block = topk.Block(ids[q], ids[q], ints[q], norms[q], least, np.linalg.svd(ints[:4096], full_matrices=True)[2].T, topk.HEAD, 20)
    for i in range(0, len(ids), topk.BATCH):
        if not block.meet(*(x[i : i + topk.BATCH] for x in (ids, ids, ints, norms))):
            break
    assert block.multiplied < 0.5 * len(q) * len(ids)
    assert topk.steps(64, 16) == [(0, 16), (16, 32), (32, 40), (40, 48), (48, 56), (56, 60), (60, 64)]
    for dim in (1, 2, 3, 7, 24, 48, 100):
        cut = topk.steps(dim, min(16, dim))
        assert cut[0][0] == 0 and cut[-1][1] == dim and all(a < b for a, b in cut) and [b for _, b in cut[:-1]] == [a for a, _ in cut[1:]]
