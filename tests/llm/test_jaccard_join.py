import random

import numpy as np
import pytest

from tidemark.llm import jaccard_join as J
from tidemark.llm.common import Workspace
from tidemark.llm.components import components


def brute(rows, gram=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + gram]) for i in range(max(1, len(w) - gram + 1))} if w else set())
    n = len(rows)
    link = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold] for i in range(n)]
    out, seen = [None] * n, set()
    for i in range(n):
        if i not in seen:
            group, front = {i}, [i]
            while front:
                front = [k for j in front for k in link[j] if k not in group and not group.add(k)]
            seen |= group
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            for j in group:
                out[j] = (rows[j][0], min(ids, default=None), len(link[j]))
    return sorted(out, key=str)


def corpus(seed, n=80):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = (r.choice(rows)[1] or "x").split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = r.choices(vocab, k=r.choice([1, 2, 4, 5, 30, 80, 150]))
        rows.append((i, " ".join(w)))
    return rows + [(500, None), (501, ""), (502, " \n"), (None, rows[0][1]), (3, rows[3][1]), (503, "z " * 40_000)]


@pytest.mark.parametrize("seed,block,homes", [(1, 2048, 32), (2, 3, 32), (3, 3, 1)])
def test_equals_brute_force(docs, monkeypatch, seed, block, homes):
    monkeypatch.setattr(J, "BLOCK_CLASSES", block)
    monkeypatch.setattr(J, "WIDE_HOMES", homes)
    rows = corpus(seed)
    got = J.jaccard_join(docs(rows).selectExpr("*", "1 AS uid", "2 AS bands"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_one_of_each_group_stays(docs):
    rows = corpus(4)
    df = docs(rows).selectExpr("*", "1 AS uid", "2 AS bands")
    kept = J.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in brute(rows)})
    assert J.drop_near_duplicates(docs([])).count() == 0
    assert J.jaccard_join(docs([])).count() == 0


def test_banding_reaches_recall():
    bands, rows = J.bands_for(0.8, 0.9999, 200)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 200
    r = random.Random(1)
    hits = 0
    for _ in range(100):
        common, a, b = (np.array([r.getrandbits(64) for _ in range(k)], np.uint64) for k in (400, 50, 50))
        s = J.signatures([np.concatenate([common, a]), np.concatenate([common, b])], bands, rows)
        hits += bool((s[0] == s[1]).any())
    assert hits >= 99


def test_pairs_at_the_threshold_are_found(docs):
    """400 pairs of similarity 0.8 to 0.82 among other texts: all are linked, and nothing else is."""
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(5000)]
    rows = []
    for i in range(400):
        w = r.choices(vocab, k=80)  # 76 n-grams; 8 new words at the end leave 68 common of 84
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-8] + r.choices(vocab, k=8)))]
    got = {d: (c, n) for d, c, n in J.jaccard_join(docs(rows)).collect()}
    assert got == {i: (i - i % 2, 1) for i in range(800)}


def test_matrix_product_is_exact():
    r = np.random.RandomState(3)
    sets = [np.unique(r.randint(0, 300, 200).astype(np.uint64)) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = J.intersections(sets)
    np.fill_diagonal(got, 0)
    np.fill_diagonal(want := np.array(want), 0)
    assert (got == want).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 70), (200, 200)]
    work = Workspace(spark, "test_components")
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(edges, "a long, b long"), work, "c").collect()}
    assert got == {i: 1 for i in range(2, 41)} | {70: 50, 100: 50}
