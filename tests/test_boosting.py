import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import boosting, models, search
from tidemark.plans.boosting import Settings, bin_edges, fit_trees
from tidemark.queries import dense

UNIT = 2.0**30


def plain_trees(x, y, s):
    """The same trees row by row: x rows by inputs. Yields (feature, threshold, left, right, value) lists in breadth-first order."""
    edges = [bin_edges(c) for c in x.T]
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT)

        def best(rows):
            found = (0.0, None, None)
            if len(rows) < 2 * s.least_rows:
                return found
            total = g[rows].sum() / UNIT, h[rows].sum() / UNIT
            for f, e in enumerate(edges):
                for t in e:
                    left = x[rows, f] <= t
                    n = left.sum()
                    if n < s.least_rows or len(rows) - n < s.least_rows:
                        continue
                    lg, lh = g[rows][left].sum() / UNIT, h[rows][left].sum() / UNIT
                    rg, rh = g[rows][~left].sum() / UNIT, h[rows][~left].sum() / UNIT
                    gain = lg * lg / (lh + s.l2) + rg * rg / (rh + s.l2) - total[0] * total[0] / (total[1] + s.l2)
                    if lh >= 1e-3 and rh >= 1e-3 and gain > found[0]:
                        found = (gain, f, t)
            return found

        nodes = [[np.arange(len(y)), best(np.arange(len(y))), None]]
        leaves = [0]
        while len(leaves) < s.leaves:
            i = max(leaves, key=lambda k: (nodes[k][1][0], -k))
            rows, (gain, f, t), _ = nodes[i]
            if gain <= 0:
                break
            left = x[rows, f] <= t
            nodes[i][2] = (len(nodes), len(nodes) + 1)
            leaves.remove(i)
            leaves += nodes[i][2]
            nodes += [[r, best(r), None] for r in (rows[left], rows[~left])]
        order = [0]
        for i in order:
            order += nodes[i][2] or ()
        out = []
        for i in order:
            rows, (_, f, t), parts = nodes[i]
            if parts:
                out.append((f, t, order.index(parts[0]), order.index(parts[1]), None))
            else:
                value = -s.rate * (g[rows].sum() / UNIT) / (h[rows].sum() / UNIT + s.l2)
                score[rows] += value
                out.append((None, None, None, None, value))
        yield out


def assert_same_trees(model, x, y, s):
    names = list(model.features)
    for k, tree in enumerate(plain_trees(x, y, s)):
        mine = [(None if r[2] is None else names.index(r[2]), *r[3:]) for r in model.table() if r[0] == k]
        assert [r[:4] for r in mine] == [r[:4] for r in tree], k
        assert np.allclose([r[4] or 0 for r in mine], [r[4] or 0 for r in tree], rtol=1e-12), k
    assert len(model.trees) == s.rounds


def table(spark, rows, seed, parts):
    pick = np.random.RandomState(seed)
    x = np.column_stack([pick.normal(size=rows), pick.randint(0, 5, rows).astype(float), np.exp(pick.normal(size=rows)), np.zeros(rows)])
    y = (x[:, 0] + 0.5 * (x[:, 1] == 2) - 0.3 * x[:, 2] + pick.normal(size=rows) > 0).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, d double, target_up double")
    return df.repartition(parts), x, y


@pytest.mark.parametrize("parts", [1, 7])
def test_trees_equal_a_plain_version(spark, parts, monkeypatch):
    df, x, y = table(spark, 900, 1, parts)
    s = Settings(rounds=5, leaves=9, least_rows=20)
    monkeypatch.setattr(boosting, "REWRITE", 2)
    if parts == 7:
        monkeypatch.setattr(boosting, "DRIVER_BYTES", 0)  # Spark adds the tasks' histograms up
    model = fit_trees(df, ["a", "b", "c", "d"], s)
    assert_same_trees(model, x, y, s)
    got = model.transform(df.withColumn("eligible", F.col("b") < 4)).select("a", "b", "c", "d", "probability_up").toPandas()
    assert (got["probability_up"].isna() == (got["b"] >= 4)).all()
    score = model.raw([got[c].to_numpy() for c in "abcd"])
    known = got["probability_up"].notna()
    assert np.allclose(got["probability_up"][known], 1 / (1 + np.exp(-score[known])))
    assert ((score[known] > 0) == ((got["a"] + 0.5 * (got["b"] == 2) - 0.3 * got["c"])[known] > 0)).mean() > 0.7


def test_passes_follow_depth_not_splits(spark, monkeypatch):
    df, *_ = table(spark, 3000, 2, 4)
    passes = []
    monkeypatch.setattr(boosting, "add_up", lambda *a, f=boosting.add_up: passes.append(1) or f(*a))
    model = fit_trees(df, ["a", "b", "c"], Settings(rounds=1, leaves=15, least_rows=30))
    leaves = sum(f < 0 for f in model.trees[0].feature.tolist())
    assert leaves == 15 and len(passes) < 12


def test_what_cannot_be_learned_from(spark):
    df, *_ = table(spark, 50, 3, 2)
    model = fit_trees(df, ["a", "b"], Settings(rounds=2))
    assert [len(t.feature) for t in model.trees] == [1, 1]  # too few rows for two leaves
    assert len({r["probability_up"] for r in model.transform(df.withColumn("eligible", F.lit(True))).collect()}) == 1
    for empty in (df.filter("target_up = 1"), df.limit(0)):
        with pytest.raises(ValueError, match="both targets"):
            fit_trees(empty, ["a", "b"], Settings(rounds=1))


def test_the_query_s_table(spark):
    """All rounds of the protocol on the table of boosted_trees."""
    rows = models.prepare(search.split_slices(dense(spark, "/root/testdata/sf0.01")), models.FROZEN_EXPIRY).filter("slice = 'development'")
    data = rows.filter("eligible AND target_up IS NOT NULL").select("target_up", *models.ML_FEATURES).toPandas().to_numpy()
    assert_same_trees(models.fit_boosted(rows), data[:, 1:], data[:, 0], Settings())


def test_boosted_experiment(spark):
    """The protocol's steps with boosted trees: the chosen cell is the best of its development scores."""
    bars = dense(spark, "/root/testdata/sf0.01")
    got = models.run_model_experiment(bars, "boosted", expiries=(2, 3), min_trades=5, min_resolved=5, rounds=3)
    assert got["status"] in ("no_development_candidate", "rejected_validation", "passed_locked", "failed_locked")
    if "best" in got:
        assert got["best"]["expiry_bars"] in (2, 3) and got["best"]["threshold"] in models.THRESHOLDS


def test_logistic_weights_are_where_the_gradient_vanishes(spark):
    """The loss is convex, so a vanishing gradient of the penalised loss is the optimum."""
    rows = models.prepare(dense(spark, "/root/testdata/sf0.01"), 3)
    model = models.fit_logistic(rows)
    data = rows.filter("eligible AND target_up IS NOT NULL").select("target_up", *models.ML_FEATURES).toPandas().to_numpy()
    x, y = (data[:, 1:] - np.array(model.mean)) / np.array(model.scale), data[:, 0]
    assert np.allclose(x.mean(axis=0), 0, atol=1e-9) and np.allclose(x.std(axis=0)[x.std(axis=0) > 0], 1)
    p = 1 / (1 + np.exp(-(x @ np.array(model.weights) + model.intercept)))
    slope = np.append(x.T @ (p - y) + np.array(model.weights), (p - y).sum()) / len(y)
    assert np.abs(slope).max() < 2e-3 < np.abs(x.T @ (y.mean() - y) / len(y)).max()
    got = model.transform(rows).filter("eligible AND target_up IS NOT NULL").select("probability_up").toPandas()["probability_up"].to_numpy()
    assert np.allclose(np.sort(got), np.sort(p))
