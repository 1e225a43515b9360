import pytest

from tidemark.llm import mixing


def targets_by_loop(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Share by weight, stop at the caps, reshare the excess until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        rest = total - sum(full.values())
        given = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if given[s] > cap * sizes[s]]
        if not above:
            return full | given
        full |= {s: cap * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 5, "d": 70}, {"a": 1, "b": 0, None: 500, "z": 20, "m": 20},
    {f"s{i}": 100 + 7 * i for i in range(20)},
])
def test_targets(spark, sizes):
    table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    want = targets_by_loop(sizes)
    assert got == pytest.approx(want)


def test_taken_comes_near_targets_and_reruns_agree(docs):
    rows = [(i, "w " * (1 + i % 50), "en", ["x", "y", None][min(2, i % 5)]) for i in range(600)]
    plan = [r.asDict() for r in mixing.mix_plan(docs(rows)).collect()]
    again = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(docs(rows[::-1])).collect()}
    assert {r["doc_id"]: r["copies"] for r in plan} == again
    for source in ("x", "y", None):
        own = [r for r in plan if r["source"] == source]
        assert sum(r["size"] * r["copies"] for r in own) == pytest.approx(own[0]["target"], rel=0.05)
        assert all(0 <= r["copies"] <= 2 for r in own)


def test_odd_rows(spark, docs):
    assert mixing.mix(docs([])).count() == 0
    odd = docs([(None, None), (1, ""), (1, "a b"), (1, "a b"), (2, "c " * 5000, None, "s")])
    clash = odd.selectExpr("*", "1 AS size", "2 AS copies", "3 AS draws", "4 AS target", "5 AS base")
    plan = mixing.mix_plan(clash)
    assert plan.count() == 5
    assert mixing.mix(clash).columns == clash.columns
