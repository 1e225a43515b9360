import hashlib
import re

import pytest

from tidemark.llm import exact_dedup
from tidemark.llm.common import Workspace
from tidemark.llm.exact_dedup import DigestIndex


def test_one_row_stays_of_equal_texts(docs):
    rows = [(3, "a b"), (2, "ab"), (9, "a  b"), (5, None), (4, " \t"), (7, "é b"), (None, "a  b"), (8, "éb\x0b")]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(rows)).collect()}
    assert len(got) == 8
    assert {k: r["keep_id"] for k, r in got.items()} == {3: 9, 2: 9, 9: 9, None: 9, 5: 4, 4: 4, 7: 7, 8: 7}
    assert [k for k, r in got.items() if r["kept"]] == [k for k in got if k in (9, 4, 7)]
    assert got[9]["group_size"] == 4
    for doc_id, text in rows:
        assert got[doc_id]["text_sha256"] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()


def test_index_lives_on_between_sessions(spark, docs, monkeypatch):
    """Appends, a reopened index, another bucket count, compaction: never a digest twice."""
    monkeypatch.setattr(exact_dedup, "MOST_RUNS", 3)
    path = f"{Workspace(spark, 'test_index').path}/index"
    index = DigestIndex(spark, path, 4)
    assert exact_dedup.exact_dedup(docs([(1, "x"), (2, "y")]), index).filter("kept").count() == 2
    index.close()

    with pytest.raises(ValueError, match="4 buckets"):
        DigestIndex(spark, path, 16)
    again = DigestIndex(spark, path)
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs([(3, "x "), (4, "z"), (5, "zz"), (6, "z z")]), again).collect()}
    assert (got[3]["keep_id"], got[3]["kept"], got[3]["group_size"]) == (1, False, 1)
    assert (got[6]["keep_id"], got[6]["kept"]) == (6, True) and not got[5]["kept"] and got[4]["kept"]

    exact_dedup.exact_dedup(docs([(7, "u")]), again).collect()  # the third write compacts
    assert (again.generation, len(again.runs)) == (1, 1)
    again.rebucket(16)
    again.close()
    last = DigestIndex(spark, path)
    assert last.buckets == 16 and last.rows().count() == last.rows().select("digest").distinct().count() == 5
    assert exact_dedup.exact_dedup(docs([(8, "x"), (9, "u"), (10, "new")]), last).filter("kept").count() == 1
    assert exact_dedup.filter_duplicates(docs([(11, "new"), (12, "newer"), (13, "newer")]), last).select("doc_id").collect() == [(12,)]
    last.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_index_is_neither_shuffled_nor_sorted(spark, docs):
    path = f"{Workspace(spark, 'test_index').path}/index"
    index = DigestIndex(spark, path, 4)
    for k in range(3):
        exact_dedup.exact_dedup(docs([(i, f"text {i}") for i in range(50 * k, 50 * k + 60)]), index).count()
    best = Workspace(spark, "test_index").write(exact_dedup.winners(docs([(1, "x")]).selectExpr("doc_id", "1 AS chars", "text AS digest")), "best")

    def counted():
        with exact_dedup.sorted_buckets(spark):
            plan = index.fresh(best)._jdf.queryExecution().executedPlan().toString()
        return plan.count("SortMergeJoin"), plan.count("Exchange"), plan.count("Sort [")

    assert counted() == (4, 1, 1)  # the batch alone
    index.rebucket(4)
    assert counted() == (1, 1, 1)
    index.close()


def test_a_batch_that_runs_again_keeps_what_it_kept(spark, docs):
    index = DigestIndex(spark, f"{Workspace(spark, 'test_index').path}/index", 4)
    exact_dedup.exact_dedup(docs([(1, "x")]), index, "monday").count()
    table = docs([(2, "x"), *[(i, f"t{i % 15}") for i in range(10, 30)]])
    first = sorted(exact_dedup.exact_dedup(table, index, "tuesday").collect())
    assert sum(r["kept"] for r in first) == 15
    index.close()
    again = DigestIndex(spark, index.path)
    assert sorted(exact_dedup.exact_dedup(table, again, "tuesday").collect()) == first
    again.rebucket(8)
    assert sorted(exact_dedup.exact_dedup(table, again, "tuesday").collect()) == first
    assert exact_dedup.filter_duplicates(table, again, "tuesday").count() == 15
    assert again.rows().count() == 16
    assert exact_dedup.filter_duplicates(table, again, "wednesday").count() == 0 and exact_dedup.filter_duplicates(table, again).count() == 0
    again.close()


@pytest.mark.parametrize("work", ["append", "rebucket"])
def test_a_write_that_breaks_off_before_its_log_row_never_was(spark, docs, monkeypatch, work):
    index = DigestIndex(spark, f"{Workspace(spark, 'test_index').path}/index", 4)
    exact_dedup.exact_dedup(docs([(i, f"t{i}") for i in range(20)]), index, "a").count()

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken, pytest.raises(RuntimeError):
        broken.setattr(DigestIndex, "_log", lost)
        index.rebucket(4) if work == "rebucket" else exact_dedup.exact_dedup(docs([(50, "new")]), index, "b")
    index.close()
    again = DigestIndex(spark, index.path)
    assert again.rows().count() == 20
    again.rebucket(4)
    assert again.rows().count() == again.rows().select("digest").distinct().count() == 20
    assert exact_dedup.exact_dedup(docs([(50, "new")]), again, "b").filter("kept").count() == 1
    again.close()


def test_filter_keeps_rows_and_columns(spark, docs):
    df = docs([(1, "a"), (1, "a"), (2, " a"), (None, None), (7, "")]).selectExpr("*", "1 AS row_id", "'q' AS digest")
    got = exact_dedup.filter_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(2, " a"), (7, "")]
    assert exact_dedup.filter_duplicates(docs([])).count() == 0
    assert exact_dedup.exact_dedup(docs([])).count() == 0


def test_index_remembers_earlier_batches(spark, docs):
    index = DigestIndex(spark, f"{Workspace(spark, 'test_index').path}/index", 4)
    first = exact_dedup.exact_dedup(docs([(1, "x"), (2, "y")]), index)
    assert sorted((r["doc_id"], r["kept"]) for r in first.collect()) == [(1, True), (2, True)]
    index.close()
    again = DigestIndex(spark, index.path, 4)
    second = exact_dedup.exact_dedup(docs([(0, "x"), (3, "z"), (4, "z")]), again)
    assert sorted((r["doc_id"], r["keep_id"], r["kept"], r["group_size"]) for r in second.collect()) == [(0, 1, False, 1), (3, 3, True, 2), (4, 3, False, 2)]
    assert again.rows().count() == 3


def test_filter_keeps_one_of_repeated_rows(spark, docs):
    rows = docs([(1, "a"), (1, "a"), (2, "b"), (3, None), (4, ""), (5, "q" * 300_000), (6, "q" * 300_000 + " ")])
    kept = exact_dedup.filter_duplicates(rows.selectExpr("*", "7 AS row_id", "8 AS digest"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 6]
    assert kept.columns == [*rows.columns, "row_id", "digest"]
    assert exact_dedup.filter_duplicates(docs([])).count() == 0
    assert exact_dedup.exact_dedup(docs([])).count() == 0
