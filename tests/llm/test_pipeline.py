import re
from collections import Counter

import corpus_pipeline as P
from tidemark.llm.common import Workspace

SF = "/root/testdata/sf0.001"


def test_stages_agree_with_brute_force(spark):
    from tests.llm.test_jaccard_join import brute
    from tests.llm.test_mixing import targets_by_loop

    work, rows = Workspace(spark, "test_pipeline"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        before = docs
        docs = work.write(stage(spark, docs, SF), name)
        rows[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "exact_dedup":
            best = {}
            for r in before.collect():
                key = "".join(c for c in r["text"] if c not in " \t\n\x0b\x0c\r")
                best[key] = min(best.get(key, (0, float("inf"))), (-len(r["text"]), r["doc_id"]))
            assert {r["doc_id"] for r in rows[name]} == {d for _, d in best.values()}
        if name == "ngram_jaccard_join":
            assert {r["doc_id"] for r in rows[name]} == {c for _, c, _ in brute([(r["doc_id"], r["text"]) for r in before.collect()])}
        if name == "source_mixing":
            size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in before.collect()}
            source = {r["doc_id"]: r["source"] for r in before.collect()}
            copies = Counter(r["doc_id"] for r in rows[name])
            sums, taken = Counter(), Counter()
            for d, n in size.items():
                sums[source[d]] += n
                taken[source[d]] += n * copies[d]
            for s, target in targets_by_loop(dict(sums)).items():
                rate = target / sums[s]
                assert {copies[d] for d in size if source[d] == s} <= {int(rate), int(rate) + 1} if rate < 2 else {2}
                assert abs(taken[s] - target) <= 0.05 * target + max(n for d, n in size.items() if source[d] == s)
            assert {*copies} <= {*size}
        if name == "best_fit_packing":
            assert sum(r["piece"] == 0 for r in rows[name]) == before.count()
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "source_mixing", "best_fit_packing"]
    assert len(rows["language_id"]) >= 0.99 * spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sorted(map(tuple, P.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows["best_fit_packing"])


def test_empty_table(spark, docs):
    empty = docs([])
    for name, stage in P.STAGES[:-1]:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0, name
    assert P.STAGES[-1][1](spark, docs([]), SF).count() == 0


def test_only_unknown_languages_go(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    long = spark.read.parquet(f"{SF}/documents.parquet").filter("lang IS NOT NULL AND text IS NOT NULL")
    short = long.withColumns({"doc_id": -F.col("doc_id") - 1, "text": F.substring_index("text", " ", 2)})
    rows = long.unionByName(short).filter("text RLIKE '[a-zA-Z]'")
    assert P.known_language(spark, rows, SF).count() == rows.count()
    unsure = lambda d, model: d.withColumns({"lang_pred": F.when(F.col("doc_id") == 3, "und").otherwise("en"), "score": F.when(F.col("doc_id") == 3, 0.0).otherwise(0.26)})
    monkeypatch.setattr(P.language_id, "predict", unsure)
    kept = P.known_language(spark, docs([(1, "a b", "en"), (2, "ein Satz", "de"), (3, "1 2", "en")]), SF)
    assert [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == [1, 2]
