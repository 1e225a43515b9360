"""Exact dedup over a persistent digest index.

The index holds one row per distinct text, bucketed and sorted by digest. A batch is first reduced to
one winner per digest (partial aggregation runs before the shuffle, so a group of copies of any size
costs each map task one row) and dealt to the index's buckets; sort-merge anti-joins, which read the
index bucket by bucket without an exchange or a sort of its own, leave the winners whose text is new, and these are
appended. Digests, ids and lengths are all that is shuffled; texts are not.

The index is a folder. Every append is a run, a folder of its own with one sorted file a bucket; after MOST_RUNS
appends the runs are written anew as one. `log` has a row for each write (generation, run, buckets, folder, batch), and only
folders that it names are read: a write that breaks off before its log row has never happened. The
stored number of buckets holds whenever the index is opened; another can be had by rebucket() only.

Batches. Each row has the id of the batch that brought it, and rows of the same batch count as new. So a job that
appended its texts, was lost before its result was written, and runs again under the same id keeps what it kept the first time.

Defined cases: null text counts as empty; texts without a visible character are all equal;
null doc_id loses a tie against any other; rows that repeat a doc_id and text count as copies
in group_size and are reported alike; an empty table gives an empty result; further columns
pass through filter_duplicates() and may have any name.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, Workspace, delete, exists, free_name, release, splits

INDEX_SCHEMA = "digest string, keep_id long, keep_chars int, copies long, batch string"
LOG_SCHEMA = "generation int, run int, buckets int, folder string, batch string"
BUCKETS = 64
MOST_RUNS = 8


def digest(text):
    """SHA-256 of the text without white space, in lowercase hex."""
    return F.sha2(F.encode(F.translate(F.coalesce(text, F.lit("")), SPACES, ""), "UTF-8"), 256)


@contextmanager
def sorted_buckets(spark: SparkSession):
    """While it lasts, joins rely on the order within a bucket's one file instead of sorting it again."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class DigestIndex:
    """Digests seen so far, kept in `path`; opening an existing path goes on from its rows.

    buckets: for a new index (BUCKETS if not given); for an existing one it must be left out or equal the stored number.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.tables, self.batches = spark, path, [], set()
        if exists(spark, f"{path}/log/_SUCCESS"):
            log = spark.read.schema(LOG_SCHEMA).parquet(f"{path}/log").orderBy("generation", "run").collect()
            self.batches = {r["batch"] for r in log}
            last = [r for r in log if r["generation"] == log[-1]["generation"]]
            self.generation, self.buckets, self.runs = last[0]["generation"], last[0]["buckets"], [r["folder"] for r in last]
            if buckets not in (None, self.buckets):
                raise ValueError(f"the index has {self.buckets} buckets, not {buckets}; rebucket() changes that")
        else:
            self.generation, self.buckets, self.runs = 0, buckets or BUCKETS, [self._folder()]
            self._log(self.runs[0], None)
        for folder in self.runs:
            self._open(folder)

    @staticmethod
    def _folder() -> str:
        return f"run-{uuid.uuid4().hex}"

    def _log(self, folder: str, batch: str | None) -> None:
        row = self.spark.createDataFrame([(self.generation, self.runs.index(folder), self.buckets, folder, batch)], LOG_SCHEMA)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        self.batches.add(batch)

    def _open(self, folder: str) -> str:
        table = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {table} ({INDEX_SCHEMA}) USING parquet OPTIONS (path '{self.path}/{folder}') "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )
        self.tables.append(table)
        return table

    def _write(self, folder: str, rows: DataFrame) -> None:
        """One sorted file a bucket."""
        table = self._open(folder)
        columns = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
        rows.select(*columns).repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(table)
        self.spark.catalog.refreshTable(table)

    def rows(self) -> DataFrame:
        return reduce(DataFrame.union, [self.spark.table(t) for t in self.tables])

    def _others(self, table: str, batch: str | None) -> DataFrame:
        rows = self.spark.table(table)
        return rows.filter(F.col("batch") != batch) if batch in self.batches and batch is not None else rows

    def fresh(self, winners: DataFrame, batch: str | None = None) -> DataFrame:
        """The winners whose digest the index lacks, or has from this batch. To be computed within sorted_buckets()."""
        out = winners.repartition(self.buckets, "digest")
        for t in self.tables:
            out = out.join(self._others(t, batch).hint("merge"), "digest", "left_anti")
        return out

    def earlier(self, winners: DataFrame, batch: str | None = None) -> DataFrame:
        """The index's own rows of the winners' digests, but this batch's."""
        dealt = winners.select("digest").repartition(self.buckets, "digest")
        return reduce(DataFrame.union, [dealt.join(self._others(t, batch).hint("merge"), "digest") for t in self.tables])

    def append(self, fresh: DataFrame, batch: str | None = None) -> None:
        """Append rows that fresh() gave, once a batch: with its log row a run is there as a whole or not at all."""
        if batch is not None and batch in self.batches:
            return
        batch = batch or uuid.uuid4().hex
        folder = self._folder()
        self._write(folder, fresh.withColumn("batch", F.lit(batch)))
        self.runs.append(folder)
        self._log(folder, batch)
        if len(self.runs) > MOST_RUNS:
            self.rebucket(self.buckets)

    def rebucket(self, buckets: int) -> None:
        """Write all rows anew as one run. Readers of the runs before must have ended."""
        before = self.runs
        there = [p for p in (f"{self.path}/{f}" for f in before) if exists(self.spark, p)]
        rows = self.spark.read.schema(INDEX_SCHEMA).parquet(*there)
        self.close()
        self.generation, self.buckets, self.runs = self.generation + 1, buckets, [self._folder()]
        self._write(self.runs[0], rows)
        self._log(self.runs[0], None)
        for folder in before:
            delete(self.spark, f"{self.path}/{folder}")

    def close(self) -> None:
        """Forget the catalog entries; the files stay for the next session."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = []


def winners(digests: DataFrame, *more: str) -> DataFrame:
    """Per digest the row that stays: most code points, then smallest doc_id, null last, then `more`, which are kept too."""
    best = F.min(F.struct((-F.col("chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", *more))
    return (
        digests.groupBy("digest").agg(best.alias("b"), F.count(F.lit(1)).alias("copies"))
        .select("digest", F.col("b.doc_id").alias("keep_id"), (-F.col("b.n")).alias("keep_chars"), "copies", *[F.col(f"b.{c}").alias(c) for c in more])
    )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    group_size counts the batch's copies. With an index that already has the text from another batch, keep_id is
    the earlier document and nothing of the batch is kept. Without an index a fresh one is built. batch: an id under
    which a job may run again; without one every call is a batch of its own.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "exact_dedup")
    digests = work.write(
        docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("chars"), digest(F.col("text")).alias("digest")),
        "digests",
    )
    known = index or DigestIndex(spark, f"{work.path}/index", max(8, splits(docs)))
    best = work.write(winners(digests), "winners") if index else winners(digests)
    with sorted_buckets(spark):
        fresh = work.write(known.fresh(best, batch), "fresh")
    sized = fresh.select("digest", "keep_id", "keep_chars", F.col("copies").alias("group_size"), F.lit(True).alias("new"))
    if index:
        old = known.earlier(best, batch).select("digest", "keep_id", "keep_chars")
        with sorted_buckets(spark):
            old = work.write(old.join(best.select("digest", F.col("copies").alias("group_size")), "digest").withColumn("new", F.lit(False)), "old")
        sized = sized.unionByName(old)
    known.append(fresh, batch)
    if not index:
        known.close()
    out = digests.join(sized.hint("merge"), "digest").select(
        "doc_id", "keep_id", "group_size",
        (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    release(spark)
    return out


def filter_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows that stay, with all their columns; texts that the index has from other batches go too.

    Of rows that repeat one doc_id and text, one stays: the winner is chosen among rows, not
    ids. Rows get their ids by being written once, so a task that runs again sees the same ones.
    Copies are ranked on narrow rows; only one row id per distinct text meets the texts.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "exact_dedup")
    row = free_name(docs.columns, "row_id")
    rows = work.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    digests = rows.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("chars"), digest(F.col("text")).alias("digest"), F.col(row).alias("row"))
    known = index or DigestIndex(spark, f"{work.path}/index", max(8, splits(docs)))
    with sorted_buckets(spark):
        fresh = work.write(known.fresh(winners(digests, "row"), batch), "fresh")
    known.append(fresh, batch)
    if not index:
        known.close()
    return rows.join(fresh.select(F.col("row").alias(row)).hint("merge"), row, "left_semi").drop(row)
