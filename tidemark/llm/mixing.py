"""Mixing sources to target weights.

Sizes are summed per source before anything is shuffled, targets are found on the table of
sources (one row each), and each document is then emitted floor(rate) times plus one copy
drawn by a hash-seeded Bernoulli trial whose probability is the fraction of the rate, where
rate = target / size of its source. To bring what a source yields near its target, the trial
of a source uses whichever of SEEDS fixed seeds comes closest; all seeds are tried in one
pass. The same rows give the same mix in any order and on any partitioning.

Defined cases: null text has size 0; null source is a source, ordered last; a source of size
0 has target 0 and yields no words; rows that repeat a doc_id draw alike; a null doc_id draws
as the empty string; an empty table gives an empty mix. Columns of the caller pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, Workspace, free_name, join_checked

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEEDS = 16


def words(text) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draws(doc_id) -> Column:
    """SEEDS numbers in [0, 1) for a document: eight hex digits of an MD5 each."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    parts = []
    for s in range(SEEDS):
        digest = F.md5(F.concat(F.lit(f"{s // 4}|"), key).cast("binary"))
        parts.append(F.conv(F.substring(digest, 1 + 8 * (s % 4), 8), 16, 10).cast("double") / F.lit(2.0**32))
    return F.array(*parts)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add `target` to (source, source_size): share of all sizes by weight, at most cap times each size.

    Filling by weight until the caps hold is one level L with target = min(cap * size, L * weight).
    In ascending order of cap * size / weight, L is fixed by the first source that is not capped:
    running sums give each source's level if all before it are capped, and of the levels that
    leave their source below its cap the first is the largest. The window spans the table of
    sources, one row each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    table = sizes.withColumn("weight", weight).withColumn("limit", F.lit(cap) * F.col("source_size"))
    filled = Window.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    rest_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    rest_words = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(filled), F.lit(0.0))
    table = table.withColumn("level", rest_words / rest_weight)
    open_level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(every)
    level = F.coalesce(open_level, F.lit(float("inf")))
    return table.select("source", "source_size", F.least("limit", level * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, size: str | None = None) -> DataFrame:
    """All columns of docs plus size, source_size, target, copies (how often the mix emits the row).

    size names a column of sizes; without it the words of text are counted. Sizes are written once, for three passes.
    """
    sized = docs
    if size is None:
        size = free_name(docs.columns, "size")
        sized = docs.withColumn(size, words(F.col("text")))
    docs = sized
    draw, extra = (free_name(docs.columns, n) for n in ("draws", "fraction"))
    work = Workspace(docs.sparkSession, "mixing")
    sized = work.write(docs, "sized")
    sums = sized.groupBy("source").agg(F.sum(size).alias("source_size"))
    rates = targets(sums, weights, share, cap).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )
    rates = work.write(rates.withColumn("base", F.floor("rate")).withColumn(extra, F.col("rate") - F.floor("rate")), "rates")
    narrow = join_checked(sized.select("source", size, draws("doc_id").alias(draw)), rates, ["source"])
    hits = [F.sum(F.when(F.col(draw)[s] < F.col(extra), F.col(size)).otherwise(0)).alias(f"s{s}") for s in range(SEEDS)]
    sampled = narrow.groupBy("source").agg(F.first("source_size").alias("n"), F.first(extra).alias("f"), *hits)
    off = F.array_min(F.array(*[
        F.struct(F.abs(F.col(f"s{s}") - F.col("f") * F.col("n")).alias("off"), F.lit(s).alias("seed")) for s in range(SEEDS)
    ]))
    seeds = work.write(sampled.select("source", off["seed"].alias("seed")), "seeds")
    rates = join_checked(rates, seeds, ["source"])
    rates = rates.select(
        "source", *[F.col(c).alias(free_name(docs.columns, c)) for c in ("source_size", "target", "base", "seed")],
        F.col(extra).alias(extra),
    )
    base, seed = free_name(docs.columns, "base"), free_name(docs.columns, "seed")
    out = join_checked(sized, rates, ["source"])
    drawn = F.element_at(draws("doc_id"), F.col(seed) + 1) < F.col(extra)
    return out.withColumn(free_name(docs.columns, "copies"), F.col(base) + drawn.cast("int")).drop(base, seed, extra)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mixed documents with the columns of docs; a document appears as often as the plan says."""
    copies = free_name([*docs.columns, free_name(docs.columns, "size")], "copies")
    plan = mix_plan(docs, weights, share, cap).filter(F.col(copies) > 0)
    return plan.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
