"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

The n-grams of a text are the sets of GRAM consecutive words; a text of fewer words, but one at
least, has one n-gram, all its words. Texts with equal sets form one class, and only one text
per class goes on. Its signature is cut into bands, whose number and rows follow from the
threshold and the recall wanted; classes are shuffled by band hashes, and only buckets of
several classes go on.

Pairs that share a bucket are verified in cells of bounded size. A class's home is the largest
bucket it is in; a home of many classes is cut into blocks of about BLOCK_CLASSES by hash. Two blocks
that meet in some bucket have a cell, to which each of their classes goes that meets the other
block in a bucket of its own: a pair has one cell, whatever number of bands it shares, so links
are counted once, and classes that only a chain of others connects never meet. A bucket with
classes of more than WIDE_HOMES homes has cells of its own instead, by blocks of its classes;
pairs that share such buckets are counted in the least of them. In a cell sets become rows of a
0/1 matrix over n-grams (equal columns joined, with weights), and matrix products give the
intersections. A cell sends back per class its number of links and one tie per connected class,
never its pairs; sums and components of these give the result.

Links are counted between documents: n_links is the number of other documents of similarity
THRESHOLD or more, copies included. class_id is the least doc_id of the documents that links connect.

Defined cases: null or empty texts have no n-grams, no links and a class of their own; rows
that repeat are linked like copies; a null doc_id is never a class_id unless the class has no
other; texts are read whole at any length; an empty table gives an empty result; other columns
pass through drop_near_duplicates() under their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing as H
from tidemark.llm.common import Workspace, by_bytes, free_name, lean
from tidemark.llm.components import components

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 200
BLOCK_CLASSES = 512
BLOCK_GRAMS = 400_000
WIDE_HOMES = 32
COLUMNS_AT_ONCE = 2048
ROWS_AT_ONCE = 128


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows within `most` hashes at which a pair at the threshold shares a band with probability recall."""
    best = None
    for rows in range(1, most + 1):
        share = threshold**rows
        bands = 1 if share >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - share))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no banding within that many hashes reaches the recall")
    return best


def gram_set(text: str | bytes | None, gram: int = GRAM) -> np.ndarray:
    """Sorted hashes of the distinct n-grams."""
    tokens = H.tokens_of(text.encode() if isinstance(text, str) else text or b"", "words")
    n = len(tokens)
    if n == 0:
        return tokens
    start = np.arange(max(1, n - gram + 1))
    return np.unique(H.Rolling(tokens).span(start, np.minimum(start + gram, n)) + np.uint64(min(n, gram)))


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes (one row per set, none empty) of the minima of bands * rows hash functions."""
    joined = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    random = np.random.RandomState(11)
    out = np.zeros((len(sets), bands), np.uint64)
    spread, buffer = joined ^ (joined >> np.uint64(32)), np.empty_like(joined)
    for band in range(bands):
        for _ in range(rows):
            factor = np.uint64(int(random.randint(0, 2**62)) * 2 + 1)
            np.multiply(spread, factor, out=buffer)
            out[:, band] = H.mix(out[:, band] ^ np.minimum.reduceat(buffer, first)) + np.uint64(band)
    return out.view(np.int64)


def signed_rows(docs: DataFrame, work: Workspace, gram: int, bands: int, rows: int) -> DataFrame:
    """docs with uid, set_hash (null without n-grams), set_size and bands, written: later steps refer to uid."""
    names = ["uid", "set_hash", "set_size", "bands"]
    assert not {*names} & {*docs.columns}

    def run(batches):
        for b in by_bytes(batches, "text", 1 << 20):
            sets = [gram_set(t, gram) for t in b.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            hashes: list = [None] * len(sets)
            signed: list = [None] * len(sets)
            if full:
                for i, s in zip(full, signatures([sets[i] for i in full], bands, rows), strict=True):
                    hashes[i], signed[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), s
            added = [pa.array(hashes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*b.schema.names, *names[1:]])

    numbered = docs.withColumn("uid", F.monotonically_increasing_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    return work.write(numbered.mapInArrow(lean(run), f"{fields}, set_hash binary, set_size long, bands array<long>"), "rows")


def blocks_of(n: str, grams: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / BLOCK_CLASSES), F.ceil(F.col(grams) / BLOCK_GRAMS)).cast("int")


def own_block(uid: str, blocks) -> Column:
    return F.pmod(F.xxhash64(uid), blocks).cast("int")


def cells(classes: DataFrame, work: Workspace) -> DataFrame:
    """Rows (uid, wide, cells): what each class that shares a bucket needs; a cell is (bucket, lo, hi, own).

    Here and below aggregates are written before a join with them: then both sides of the join are
    plain exchanges, and adaptive execution splits a hot bucket. What is collected for a class is
    at most one bucket a band, or the cells that it goes to.
    """
    all_hits = classes.select("uid", "set_size", F.explode("bands").alias("bucket"))
    sizes = all_hits.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("set_size").alias("grams")).filter("n > 1")
    sizes = work.write(sizes, "buckets")
    hits = work.write(all_hits.select("uid", "bucket").join(sizes.hint("merge"), "bucket"), "hits")
    home = F.max(F.struct("n", "grams", "bucket")).alias("home")
    homes = hits.groupBy("uid").agg(home, F.collect_list(F.struct("bucket", "n", "grams")).alias("hits")).select(
        "uid", "hits", F.col("home.bucket").alias("home"), own_block("uid", blocks_of("home.n", "home.grams")).alias("part")
    )
    homes = work.write(homes.select("uid", "hits", "home", F.xxhash64("home", "part").alias("block")), "homes")
    work.drop("hits")

    met = homes.select(F.explode("hits.bucket").alias("bucket"), "home", "block").distinct()
    met = work.write(met, "met")
    count = met.groupBy("bucket", "home").count().groupBy("bucket").agg(F.sum("count").alias("blocks"), F.count(F.lit(1)).alias("homes"))
    several = work.write(count.filter("blocks > 1").drop("blocks"), "several")
    narrow = several.filter(F.col("homes") <= WIDE_HOMES).select("bucket")
    lists = met.join(narrow.hint("merge"), "bucket", "left_semi").groupBy("bucket").agg(F.collect_list("block").alias("blocks"))
    wide = several.filter(F.col("homes") > WIDE_HOMES).select("bucket", F.lit(True).alias("is_wide"))
    marks = work.write(lists.unionByName(wide, allowMissingColumns=True), "marks")

    spread = homes.select("uid", "block", F.explode("hits").alias("hit")).select("uid", "block", "hit.*")
    marked = spread.join(marks.hint("merge"), "bucket")
    own = own_block("uid", blocks_of("n", "grams"))
    in_wide = F.transform(
        F.sequence(F.lit(0), blocks_of("n", "grams") - 1),
        lambda i: F.struct(F.col("bucket").alias("bucket"), F.least(own, i).cast("long").alias("lo"), F.greatest(own, i).cast("long").alias("hi"), own.cast("long").alias("own")),
    )
    in_narrow = F.transform(
        "blocks",
        lambda x: F.struct(F.lit(0).cast("long").alias("bucket"), F.least("block", x).alias("lo"), F.greatest("block", x).alias("hi"), F.col("block").alias("own")),
    )
    wanted = marked.select("uid", F.when(F.col("is_wide"), F.col("bucket")).alias("wide"), F.when(F.col("is_wide"), in_wide).otherwise(in_narrow).alias("cells"))
    # Every class also goes to the cell of its own block.
    alone = homes.select("uid", F.lit(None).cast("long").alias("wide"), F.array(F.struct(
        F.lit(0).cast("long").alias("bucket"), F.col("block").alias("lo"), F.col("block").alias("hi"), F.col("block").alias("own"))).alias("cells"))
    per_class = wanted.unionByName(alone).groupBy("uid").agg(
        F.array_sort(F.collect_list("wide")).alias("wide"), F.array_distinct(F.flatten(F.collect_list("cells"))).alias("cells")
    )
    return work.write(per_class, "cells")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    held = np.diff(start, append=len(values))
    # N-grams that the same sets hold are one column; a random sum over its sets tells columns apart.
    mark = np.random.RandomState(5).randint(1, 2**62, m).astype(np.uint64)
    sums = np.add.reduceat(mark[owner], start)
    shared = held > 1
    _, at, weight = np.unique(sums[shared], return_index=True, return_counts=True)
    start, held = start[shared][at], held[shared][at]
    out = np.zeros((m, m), np.float64)
    for c in range(0, len(start), COLUMNS_AT_ONCE):
        s, h, w = start[c : c + COLUMNS_AT_ONCE], held[c : c + COLUMNS_AT_ONCE], weight[c : c + COLUMNS_AT_ONCE]
        ends = np.cumsum(h)
        inside = np.repeat(s - (ends - h), h) + np.arange(ends[-1])
        kind = np.float32 if w.sum() < 1 << 24 else np.float64  # whole numbers below 2**24 are exact in the first
        matrix = np.zeros((m, len(s)), kind)
        matrix[owner[inside], np.repeat(np.arange(len(s)), h)] = 1
        out += (matrix * w.astype(kind)) @ matrix.T
    return out


def links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold; no set is linked with itself."""
    size = np.array([len(s) for s in sets], np.float64)
    both = intersections(sets)
    linked = np.empty(both.shape, bool)
    for r in range(0, len(sets), ROWS_AT_ONCE):
        rows = both[r : r + ROWS_AT_ONCE]
        linked[r : r + ROWS_AT_ONCE] = rows / (size[r : r + ROWS_AT_ONCE, None] + size[None, :] - rows) >= threshold
    np.fill_diagonal(linked, False)
    return linked


def least_connected(linked: np.ndarray) -> np.ndarray:
    """Per row of a symmetric link matrix the least index that links connect it to."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            front = np.array([i])
            root[i] = i
            while len(front):
                front = np.flatnonzero(linked[front].any(0) & (root < 0))
                root[front] = i
    return root


def first_shared(wide: list[list[int]]) -> np.ndarray | None:
    """Per pair of classes the least wide bucket that both are in, else 0; None if no class is in one."""
    if not any(wide):
        return None
    out = np.zeros((len(wide), len(wide)), np.int64)
    buckets = np.array([x for w in wide for x in w])
    owner = np.repeat(np.arange(len(wide)), [len(w) for w in wide])
    for value in np.unique(buckets)[::-1]:
        inside = owner[buckets == value]
        out[np.ix_(inside, inside)] = value
    return out


def _verify(gram: int, threshold: float):
    """Stream cells sorted by (bucket, lo, hi) to rows (uid, links, tied)."""
    names = ["uid", "links", "tied"]

    def settle(key, rows):
        rows.sort(key=lambda r: r[0])
        uid, weight, own = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        linked = links([gram_set(H.decompress(r[4]), gram) for r in rows], threshold)
        shared = first_shared([r[3] or [] for r in rows])
        if shared is not None:
            linked &= shared == key[0]
        if key[1] != key[2]:  # pairs within a block are the block's own cell's
            linked &= own[:, None] != own[None, :]
        return uid, (linked * weight[None, :]).sum(1), uid[least_connected(linked)]

    def run(batches):
        key, rows, out = None, [], []

        def full():
            done = [np.concatenate(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in done], names)

        for b in batches:
            for *at, u, w, o, v, z in zip(*(b.column(c).to_pylist() for c in ("bucket", "lo", "hi", "uid", "weight", "own", "wide", "z")), strict=True):
                if at != key:
                    if len(rows) > 1:
                        out.append(settle(key, rows))
                    key, rows = at, []
                rows.append((u, w, o, v, z))
            if out:
                yield full()
        if len(rows) > 1:
            out.append(settle(key, rows))
        if out:
            yield full()

    return run


def _compressed(batches):
    press = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array([press.compress((t or "").encode()) for t in b.column("text").to_pylist()], pa.binary())], ["uid", "z"])


def linked_rows(docs: DataFrame, work: Workspace, gram: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(docs as written with uid, and per uid: doc_id, root, n_links); equal roots are connected by links."""
    rows = signed_rows(docs, work, gram, *bands_for(threshold, recall))
    sets = rows.filter("set_hash IS NOT NULL").groupBy("set_hash").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("weight"))
    sets = work.write(sets, "sets")
    classes = rows.select("uid", "set_size", "bands").join(sets.select("uid").hint("merge"), "uid", "left_semi")
    placed = cells(classes, work).join(sets.select("uid", "weight").hint("merge"), "uid")
    texts = rows.select("uid", "text").mapInArrow(lean(_compressed), "uid long, z binary").join(placed.hint("merge"), "uid")
    dealt = texts.select("uid", "weight", "wide", F.explode("cells").alias("cell"), "z").select("cell.*", "uid", "weight", "wide", "z")
    ordered = dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    checked = work.write(ordered.mapInArrow(lean(_verify(gram, threshold)), "uid long, links long, tied long"), "checked")
    linked = work.write(checked.groupBy("uid").agg(F.sum("links").alias("links")), "links")
    near = components(checked.select(F.col("uid").alias("a"), F.col("tied").alias("b")), work, "near")
    known = (
        sets.join(linked.hint("merge"), "uid", "left").join(near.select(F.col("a").alias("uid"), "b").hint("merge"), "uid", "left")
        .select("set_hash", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("b", "uid").alias("root"))
    )
    known = work.write(known, "known")
    full = rows.select("uid", "doc_id", "set_hash").join(known.hint("merge"), "set_hash", "left")
    out = full.select("uid", "doc_id", F.coalesce("root", "uid").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows, work.write(out, "linked")


def jaccard_join(docs: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links."""
    work = Workspace(docs.sparkSession, "jaccard_join")
    _, linked = linked_rows(docs.select("doc_id", "text"), work, gram, threshold, recall)
    named = work.write(linked.groupBy("root").agg(F.min("doc_id").alias("class_id")), "named")
    return linked.join(named.hint("merge"), "root").select("doc_id", "class_id", "n_links")


def drop_near_duplicates(docs: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One document of each connected group stays, the one of least doc_id, with all its columns."""
    own = {"uid", "set_hash", "set_size", "bands"}
    names = {c: c if c not in own else free_name([*docs.columns, *own], c) for c in docs.columns}
    rows, linked = linked_rows(docs.withColumnsRenamed(names), Workspace(docs.sparkSession, "near_duplicates"), gram, threshold, recall)
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first"))
    kept = rows.join(first.select(F.col("first.uid").alias("uid")).hint("merge"), "uid", "left_semi")
    return kept.select(*names.values()).withColumnsRenamed({v: k for k, v in names.items()})
