"""Exact top-k search by inner product: norm-sorted, rotated, pruned by Cauchy-Schwarz.

Vectors become integers, floor(SCALE * x), and are rotated by the right singular vectors of a
sample (at most SAMPLE_ROWS rows, by hash), which gathers their length into the first coordinates.
Each query first meets the longest vectors, a table of at most SEED_VALUES coordinates that every
task has; its k-th score there is a threshold that any later candidate must reach. Candidates are cut
into BANDS of descending length, and bands into parts of about SLICE_ROWS rows; a query is dealt only to the
bands whose longest vector could still reach its threshold. A task meets one block of
queries with one part as a stream sorted by descending length, so it holds the block, one batch
of candidates and k results per query, and stops once the bound by lengths rules out every query.

In a batch inner products are summed over coordinates in steps (HEAD, then twice as many, and so
on). After each step a pair's bound is its sum so far plus the product of the lengths of the rests;
only pairs whose bound reaches the query's k-th score are carried on, from the sum they have. The
rotation and the sums only steer pruning: the pairs that are left get their scores from the integers,
exactly (in floats while the lengths guarantee it, else in Python's integers, held to the range
of a long). Results of the parts, k per query each, are merged by a window over the query.

Defined cases: vectors that are null or hold a null, NaN or infinity take no part; vectors of
different lengths are filled up with zeros; of rows that repeat a vec_id, each is a query of
its own and a candidate for the others; a row with null vec_id is no query and, as candidate,
loses ties; with fewer than k candidates all are returned; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, join_checked, lean

SCALE = 64.0
K = 20
HEAD = 16
SAMPLE_ROWS = 4096
SEED_VALUES = 1 << 18  # coordinates of the longest vectors that every query meets first; a tenth of all vectors at most
BANDS = 8
BLOCK_VALUES = 1 << 19  # coordinates of a block of queries
SLICE_ROWS = 16384
BATCH = 1024
DENSE = 1 / 3  # from this share of surviving pairs on, a step is one matrix product
EXACT = 2.0**52
LONG = (-(2**63), 2**63 - 1)
NO_ID = np.iinfo(np.int64).max

VECTOR_SCHEMA = "vec_id long, norm double, ints binary"


def _integers(batches):
    """Valid vectors as (vec_id, norm, whole numbers held in doubles)."""
    for b in batches:
        vectors = b.column("embedding")
        at = vectors.offsets.to_numpy().astype(np.int64)
        x = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
        odd = np.append(0, np.cumsum(~np.isfinite(x)))
        whole = np.flatnonzero((odd[at[1:]] == odd[at[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False))
        with np.errstate(over="ignore", invalid="ignore"):
            ints = np.clip(np.floor(SCALE * x), -(2.0**1000), 2.0**1000).astype("<f8")
        norms, rows = [], []
        for i in whole:
            v = ints[at[i] : at[i + 1]]
            top = np.abs(v).max(initial=0.0) or 1.0
            norms.append(float(top * np.sqrt(np.sum((v / top) ** 2))))
            rows.append(v.tobytes())
        ids = b.column("vec_id").take(pa.array(whole))
        yield pa.RecordBatch.from_arrays([ids, pa.array(norms, pa.float64()), pa.array(rows, pa.binary())], ["vec_id", "norm", "ints"])


def integer_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_integers, VECTOR_SCHEMA)


def _matrix(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, raw in enumerate(rows):
        x = np.frombuffer(raw, "<f8")
        out[i, : len(x)] = x
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal columns, strongest first, from a hash sample of at most SAMPLE_ROWS vectors."""
    sample = vectors.filter(F.col("norm") < EXACT).orderBy(F.xxhash64("uid")).limit(SAMPLE_ROWS).select("ints").collect()
    rows = _matrix([bytes(r["ints"]) for r in sample], dim)
    return np.linalg.svd(rows, full_matrices=True)[2].T if len(rows) else np.eye(dim)


def products(q: np.ndarray, c: np.ndarray, top: float) -> np.ndarray:
    """Exact inner products, row by row, of whole numbers as int64; top bounds every one."""
    if top < EXACT:
        return np.rint(np.einsum("ij,ij->i", q, c)).astype(np.int64)
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), LONG[0]), LONG[1]) for x, y in zip(q, c, strict=True)], np.int64)


def steps(dim: int, head: int) -> list[tuple[int, int]]:
    """Ranges of coordinates that are added one after the other: doubling up to half of them, then an eighth, at last a sixteenth at a time.

    What is left after half decides where directions are spread evenly; there the bound is asked often.
    """
    ends = [0]
    while ends[-1] < dim:
        if 2 * ends[-1] < dim or not ends[-1]:
            end = max(head, 2 * ends[-1], 1)
        else:
            end = ends[-1] + max(1, -(-dim // (8 if 8 * ends[-1] < 7 * dim else 16)))
        ends.append(min(dim, end))
    return list(zip(ends, ends[1:]))


def rests(turned: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    """Per row and step the length of the coordinates after the step."""
    return np.stack([np.sqrt((turned[:, e:] ** 2).sum(1)) for _, e in ranges]) if ranges else np.zeros((0, len(turned)))


class Block:
    """A block of queries and the best k candidates that each has met; least: no score below it counts."""

    def __init__(self, uids, vec_ids, ints, norms, least, turn, head, k):
        self.uids, self.vec_ids, self.ints, self.norms, self.turn, self.k = uids, vec_ids, ints, norms, turn, k
        self.least = np.array(least, float)
        self.steps = steps(len(turn), head)
        self.turned = ints @ turn
        self.rests = rests(self.turned, self.steps)
        self.found: list[list[tuple[int, int, int]]] = [[] for _ in uids]  # (-score, vec_id, uid), best first
        self.met = self.multiplied = 0  # pairs that came here, and those whose whole products were computed

    def meet(self, uids, vec_ids, ints, norms) -> bool:
        """Meet a batch no longer than any before; False once no later batch can change a result."""
        active = np.flatnonzero(self.norms * norms.max() * (1 + 1e-9) + 1e-6 >= self.least)
        turned = ints @ self.turn
        rest = rests(turned, self.steps)
        self.met += len(self.uids) * len(uids)
        for i in range(0, len(active), BATCH):
            self._meet(active[i : i + BATCH], uids, vec_ids, ints, norms, turned, rest)
        return len(active) > 0

    def _meet(self, active, uids, vec_ids, ints, norms, turned, rest) -> None:
        least = self.least[active]
        may = self.uids[active, None] != uids[None, :]
        sums = np.zeros(may.shape)
        rows = columns = None  # of the surviving pairs, once they are few
        last = len(self.steps) - 1
        for n, (s, e) in enumerate(self.steps):
            if rows is None and n and np.count_nonzero(may) < DENSE * may.size:
                rows, columns = np.nonzero(may)
                sums = sums[rows, columns]
            if n == last:
                self.multiplied += may.size if rows is None else len(rows)
            with np.errstate(invalid="ignore", over="ignore"):
                if rows is None:
                    sums += self.turned[active, s:e] @ turned[:, s:e].T
                    slack = 1e-9 * np.outer(self.norms[active], norms) + 1e-6
                    may &= ~(sums + np.outer(self.rests[n, active], rest[n]) + slack < least[:, None])
                else:
                    q = active[rows]
                    sums += np.einsum("ij,ij->i", self.turned[q, s:e], turned[columns, s:e])
                    slack = 1e-9 * self.norms[q] * norms[columns] + 1e-6
                    left = ~(sums + self.rests[n, q] * rest[n, columns] + slack < least[rows])
                    rows, columns, sums = rows[left], columns[left], sums[left]
        if rows is None:
            rows, columns = np.nonzero(may)
            sums = sums[rows, columns]
        if not len(rows):
            return
        bounds = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        for at, end in zip(bounds.tolist(), [*bounds[1:].tolist(), len(rows)]):
            q, hits = active[rows[at]], columns[at:end]
            if len(hits) > 4 * self.k:
                slack = 2e-9 * self.norms[q] * norms.max() + 2e-6
                hits = hits[~(sums[at:end] + slack < np.partition(sums[at:end], -self.k)[-self.k])]
            scores = products(np.broadcast_to(self.ints[q], (len(hits), len(self.turn))), ints[hits], self.norms[q] * norms[hits].max())
            new = [(-x, v, u) for x, v, u in zip(scores.tolist(), vec_ids[hits].tolist(), uids[hits].tolist()) if x >= self.least[q]]
            self.found[q] = best = sorted(self.found[q] + new)[: self.k]
            if len(best) == self.k:
                self.least[q] = max(self.least[q], -best[-1][0] if -best[-1][0] > LONG[0] else -np.inf)


def _seeded(table, k: int):
    """Add to queries the k-th score among the seeds (uid, norm, ints) other than themselves, minus infinity without k such scores."""

    def run(batches):
        uids, norms = np.array([s[0] for s in table.value], np.int64), np.array([s[1] for s in table.value])
        dim = max((len(s[2]) // 8 for s in table.value), default=0)
        seeds = _matrix([s[2] for s in table.value], dim)
        for b in batches:
            rows = b.column("ints").to_pylist()
            queries = _matrix(rows, max([dim, *(len(r) // 8 for r in rows)]))[:, :dim]
            own, norm = b.column("uid").to_numpy(), b.column("norm").to_numpy()
            least = np.full(len(rows), -np.inf)
            for i in range(0, len(rows) if len(uids) > k else 0, BATCH // 4):
                scores = queries[i : i + BATCH // 4] @ seeds.T
                scores[own[i : i + BATCH // 4, None] == uids[None, :]] = -np.inf
                kth = np.partition(scores, -k, axis=1)[:, -k]
                small = norm[i : i + BATCH // 4] * norms.max() < EXACT  # else a float may lie above the true score
                least[i : i + BATCH // 4][small] = np.rint(kth[small])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least)], [*b.schema.names, "least"])

    return run


def _search(turned, head: int, k: int):
    """Stream groups of (block, band, part): queries first, then candidates by descending norm."""
    names = ["query_uid", "query_id", "vec_id", "uid", "score"]

    def results(block):
        rows = [(u, q, v if v != NO_ID else None, w, -s) for u, q, best in zip(block.uids.tolist(), block.vec_ids.tolist(), block.found, strict=True) for s, v, w in best]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def run(batches):
        turn, key, queries, waiting, block, over = turned.value, None, [], [], None, False

        def arrays(rows):
            uids = np.array([r[0] for r in rows], np.int64)
            ids = np.array([NO_ID if r[1] is None else r[1] for r in rows], np.int64)
            return uids, ids, _matrix([r[3] for r in rows], len(turn)), np.array([r[2] for r in rows])

        def flush():
            nonlocal block, queries, waiting, over
            if block is None and queries:
                block, queries = Block(*arrays(queries), [r[4] for r in queries], turn, head, k), []
            if waiting and block is not None and not over:
                over = not block.meet(*arrays(waiting))
            waiting = []

        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("block", "band", "part", "is_candidate", "uid", "vec_id", "norm", "ints", "least"))
            for *at, candidate, u, v, n, x, least in zip(*columns, strict=True):
                row = (u, v, n, x, least)
                if key != at:
                    flush()
                    if block is not None:
                        yield results(block)
                    key, queries, waiting, block, over = at, [], [], None, False
                if not candidate:
                    queries.append(row)
                elif not over:
                    waiting.append(row)
                    if len(waiting) == BATCH:
                        flush()
        flush()
        if block is not None:
            yield results(block)

    return run


def banded(rows: DataFrame, n: int) -> tuple[DataFrame, list[tuple[float, int]]]:
    """rows with band and part, and per band its greatest norm and number of parts."""
    cuts = sorted(set(rows.approxQuantile("norm", [i / BANDS for i in range(1, BANDS)], 0.01))) if n > SLICE_ROWS else []
    band = F.lit(len(cuts)) - sum((F.when(F.col("norm") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = rows.withColumn("band", band.cast("int"))
    stats = {r["band"]: (r["top"], max(1, -(-r["n"] // SLICE_ROWS))) for r in rows.groupBy("band").agg(F.max("norm").alias("top"), F.count(F.lit(1)).alias("n")).collect()}
    bands = [stats.get(i, (0.0, 1)) for i in range(len(cuts) + 1)]
    parts = F.element_at(F.array(*[F.lit(p) for _, p in bands]), F.col("band") + 1)
    return rows.withColumn("part", F.pmod(F.xxhash64("uid"), parts).cast("int")), bands


def top_k(vectors: DataFrame, is_query: Column, k: int = K, head: int = HEAD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows of (vec_id, embedding) that is_query (over vec_id) marks."""
    work = Workspace(vectors.sparkSession, "topk")
    rows = work.write(integer_vectors(vectors).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), (F.max(F.length("ints")) / 8).cast("int").alias("dim")).first()
    dim = size["dim"] or 0
    blocks = max(1, -(-size["q"] // max(1, BLOCK_VALUES // max(1, dim))))
    turn = rotation(rows, dim) if dim else np.eye(0)
    seeds = [(r["uid"], r["norm"], bytes(r["ints"])) for r in rows.orderBy(F.desc("norm"), "uid").limit(max(k + 1, min(SEED_VALUES // max(1, dim), size["n"] // 10))).select("uid", "norm", "ints").collect()]
    seeds, turned = (vectors.sparkSession.sparkContext.broadcast(x) for x in (seeds, turn))
    placed, bands = banded(rows, size["n"])

    cells = ["uid", "vec_id", "norm", "ints"]
    queries = rows.filter(is_query).mapInArrow(lean(_seeded(seeds, k)), "vec_id long, norm double, ints binary, uid long, least double")
    reach = lambda top: F.col("norm") * F.lit(top * (1 + 1e-9)) + 1e-6 >= F.col("least")
    wanted = F.array_compact(F.array(*[F.when(reach(top), F.lit(i)) for i, (top, _) in enumerate(bands)]))
    last_part = F.element_at(F.array(*[F.lit(n - 1) for _, n in bands]), F.col("band") + 1)
    queries = work.write(queries.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")).withColumn("wanted", wanted), "queries")
    # One row per band: the blocks that have a query for it.
    per_band = work.write(queries.select("block", F.explode("wanted").alias("band")).distinct().groupBy("band").agg(F.collect_list("block").alias("blocks")), "bands")
    dealt_queries = queries.select("block", F.explode("wanted").alias("band"), F.lit(False).alias("is_candidate"), *cells, "least")
    dealt_queries = dealt_queries.select("block", "band", F.explode(F.sequence(F.lit(0), last_part)).alias("part"), "is_candidate", *cells, "least")
    dealt = join_checked(placed, per_band, ["band"]).select(F.explode("blocks").alias("block"), "band", "part", F.lit(True).alias("is_candidate"), *cells, F.lit(None).cast("double").alias("least"))
    met = (
        dealt_queries.unionByName(dealt).repartition(blocks * sum(n for _, n in bands), "block", "band", "part")
        .sortWithinPartitions("block", "band", "part", "is_candidate", F.desc("norm"), "uid")
        .mapInArrow(lean(_search(turned, min(head, dim), k)), "query_uid long, query_id long, vec_id long, uid long, score long")
    )
    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
