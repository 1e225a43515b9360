"""Token files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

File format. A set of token files is a Parquet dataset of blocks in ascending doc_id order,
with a `ranks` dataset beside it. A block row holds its place (`part`, `seq`), the number of
its ids, `doc_ids` and `lengths` of its documents, `control` and `data`. Ids are replaced
by their rank in descending frequency, so frequent ids take one byte. Ranks are coded in
fours: a control byte has two bits per rank, its number of bytes less one, lowest bits first,
and `data` has those bytes, little-endian, with no padding. Decoding looks each control byte
up in a table of lengths, sums them to offsets and gathers the bytes, all by array operations.
`ranks` has one row per id seen: (id, rank).

Writing. Texts are dealt to ranges of doc_id, tokenized once within each range in ascending
order, and written with each range's counts of ids; counts are added (one row per id) to give
ranks, and a second pass without shuffle codes the blocks. Spark's writers commit the files,
so a lost executor leaves no torn file.

Defined cases: null text is one end id; null doc_id comes first; rows that repeat a doc_id
follow one another and are written each; an empty table gives empty datasets; a document of
any length is whole within one block; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, by_bytes, join_checked, lean, splits
from tidemark.llm.tokenizing import default_tokenizer, encoder

END_ID = 0
BLOCK_IDS = 1 << 18

LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4)) & 3) + 1).astype(np.uint8)  # of the four ranks behind a control byte


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of ranks below 2**32."""
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    widest = int(sizes.max(initial=1))
    as_bytes = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :widest]
    return control.tobytes(), as_bytes[np.arange(widest, dtype=np.uint8) < sizes[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    ranks = np.zeros(n, np.uint32)
    if n:
        ranks[:] = raw[at]
    for k in range(1, int(sizes.max(initial=1))):
        wide = np.flatnonzero(sizes > k)
        ranks[wide] |= raw[at[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _tokenize(docs: DataFrame, path: str, end_id: int, ranges: int) -> DataFrame:
    """Per range of doc_id and in ascending order: rows of documents' ids; and rows of counts (doc_id null, n null).

    Rows of one id, or without any, are dealt by their place in the input, so they spread over ranges too.
    """
    order = [F.col("doc_id").asc_nulls_first(), "row"]
    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    ordered = ordered.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")
    names = ["part", "seq", "doc_id", "n", "ids"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def tokenize(batches):
        part, seq = TaskContext.get().partitionId(), 0
        counts = np.zeros(0, np.int64)
        enc = encoder(path)
        for b in by_bytes(batches, "text"):
            ids, sizes = enc.encode([t or "" for t in b.column("text").to_pylist()])
            ends = np.cumsum(sizes)
            rows = [np.append(ids[e - n : e], np.uint32(end_id)) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            seen = np.bincount(np.append(ids, np.uint32(end_id)))
            seen[end_id] += len(rows) - 1
            counts = np.pad(counts, (0, max(0, len(seen) - len(counts))))
            counts[: len(seen)] += seen
            narrow = len(counts) <= 1 << 16
            packed = [r.astype("<u2" if narrow else "<u4").tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), types[0]), pa.array(range(seq, seq + len(rows)), types[1]), b.column("doc_id"),
                 pa.array([len(r) for r in rows], types[3]), pa.array(packed, types[4])], names)
            seq += len(rows)
        if len(counts):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, -1, None, None, counts.astype("<i8").tobytes()), types, strict=True)], names)

    return ordered.mapInArrow(lean(tokenize), "part int, seq long, doc_id long, n long, ids binary")


def _widen(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def rank_ids(counts: DataFrame) -> DataFrame:
    """(id, rank) from rows of count arrays: most frequent first, ties to the smaller id.

    A task adds up the arrays it reads before it gives rows, at most one per id of the vocabulary.
    """

    def total(batches):
        counts = np.zeros(0, np.int64)
        for b in batches:
            for raw in b.column("ids").to_pylist():
                c = np.frombuffer(raw, "<i8")
                counts = np.pad(counts, (0, max(0, len(c) - len(counts))))
                counts[: len(c)] += c
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["id", "n"])

    summed = counts.select("ids").mapInArrow(lean(total), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return summed.select("id", (F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"))


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write `path`/blocks and `path`/ranks."""
    spark = docs.sparkSession
    work = Workspace(spark, "token_files")
    ids = work.write(_tokenize(docs, tokenizer or default_tokenizer(), end_id, splits(docs)), "ids", "zstd")
    rank_ids(ids.filter("n is null")).write.parquet(f"{path}/ranks")
    table = spark.sparkContext.broadcast(_rank_array(spark, path))
    names = ["part", "seq", "n_ids", "doc_ids", "lengths", "control", "data"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def code(batches):
        part, seq, doc_ids, rows, size = None, 0, [], [], 0

        def block():
            control, data = encode_ranks(table.value[np.concatenate(rows)])
            cells = (part, seq, size, doc_ids, [len(r) for r in rows], control, data)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, types, strict=True)], names)

        for b in by_bytes(batches, "ids"):
            for p, s, d, n, raw in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "doc_id", "n", "ids")), strict=True):
                if rows and (p != part or s != seq + len(rows) or size + n > BLOCK_IDS):
                    yield block()
                    doc_ids, rows, size = [], [], 0
                if not rows:
                    part, seq = p, s
                doc_ids.append(d)
                rows.append(_widen(raw, n))
                size += n
        if rows:
            yield block()

    schema = "part int, seq long, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary"
    ids.filter("n is not null").mapInArrow(lean(code), schema).write.parquet(f"{path}/blocks")
    work.drop("ids")


def _rank_array(spark: SparkSession, path: str) -> np.ndarray:
    """rank by id; as large as the vocabulary, not the corpus."""
    rows = spark.read.parquet(f"{path}/ranks").collect()
    table = np.zeros(1 + max((r["id"] for r in rows), default=0), np.uint32)
    for r in rows:
        table[r["id"]] = r["rank"]
    return table


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document, decoded: doc_id, start, n_tokens, ids_crc32 (and the ids, little-endian 32-bit)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").collect()
    by_rank = np.zeros(len(ranks), np.uint32)
    for r in ranks:
        by_rank[r["rank"]] = r["id"]
    table = spark.sparkContext.broadcast(by_rank)
    # Ids before a block: sums of the ranges before its own (one row each), then of the blocks before it in its range.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_first"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    firsts = blocks.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("in_part"))
    firsts = firsts.join(parts, "part").select("part", "seq", (F.col("part_first") + F.col("in_part")).alias("first"))
    names = ["part", "seq", "doc_id", "in_block", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def decode(batches):
        for b in by_bytes(batches, "data"):
            columns = (b.column(c).to_pylist() for c in ("part", "seq", "doc_ids", "lengths", "control", "data"))
            for part, seq, doc_ids, lengths, control, data in zip(*columns, strict=True):
                ends = np.cumsum(lengths)
                raw = table.value[decode_ranks(control, data, int(ends[-1]))].astype("<u4").tobytes()
                cut = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths, strict=True)]
                k = len(doc_ids)
                cells = ([part] * k, [seq] * k, doc_ids, ends - lengths, lengths, [zlib.crc32(x) for x in cut], cut)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, types, strict=False)][: len(names)], names)

    schema = "part int, seq long, doc_id long, in_block long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    decoded = blocks.select("part", "seq", "doc_ids", "lengths", "control", "data").mapInArrow(lean(decode), schema)
    start = (F.col("first") + F.col("in_block")).alias("start")
    return join_checked(decoded, firsts, ["part", "seq"]).select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids)
