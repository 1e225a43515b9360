"""Best-fit packing of documents into sequences of a fixed number of tokens.

Each document becomes its token ids and an end id; one that is longer than a sequence is cut
into full pieces, of which only the first may be shorter. A full piece is a sequence. The
other pieces, at most one per document, are dealt by hash to bins' partitions of about
PIECES_AT_ONCE rows and packed there by bounded-space best-fit: a fixed number of open bins,
found through a bitset keyed by free space; each piece goes to the fullest bin that can take
it, and when too many bins are open the fullest closes. Pieces arrive longest first, so small
ones fill what large ones left. Only (doc_id, piece, length) rows are shuffled; partitions
are independent, and the part-filled bins at the end of one are few against its rows.

Defined cases: null text is one end id; rows that repeat a doc_id are packed each; null
doc_id is packed as any other; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, by_bytes, lean
from tidemark.llm.tokenizing import default_tokenizer, encoder

MAX_TOKENS = 1024
END_ID = 2
OPEN_BINS = 1024
PIECES_AT_ONCE = 50_000

PIECE_SCHEMA = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, and a first one with the remainder."""
    first = (n - 1) % size + 1
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves, little-endian 32-bit, as `ids`."""
    path = tokenizer or default_tokenizer()
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "")
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut_all(batches):
        enc = encoder(path)
        for b in by_bytes(batches, "text"):
            all_ids, counts = enc.encode([t or "" for t in b.column("text").to_pylist()])
            ends = np.cumsum(counts)
            rows = [[] for _ in names]
            for doc_id, row, e, n in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), ends.tolist(), counts.tolist(), strict=True):
                ids = np.append(all_ids[e - n : e], np.uint32(end_id)).astype("<u4")
                for k, (s, length) in enumerate(cut(n + 1, size)):
                    part = ids[s : s + length].tobytes()
                    for out, value in zip(rows, (doc_id, row, k, s, length, zlib.crc32(part), part), strict=False):
                        out.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=False)], names)

    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(lean(cut_all), schema)


class OpenBins:
    """Bounded-space best-fit: at most `most` open bins, kept by free space; bit f is set if a bin has f free."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece: the open bin with the least free space that takes it, else a new one."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            space, bin_ = self.size, self.made
            self.made += 1
        if space > length:
            self.free[space - length].append(bin_)
            self.bits |= 1 << (space - length)
            self.open += 1
        return bin_, self.size - space

    def _take(self, space: int) -> int:
        bin_ = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.open -= 1
        return bin_


def pack_pieces(rows: DataFrame, size: int = MAX_TOKENS, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add sequence_id and offset to rows that have doc_id, row, piece and length (1 to size)."""
    full = rows.filter(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    short = rows.filter(F.col("length") < size)
    parts = max(1, -(-short.count() // PIECES_AT_ONCE))
    dealt = short.repartition(parts, F.xxhash64("doc_id", "row", "piece")).sortWithinPartitions(F.desc("length"), "doc_id", "row", "piece")
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64())])

    def pack(batches):
        bins, base = OpenBins(size, open_bins), TaskContext.get().partitionId() << 33
        for b in batches:
            placed = [bins.place(n) for n in b.column("length").to_pylist()]
            added = pa.RecordBatch.from_pydict({"sequence_id": [base + k for k, _ in placed], "offset": [o for _, o in placed]}, schema)
            yield pa.RecordBatch.from_arrays([*b.columns, *added.columns], [*b.schema.names, *added.schema.names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    packed = dealt.mapInArrow(lean(pack), f"{fields}, sequence_id long, offset long")
    return packed.unionByName(full.withColumn("offset", F.lit(0).cast("long")))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = MAX_TOKENS, end_id: int = END_ID,
                   open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    cut_rows = Workspace(docs.sparkSession, "packing").write(pieces(docs, tokenizer, size, end_id, with_ids), "pieces")
    return pack_pieces(cut_rows, size, open_bins).drop("row")
