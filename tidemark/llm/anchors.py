"""Finding equal windows of tokens in all texts, by content-chosen anchors. Shared by the two window dedups.

A window of `length` tokens (words or bytes) is represented by one of its grams of `gram`
tokens: the one whose hash is least, the leftmost of equals. The choice looks at nothing
outside the window, so equal windows choose equal grams at the same place in them, and
neighbouring windows mostly share theirs: one anchor stands for a run of windows, which
start at consecutive tokens. Shuffling anchors instead of windows moves a few rows per
hundred tokens and loses no pair of equal windows.

Texts get a row id k and are dealt by it into a bucketed table of compressed texts; every later
step that needs texts again joins that table by k without shuffling it. Nothing is dealt by
doc_id, so rows that repeat one, or have none, are no hot key.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, lean, splits
from tidemark.llm.hashing import CHUNK, Hashes, Rolling, decompress, mix, tokens_of

PLACE_BITS = 20  # of the place within a chunk, kept beside a gram's hash
NO_ID = -(2**63)

ROW = ("k", "d", "z")  # of the table of texts: row id, doc_id (null: the least long), compressed text


class Scheme(NamedTuple):
    unit: str  # "words" or "bytes"
    length: int
    gram: int

    @property
    def names(self) -> list[str]:
        return ["a", "c", "d", "k", "at", "no"]

    @property
    def schema(self) -> str:
        return ", ".join(f"{n} long" for n in self.names)


def store_texts(docs: DataFrame, work: Workspace) -> DataFrame:
    """Bucketed table (k, d, doc_id, z)."""

    def pack(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = [press.compress(t.encode()) if t else b"" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("doc_id").fill_null(NO_ID), b.column("doc_id"), pa.array(z, pa.binary())], ["k", "d", "doc_id", "z"])

    n = max(8, splits(docs))
    numbered = docs.select(F.monotonically_increasing_id().alias("k"), F.col("doc_id").cast("long"), "text")
    packed = numbered.mapInArrow(lean(pack), "k long, d long, doc_id long, z binary")
    return work.write_bucketed(packed.repartition(n, "k"), "texts", n, "k")


def chunks(rows, unit: str, length: int):
    """(tokens, pieces) of joined texts of rows (k, d, text), CHUNK tokens or few more at once.

    A piece is (k, d, token of the text at which it begins, its start and end in tokens). A text
    longer than CHUNK is cut into pieces that overlap by length - 1: each window is in one piece.
    """
    waiting, pieces, size = [], [], 0
    for k, d, text in rows:
        tokens = tokens_of(text, unit)
        for begin in range(0, max(1, len(tokens) - length + 1), CHUNK):
            part = tokens[begin : begin + CHUNK + length - 1]
            if len(part) < length:
                continue
            if waiting and size + len(part) > CHUNK + length - 1:
                yield np.concatenate(waiting), pieces
                waiting, pieces, size = [], [], 0
            waiting.append(part)
            pieces.append((k, d, begin, size, size + len(part)))
            size += len(part)
    if waiting:
        yield np.concatenate(waiting), pieces


def least_grams(hashes: Hashes, span: int) -> np.ndarray:
    """Place of the least of each `span` neighbouring hashes, the leftmost of equals (of the bits kept)."""
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    wide = 1
    while 2 * wide <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < span:
        n = len(hashes) - span + 1
        least = np.minimum(least[:n], least[span - wide : span - wide + n])
    return (least & place).astype(np.int64)


def anchors_of(tokens: Hashes, pieces, scheme: Scheme) -> list[np.ndarray]:
    """Columns of scheme.names for the anchors of joined texts.

    a: hash of the gram. c: hash of all tokens of the run's windows, and of their number and the
    anchor's place. d, k, at: document, row and first window. no: number of windows << 20 | the
    anchor's place from the first window.
    """
    length, gram = scheme.length, scheme.gram
    roll = Rolling(tokens)
    n = len(tokens)
    grams = roll.span(np.arange(n - gram + 1), np.arange(gram, n + 1))
    windows = n - length + 1
    at = least_grams(grams, length - gram + 1)
    start = np.array([p[3] for p in pieces])
    end = np.array([p[4] for p in pieces])
    own = np.repeat(np.arange(len(pieces)), end - start)[:windows]
    inside = np.arange(windows) + length <= end[own]
    new = np.ones(windows, bool)
    new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    count = np.diff(first, append=windows)
    real = inside[first]
    first, count = first[real], count[real]
    place, own = at[first], own[first]
    no = count << PLACE_BITS | (place - first)
    c = mix(roll.span(first, first + count - 1 + length) ^ mix(no.astype(np.uint64)))
    k, d, base = (np.array(x, np.int64)[own] for x in ([p[0] for p in pieces], [p[1] for p in pieces], [p[2] - p[3] for p in pieces]))
    return [grams[place].view(np.int64), c.view(np.int64), d, k, base + first, no]


def texts_in(batch):
    return ((k, d, decompress(z)) for k, d, z in zip(*(batch.column(c).to_pylist() for c in ROW), strict=True))


def anchors(texts: DataFrame, scheme: Scheme) -> DataFrame:
    def run(batches):
        for b in batches:
            for tokens, pieces in chunks(texts_in(b), scheme.unit, scheme.length):
                columns = [pa.array(x) for x in anchors_of(tokens, pieces, scheme)]
                yield pa.RecordBatch.from_arrays(columns, scheme.names)

    return texts.select(*ROW).mapInArrow(lean(run), scheme.schema)


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys of more than one row; partial counts come before the shuffle.

    Callers write the keys before they join with them: a join of two plain exchanges is one whose
    hot keys adaptive execution splits, which it does not where an aggregate stands on one side.
    """
    return rows.groupBy(*keys).count().filter("count > 1").drop("count")


def repeated_anchors(texts: DataFrame, scheme: Scheme, work: Workspace) -> DataFrame:
    """Anchors whose gram is an anchor elsewhere too."""
    rows = work.write(anchors(texts, scheme), "anchors", "zstd")
    again = work.write(repeated(rows.select("a"), "a"), "again")
    out = work.write(rows.join(again.hint("merge"), "a", "left_semi"), "repeated", "zstd")
    work.drop("again", "anchors")
    return out


def context_groups(rows: DataFrame, content: str = "c") -> DataFrame:
    """Per equal run of windows (a, content, no): its number of occurrences n and the first (d, k, at)."""
    first = F.min(F.struct("d", "k", "at")).alias("first")
    return rows.groupBy("a", content, "no").agg(F.count(F.lit(1)).alias("n"), first).select("a", content, "no", "n", "first.*")


def shared_anchors(groups: DataFrame, work: Workspace, name: str = "shared") -> DataFrame:
    """Groups whose anchor has other groups too, with their number `others`: their windows may be partly equal."""
    many = work.write(groups.groupBy("a").agg(F.count(F.lit(1)).alias("others")).filter("others > 1"), name)
    return groups.join(many.hint("merge"), "a")


def by_text(rows: DataFrame, *fields: str) -> DataFrame:
    """(k, items): what concerns one text, as large as the text."""
    return rows.groupBy("k").agg(F.collect_list(F.struct(*fields)).alias("items"))


def covered(items, n_tokens: int, length: int) -> np.ndarray:
    """Mask of the tokens of one text that the windows in items, (at, number), cover."""
    edge = np.zeros(n_tokens + 1, np.int64)
    if len(items):
        np.add.at(edge, items[:, 0], 1)
        np.add.at(edge, items[:, 0] + items[:, 1] - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


def item_arrays(column) -> list[np.ndarray]:
    """Per row of a list<struct<long, ...>> column: an array of a column per field; none for null."""
    flat = column.flatten()
    width = column.type.value_type.num_fields
    both = np.stack([flat.field(i).to_numpy() for i in range(width)], axis=1) if len(flat) else np.zeros((0, width), np.int64)
    sizes = [x or 0 for x in column.value_lengths().to_pylist()]
    ends = np.cumsum(sizes)
    return [both[e - s : e] for e, s in zip(ends.tolist(), sizes, strict=True)]
