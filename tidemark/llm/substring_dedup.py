"""Substring dedup over words: remove what windows cover whose words also occur elsewhere.

Level-wise doubling. The first level is grams of GRAM words, thinned to the anchors that windows
of WORDS words choose by content (see anchors): an anchor that occurs once stops here. Runs of
windows that are equal as a whole are settled by one aggregate with partial counts, so copies go
on as one run; of these, only runs whose anchor other runs share go on. The level of twice the anchors' length takes
all windows of these runs, since the grams between anchors were thinned out and are not known to repeat or not. Each further level
doubles the length: its candidates are the windows of twice the length both of whose halves
survived, and those whose words occur again survive. The last level joins two overlapping halves
into WORDS words and is keyed by the pair of their hashes; what repeats there is removed. Levels
only handle survivors of the level before, and end when none survive.

Defined cases: null or empty texts have no words; a text of fewer words than a window loses
nothing; windows may overlap and repeat within one text; rows that repeat a doc_id are
documents of their own; a null doc_id is a document like any other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import anchors as A
from tidemark.llm.common import Workspace, lean
from tidemark.llm.hashing import Rolling, decompress, tokens_of

WORDS = 35
GRAM = 9


def levels(gram: int, length: int) -> list[int]:
    """Lengths after the first level: doubled, the last one `length`."""
    out = []
    while gram < length:
        gram = min(2 * gram, length)
        out.append(gram)
    return out or [length]


def first_offsets(sizes: list[int]) -> np.ndarray:
    """Where the windows of sizes[0] begin from which a window of sizes[-1] is joined."""
    out = {0}
    for small, large in zip(sizes[-2::-1], sizes[:0:-1], strict=True):
        out = {o + x for o in out for x in (0, large - small)}
    return np.array(sorted(out))


def _windows(size: int, half: int, offsets: np.ndarray | None):
    """Rows (h1, h2, k, at) of windows of `size` words, keyed by their first and last `half` words.

    offsets: items are runs (at, number of windows), and windows begin at these offsets from theirs.
    Without offsets items are the places of surviving windows of `half` words, and windows begin where both halves survived.
    """
    names = ["h1", "h2", "k", "at"]

    def run(batches):
        for b in batches:
            for k, z, items in zip(b.column("k").to_pylist(), b.column("z").to_pylist(), A.item_arrays(b.column("items")), strict=True):
                if offsets is None:
                    alive = np.unique(items[:, 0])
                    at = alive[np.isin(alive + (size - half), alive, assume_unique=True)]
                else:
                    n = items[:, 1]
                    ends = np.cumsum(n)
                    starts = np.repeat(items[:, 0] - (ends - n), n) + np.arange(ends[-1])
                    at = np.unique(starts[:, None] + offsets)
                if not len(at):
                    continue
                roll = Rolling(tokens_of(decompress(z), "words"))
                h = [roll.span(s, s + half).view(np.int64) for s in (at, at + (size - half))]
                yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(np.full(len(at), k)), pa.array(at)], names)

    return run


def survivors(texts: DataFrame, lists: DataFrame, size: int, half: int, offsets: np.ndarray | None, work: Workspace) -> DataFrame:
    """(k, at): candidates of one level whose words occur more than once."""
    found = texts.join(lists.hint("merge"), "k").select("k", "z", "items").mapInArrow(lean(_windows(size, half, offsets)), "h1 long, h2 long, k long, at long")
    found = work.write(found, f"windows{size}")
    again = work.write(A.repeated(found, "h1", "h2"), f"again{size}")
    alive = work.write(found.join(again.hint("merge"), ["h1", "h2"], "left_semi").select("k", "at"), f"level{size}")
    work.drop(f"windows{size}", f"again{size}")
    return alive


def repeated_spans(texts: DataFrame, scheme: A.Scheme, work: Workspace) -> DataFrame:
    """(k, items of (at, n)): runs of windows whose words start elsewhere too."""
    rows = A.repeated_anchors(texts, scheme, work)
    groups = work.write(A.context_groups(rows), "groups")
    whole = rows.join(groups.filter("n > 1").select("a", "c", "no").hint("merge"), ["a", "c", "no"], "left_semi")
    whole = work.write(whole.select("k", "at", F.shiftright("no", A.PLACE_BITS).alias("n")), "whole")
    work.drop("repeated")
    number = F.shiftright("no", A.PLACE_BITS).alias("number")
    lists = work.write(A.by_text(A.shared_anchors(groups, work).select("k", "at", number), "at", "number"), "runs")

    sizes = levels(scheme.gram, scheme.length)
    half, offsets = sizes[0], first_offsets(sizes)
    for size in sizes:
        alive = survivors(texts, lists, size, half, offsets, work)
        half, offsets = size, None
        if size == sizes[-1] or alive.isEmpty():
            break
        lists = work.write(A.by_text(alive, "at"), f"lists{size}")
    last = alive if size == sizes[-1] else alive.limit(0)
    spans = whole.unionByName(last.withColumn("n", F.lit(1).cast("long")))
    return work.write(A.by_text(spans, "at", "n"), "spans")


def remove_repeats(docs: DataFrame, words: int = WORDS, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (and with_text the kept words, joined by a space)."""
    scheme = A.Scheme("words", words, min(gram, words))
    work = Workspace(docs.sparkSession, "substring_dedup")
    texts = A.store_texts(docs, work)
    spans = repeated_spans(texts, scheme, work)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text

    def cut(batches):
        for b in batches:
            out = [[] for _ in names]
            for doc_id, z, items in zip(b.column("doc_id").to_pylist(), b.column("z").to_pylist(), A.item_arrays(b.column("items")), strict=True):
                found = decompress(z).split()
                gone = A.covered(items, len(found), words)
                kept = b" ".join(w for w, x in zip(found, gone.tolist(), strict=True) if not x) if gone.any() else b" ".join(found)
                for column, value in zip(out, (doc_id, len(found), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=False):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=False)], names)

    joined = texts.join(spans.hint("merge"), "k", "left").select("doc_id", "z", "items")
    return joined.mapInArrow(lean(cut), "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))
