"""Phrase collocations of each language, mined with position bitmaps.

A task lays the words of a shard (a few MB of one language's texts) out at consecutive positions. Each
word has a compressed bitmap of its positions: only the blocks of 16 positions that hold it are
kept, one 16-bit mask each. A phrase is extended by a word as in SPAM: its bitmap is shifted by one, bits
at the first word of a piece are cleared, the result is ANDed with the bitmaps of the words that have the
same blocks, and the popcount of what is left is the longer phrase's count in the shard. Groups of
first words are taken to full depth one after another, so a task holds the bitmaps of one group's extensions.
Counts are summed over shards by Spark.

Levels. A phrase is counted only if all its parts are frequent, so the texts are read once for
each length. What is frequent reaches the tasks as a filter of hashed bits of at most
FILTER_BITS bits (32 MB), whatever the size of the input: a bit set by another phrase costs a
count that is dropped after the sum, never a result. Spark sums phrases, joins the counts of their
parts and ranks; no word list or phrase list passes through the driver. A frequent part is a hot key of its
join: both sides are written first, so adaptive execution splits it.

Defined cases: null text is empty; null language is `und`, one with the language of that name;
texts are read whole, cut into shards between pieces only; ties go to the phrase that is first in
UTF-8 byte order; rows that repeat count each; an empty table gives an empty result; other columns
are ignored. Counts may reach 10^15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, join_checked, lean
from tidemark.llm.hashing import mix

SHARD_BYTES = 4 << 20  # of text of one language
BUFFERED_BYTES = 12 << 20  # of texts of all languages that wait for their shard
GROUP_ENTRIES = 1 << 15  # bitmap blocks of first words that are extended together
FILTER_BITS = 1 << 28
BLOCK = 16
SCALE = 1_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)

#: A-Z in lower case; kinds of bytes: part of a word, space, end of a piece.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def lay_out(raw: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts at their positions, and which of them begin a piece."""
    low = np.frombuffer(raw.translate(LOWER), np.uint8)
    kind = KIND[low]
    inside = kind == 0
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[start]
    first = np.diff(piece, prepend=-1) != 0
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(low[inside].tobytes()))
    return words.dictionary_encode(), first


def pieces_of(raw: bytes, most: int = SHARD_BYTES) -> Iterator[bytes]:
    """Texts cut after the last end of a piece within each `most` bytes, or else after the next one."""
    start = 0
    ends = np.flatnonzero(KIND[np.frombuffer(raw, np.uint8)] == 2) if len(raw) > most else np.zeros(0, np.int64)
    while len(raw) - start > most:
        at = int(np.searchsorted(ends, start + most))
        within = at and ends[at - 1] >= start
        if not within and at == len(ends):
            break
        cut = int(ends[at - 1] if within else ends[at]) + 1
        yield raw[start:cut]
        start = cut
    yield raw[start:]


def shards(batches) -> Iterator[tuple[str, bytes]]:
    """(language, texts joined by line ends) of Arrow batches of languages and texts."""
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def flush(lang: str) -> Iterator[tuple[str, bytes]]:
        sizes.pop(lang)
        for raw in pieces_of(b"\n".join(waiting.pop(lang))):
            yield lang, raw

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            waiting.setdefault(lang, []).append(text.as_buffer().to_pybytes())
            sizes[lang] = sizes.get(lang, 0) + len(waiting[lang][-1]) + 1
            if sizes[lang] >= SHARD_BYTES:
                yield from flush(lang)
            if sum(sizes.values()) >= BUFFERED_BYTES:
                yield from flush(max(sizes, key=sizes.get))
    for lang in list(sizes):
        yield from flush(lang)


def word_hashes(words) -> np.ndarray:
    return pd.util.hash_array(np.asarray(words, object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def phrase_hash(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """Of phrases given as one array of word hashes for each place."""
    h = np.full(len(words[0]), word_hashes([lang])[0])
    for w in words:
        h = mix(h * _MULT + w)
    return h


class Filter:
    """Bits of hashed phrases: has() is true for every phrase put in, and for few others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in places(h, self.mask):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def places(h: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
    return [h & mask, (h >> np.uint64(32)) & mask]


def build_filter(phrases: DataFrame):
    """A broadcast of the bits of (lang, phrase) rows: 16 bits a row, FILTER_BITS at most. Bits are set by an aggregate."""
    size = min(FILTER_BITS, 1 << max(16, (16 * phrases.count() - 1).bit_length()))
    mask = np.uint64(size - 1)

    def positions(batches):
        for b in batches:
            rows = pd.DataFrame({"lang": b.column(0).to_pylist(), "phrase": b.column(1).to_pylist()})
            for lang, group in rows.groupby("lang"):
                words = [word_hashes(list(w)) for w in zip(*(p.split(" ") for p in group["phrase"]), strict=True)]
                at = np.concatenate(places(phrase_hash(lang, words), mask))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(15)).astype(np.int64)), pa.array((at & np.uint64(32767)).astype(np.int64))], ["bucket", "bit"])

    maps = phrases.select("lang", "phrase").mapInArrow(positions, "bucket long, bit long").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for row in maps.toLocalIterator():
        bits[row["bucket"] * 4096 : (row["bucket"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(bits)


class Bitmaps:
    """Compressed bitmaps: (owner, block, mask) rows in that order."""

    def __init__(self, owner: np.ndarray, block: np.ndarray, mask: np.ndarray, blocks: int):
        key = owner * blocks + block
        if np.any(key[1:] < key[:-1]):
            order = np.argsort(key, kind="stable")
            key, mask = key[order], mask[order]
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        key = key[begins]
        self.owner, self.block = key // blocks, key % blocks
        self.mask = np.bitwise_or.reduceat(mask, begins) if len(begins) else mask[:0]
        self.blocks = blocks

    def take(self, keep) -> Bitmaps:
        out = object.__new__(Bitmaps)
        out.owner, out.block, out.mask, out.blocks = self.owner[keep], self.block[keep], self.mask[keep], self.blocks
        return out

    def shifted(self, first: np.ndarray) -> Bitmaps:
        """The positions after these; none that begins a piece. A bit shifted out enters the next block."""
        over = np.flatnonzero(self.mask >> np.uint16(BLOCK - 1))
        out = Bitmaps(
            np.concatenate([self.owner, self.owner[over]]), np.concatenate([self.block, self.block[over] + 1]),
            np.concatenate([self.mask << np.uint16(1), np.ones(len(over), np.uint16)]), self.blocks,
        )
        out.mask = out.mask & ~first[out.block]
        return out.take(out.mask != 0)


def mine_shard(lang: str, raw: bytes, length: int, known: list[Filter]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, counts) of the phrases of `length` words whose parts are in known[k - 1], those of k words, for all k below length."""
    laid, first = lay_out(raw)
    words, codes = laid.dictionary, laid.indices.to_numpy()
    n = len(codes)
    if length == 1:
        if n:
            yield words, np.bincount(codes, minlength=len(words))
        return
    hashes = word_hashes(words.to_numpy(zero_copy_only=False))
    wanted = known[0].has(phrase_hash(lang, [hashes])) if len(words) else np.zeros(0, bool)
    pos = np.flatnonzero(wanted[codes])
    blocks = n // BLOCK + 2
    padded = np.zeros(blocks * BLOCK, bool)
    padded[:n] = first
    begins = np.packbits(padded, bitorder="little").view("<u2")
    one = Bitmaps(codes[pos].astype(np.int64), pos // BLOCK, np.uint16(1) << (pos % BLOCK).astype(np.uint16), blocks)
    # The words' bitmaps by block: those that an extension's block can be ANDed with.
    by_block = np.argsort(one.block, kind="stable")
    block_code, block_mask = one.owner[by_block], one.mask[by_block]
    count = np.bincount(one.block, minlength=blocks)
    begin = np.cumsum(count) - count

    def extend(bits: Bitmaps, phrases: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """phrases: word codes, a row for each owner in bits."""
        depth = phrases.shape[1] + 1
        after = bits.shifted(begins)
        times = count[after.block]
        left = np.repeat(np.arange(len(after.block)), times)
        right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + begin[after.block][left]
        met = after.mask[left] & block_mask[right]
        hit = np.flatnonzero(met)
        left, right, met = left[hit], right[hit], met[hit]
        pair, owner = np.unique(after.owner[left] * len(words) + block_code[right], return_inverse=True)
        longer = np.column_stack([phrases[pair // len(words)], pair % len(words)])
        good = np.ones(len(pair), bool)
        if depth > 2:
            good = known[depth - 2].has(phrase_hash(lang, [hashes[longer[:, k]] for k in range(1, depth)]))
        if depth < length:
            good &= known[depth - 1].has(phrase_hash(lang, [hashes[longer[:, k]] for k in range(depth)]))
        if depth == length:
            yield longer[good], np.bincount(owner, np.bitwise_count(met), len(pair)).astype(np.int64)[good]
        elif good.any():
            number = np.cumsum(good) - 1
            keep = good[owner]
            yield from extend(Bitmaps(number[owner[keep]], after.block[left][keep], met[keep], blocks), longer[good])

    at = 0
    while at < len(one.owner):
        # Whole words only, a word with more blocks than a group alone.
        stop = np.searchsorted(one.owner, one.owner[min(at + GROUP_ENTRIES, len(one.owner) - 1)], "right" if at + GROUP_ENTRIES >= len(one.owner) else "left")
        stop = stop if stop > at else np.searchsorted(one.owner, one.owner[at], "right")
        group = one.take(slice(at, stop))
        own, group.owner = np.unique(group.owner, return_inverse=True)
        for phrases, counts in extend(group, own[:, None]):
            yield pc.binary_join_element_wise(*[words.take(pa.array(phrases[:, k])) for k in range(length)], " "), counts
        at = stop


def phrase_counts(docs: DataFrame, length: int, known: list) -> DataFrame:
    """lang, phrase, a of phrases of `length` words, summed over shards; for one word also a row with a null phrase, all words."""

    def run(batches):
        filters = [Filter(k.value) for k in known]
        for lang, raw in shards(batches):
            for phrases, counts in mine_shard(lang, raw, length, filters):
                for at in range(0, len(phrases), 1 << 16):
                    some = phrases.slice(at, 1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(some)), some, pa.array(counts[at : at + (1 << 16)].astype(np.int64))], ["lang", "phrase", "a"])
                if length == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.string()), pa.array([int(counts.sum())])], ["lang", "phrase", "a"])

    return docs.mapInArrow(lean(run), "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _part(length: int, start: int, stop: int):
    """Words start to stop of a phrase of `length` words."""
    return F.substring_index(F.substring_index("phrase", " ", stop), " ", start - stop)


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", longest: int = 3, least: int = 10, share: int = 50) -> DataFrame:
    """All phrases of 2 to `longest` words that occur `least` times in a language, but those nearly always within a longer one.

    A phrase goes if a longer candidate that contains it occurs at least share per cent as often. Columns: lang, phrase, a (its
    count), l and r (the counts of the parts of its lowest-scoring cut), n (all words of the language), score.
    """
    work = Workspace(df.sparkSession, "collocations")
    docs = df.select(F.coalesce(df[lang].cast("string"), F.lit("und")).alias("lang"), F.coalesce(df[text].cast("string"), F.lit("")).alias("text"))
    tables, known = [], []
    for k in range(1, longest + 1):
        sums = phrase_counts(docs, k, known)
        tables.append(work.write(sums.filter((F.col("a") >= least) | F.col("phrase").isNull()), f"length{k}"))
        if k < longest:
            known.append(build_filter(tables[-1].filter(F.col("phrase").isNotNull())))
    for k in known:
        k.unpersist()
    totals = tables[0].filter(F.col("phrase").isNull()).select("lang", F.col("a").alias("n"))
    part = lambda k, name: tables[k - 1].filter(F.col("phrase").isNotNull()).select("lang", F.col("phrase").alias(f"{name}_phrase"), F.col("a").alias(name))
    found = []
    for k in range(2, longest + 1):
        rows = tables[k - 1]
        cuts = []
        for c in range(1, k):
            rows = rows.withColumns({"l_phrase": _part(k, 0, c), "r_phrase": _part(k, c, k)})
            rows = rows.join(part(c, "l").hint("merge"), ["lang", "l_phrase"]).join(part(k - c, "r").hint("merge"), ["lang", "r_phrase"])
            score = F.expr(f"({SCALE} * cast(a as decimal(19, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
            rows = rows.withColumn(f"cut{c}", F.struct(score.alias("score"), F.lit(c).alias("k"), "l", "r")).drop("l", "r", "l_phrase", "r_phrase")
            cuts.append(F.col(f"cut{c}"))
        lowest = (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("cut")
        rows = rows.select("lang", "phrase", "a", lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        inner = [
            tables[m - 1].filter(F.col("phrase").isNotNull()).select("lang", _part(m, o, o + k).alias("phrase"), F.col("a").alias("around"))
            for m in range(k + 1, longest + 1) for o in range(m - k + 1)
        ]
        if inner:
            union = inner[0]
            for more in inner[1:]:
                union = union.union(more)
            most = union.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
            rows = rows.join(most.hint("merge"), ["lang", "phrase"], "left")
            rows = rows.filter(F.col("around").isNull() | (100 * F.col("around") < share * F.col("a"))).drop("around")
        found.append(rows)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return join_checked(out, totals, ["lang"]).select("lang", "phrase", "a", "l", "r", "n", "score")


def top_collocations(df: DataFrame, top: int = 2000, **settings) -> DataFrame:
    """The first `top` collocations of each language by score, count and phrase, with their rank."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(df, **settings).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
