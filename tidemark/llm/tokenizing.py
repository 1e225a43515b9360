"""Token ids of whole texts by a public byte-level BPE tokenizer.

The tokenizer's own pre-tokenizer cuts a text into words that are encoded independently, so a
batch of texts is cut by array operations on code points, each distinct word is encoded once
by the tokenizers library, and the ids of all words are gathered. A worker keeps the ids of
words it has met, up to WORDS_KEPT distinct words, after which it starts anew: that
bounds memory and changes no result. Texts that hold an added token's string or a code point
that this Python's Unicode tables lack, and tokenizers with another pre-tokenizer, go to the
library as they are.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np

from tidemark.llm.hashing import CHUNK, powers

WORDS_KEPT = 400_000
CHARS_AT_ONCE = 1 << 19
WORDS_AT_ONCE = 1 << 13

# Classes of code points.
OTHER, LETTER, NUMBER, SPACE, UNASSIGNED = 0, 1, 2, 3, 4
#: The white space code points of Unicode's White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions that the pre-tokenizer cuts off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_MULT = np.uint64(0x9E3779B97F4A7C15)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))
        table[cp] = UNASSIGNED if kind == "Cn" else kinds.get(kind[0], OTHER)
    table[WHITE] = SPACE
    return table


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokenizer's words in joined texts; first: the texts' own starts, each before the end."""
    n = len(points)
    kind = _classes()[points]
    text_start = np.zeros(n + 1, bool)
    text_start[first] = True
    text_start[n] = True
    start = text_start[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    plain = points == 32
    # White space before a word: its last character stands apart, and a last plain space joins the word.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~text_start[1:n]
    start |= last
    after = np.flatnonzero(last & plain) + 1
    start[after] = False
    # An apostrophe that starts a word cuts off a contraction.
    for at in np.flatnonzero((points == 39) & start):
        if at + 1 < n and kind[at + 1] == LETTER and not text_start[at + 1]:
            tail = points[at + 1 : at + 3]
            one = chr(tail[0])
            two = one + chr(tail[1]) if len(tail) > 1 and not text_start[at + 2] else ""
            size = 1 if one in CONTRACTIONS else 2 if two in CONTRACTIONS else 0
            if size:
                start[at + 1] = False
                if at + 1 + size < n:
                    start[at + 1 + size] = True
    return np.flatnonzero(start)


class Encoder:
    """encode(texts) -> (ids of all texts joined, number of ids of each)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_word = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        )
        self.line_end = self.plain(["\n"])[0][0] if self.by_word else None
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of known words
        self.at = np.zeros(0, np.int64)  # where their ids begin in ids
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words joined and the number of each, from encodings of many with a line end after each."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for i in range(0, len(words), WORDS_AT_ONCE):
            some = words[i : i + WORDS_AT_ONCE]
            got = np.array(self.plain(["\n".join(some) + "\n"])[0], np.uint32)
            ends = np.flatnonzero(got == self.line_end)
            if len(ends) == len(some):
                ids.append(np.delete(got, ends))
                counts.append(np.diff(ends, prepend=-1).astype(np.int32) - 1)
            else:
                found = self.plain(some)
                ids.append(np.array([x for f in found for x in f], np.uint32))
                counts.append(np.fromiter(map(len, found), np.int32, len(found)))
        return np.concatenate(ids), np.concatenate(counts)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(texts), np.int64)
        pieces: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        group: list[int] = []
        chars = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.by_word or any(a in t for a in self.added):
                pieces[i] = np.array(self.plain([t])[0], np.uint32)
                continue
            if group and chars + len(t) > CHARS_AT_ONCE:
                self._group(texts, group, pieces)
                group, chars = [], 0
            group.append(i)
            chars += len(t)
        if group:
            self._group(texts, group, pieces)
        for i, p in enumerate(pieces):
            counts[i] = len(p)
        return (np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)), counts

    def _group(self, texts: list[str], group: list[int], pieces: list[np.ndarray]) -> None:
        joined = "".join(texts[i] for i in group)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = np.cumsum([0, *(len(texts[i]) for i in group)])
        unsure = np.flatnonzero(_classes()[points] == UNASSIGNED)
        if len(unsure):
            direct = {group[j] for j in np.searchsorted(first, unsure, "right") - 1}
            for i in direct:
                pieces[i] = np.array(self.plain([texts[i]])[0], np.uint32)
            if rest := [i for i in group if i not in direct]:
                self._group(texts, rest, pieces)
            return
        starts = word_starts(points, first[:-1])
        ends = np.append(starts[1:], len(points))
        power, inverse = powers(max(CHUNK + 4096, 1 << int(len(points)).bit_length()))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_mixed(points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=sums[1:])
        hashes = _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MULT)
        unique, example, back = np.unique(hashes, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = slot < len(self.keys)
        known[inside] = self.keys[slot[inside]] == unique[inside]
        if not known.all():
            if len(self.keys) > WORDS_KEPT:
                self.forget()
                known[:] = False
            self._learn(joined, unique[~known], starts[example[~known]], ends[example[~known]])
            slot = np.searchsorted(self.keys, unique)
        begin, size = self.at[slot][back], self.count[slot][back].astype(np.int64)
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(begin - (upto - size), size) + np.arange(upto[-1])]
        bounds = np.append(0, upto)[np.searchsorted(starts, first)]
        for j, i in enumerate(group):
            pieces[i] = ids[bounds[j] : bounds[j + 1]]

    def _learn(self, joined: str, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        words = [joined[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        # Between line ends words keep their cuts, so one call encodes many. White space would not: it goes alone.
        blank = np.fromiter(map(str.isspace, words), bool, len(words))
        order = np.concatenate([np.flatnonzero(~blank), np.flatnonzero(blank)])
        ids, count = self._many([w for w in words if not w.isspace()])
        alone = self.plain([w for w in words if w.isspace()])
        keys = keys[order]
        count = np.concatenate([count, np.fromiter(map(len, alone), np.int32, len(alone))])
        at = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids, np.array([x for f in alone for x in f], np.uint32)])
        order = np.argsort(keys)
        keys, at, count = keys[order], at[order], count[order]
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.count = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.count, where, count)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, with the words it met in earlier tasks (some 30 bytes each)."""
    return Encoder(path)
