import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import anchors, substring_dedup, suffix_dedup
from tidemark.llm.common import Workspace


def words_by_brute_force(rows, size):
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for (doc_id, _), w in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def bytes_by_brute_force(rows, size):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            s = raw[i : i + size]
            if s in seen:
                gone[i : i + size] = b"\x01" * size
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc_id, len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = ["a", "bé", "cc", "the", "of", "xyz", "Q", "ñu"] + [f"w{i}" for i in range(60)]
    text = lambda k: "".join(r.choice(vocab) + r.choice([" ", " ", "\n", "\t "]) for _ in range(k))
    passages = [text(r.randint(10, 60)) for _ in range(5)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.2 and rows:
            t = list((rows[r.randrange(len(rows))][1] or " ").split(" "))
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(vocab)
            body = " ".join(t)
        else:
            body = "".join(r.choice(passages) if r.random() < 0.3 else text(r.randint(1, 60)) for _ in range(r.randint(0, 4)))
        rows.append((i, body))
    rows += [(1000, None), (1001, ""), (1002, "a " * 300), (1003, "ab " * 5), (None, passages[0] + passages[1]), (1004, passages[2] * 3)]
    return rows


@pytest.mark.parametrize("seed,size,gram", [(1, 35, 9), (2, 35, 4), (3, 12, 9), (4, 9, 9), (5, 70, 9)])
def test_words(docs, seed, size, gram):
    rows = corpus(seed)
    got = substring_dedup.remove_repeats(docs(rows).selectExpr("*", "1 AS k", "2 AS at"), size, gram)
    assert sorted((tuple(r) for r in got.collect()), key=str) == words_by_brute_force(rows, size)


@pytest.mark.parametrize("seed,size,gathered,gram", [(1, 100, 1024, 32), (2, 100, 2, 16), (3, 100, 0, 32), (4, 30, 5, 16), (5, 16, 1024, 16)])
def test_bytes(docs, seed, size, gathered, gram):
    rows = corpus(seed)
    got = suffix_dedup.remove_earlier(docs(rows), size, gram, gathered)
    assert sorted((tuple(r) for r in got.collect()), key=str) == bytes_by_brute_force(rows, size)


@pytest.mark.parametrize("chunk", [256, 700, 1 << 19])
def test_anchors_of_long_texts(monkeypatch, chunk):
    """However texts are cut, equal windows have equal anchors at equal places, and each window is in one run."""
    monkeypatch.setattr(anchors, "CHUNK", chunk)
    scheme = anchors.Scheme("bytes", 100, 32)
    texts = [(k, d, (t or "").encode()) for k, (d, t) in enumerate(r for r in corpus(7) if r[0] is not None)]
    seen, windows = {}, set()
    for tokens, pieces in anchors.chunks(texts, "bytes", 100):
        for a, _, _, k, at, no in zip(*(c.tolist() for c in anchors.anchors_of(tokens, pieces, scheme)), strict=True):
            for i in range(no >> anchors.PLACE_BITS):
                assert (k, at + i) not in windows
                windows.add((k, at + i))
                key = (a, (no & ((1 << anchors.PLACE_BITS) - 1)) - i)
                assert seen.setdefault(texts[k][2][at + i : at + i + 100], key) == key
    assert windows == {(k, i) for k, _, t in texts for i in range(len(t) - 99)}


def test_radix_passes_order_suffixes():
    raw = b"banana bandana banana banded " * 6
    text, at = np.frombuffer(raw, np.uint8), np.arange(len(raw) - 20)
    alive, group = suffix_dedup.radix_groups(text, at, np.zeros(len(at), np.int64), 20)
    found = [raw[i : i + 20] for i in alive]
    assert found == sorted(found) and [a == b for a, b in zip(found, found[1:])] == (np.diff(group) == 0).tolist()
    assert Counter(found) == {s: n for s, n in Counter(raw[i : i + 20] for i in at).items() if n > 1}


def test_many_rows_without_id(docs):
    """Rows that share an id, or have none, are no hot key: each is a document of its own."""
    r = random.Random(5)
    texts = [" ".join(r.choices(["red", "blue", "tin", "oak", "sun"], k=60)) for _ in range(300)]
    for doc_id in (None, 7):
        rows = [(doc_id, t) for t in texts]
        got = substring_dedup.remove_repeats(docs(rows), 8, 4)
        assert sorted((tuple(r) for r in got.collect()), key=str) == words_by_brute_force(rows, 8)
        assert suffix_dedup.remove_earlier(docs(rows)).count() == 300


def test_repeated_rows_and_nothing(docs):
    same = "one two three four five six seven eight nine ten " * 12
    rows = [(1, same), (1, same), (2, "x")]
    got = sorted(tuple(r) for r in substring_dedup.remove_repeats(docs(rows), with_text=True).collect())
    assert [r[:3] for r in got] == [(1, 120, 120), (1, 120, 120), (2, 1, 0)] and got[2][4] == "x"
    got = sorted(tuple(r)[:4] for r in suffix_dedup.remove_earlier(docs(rows)).collect())
    assert [r for r in got if r[0] == 2] == [(2, 1, 0, 0)]
    assert sorted(r[2] for r in got if r[0] == 1)[1] == len(same)
    assert substring_dedup.remove_repeats(docs([])).count() == 0
    assert suffix_dedup.remove_earlier(docs([])).count() == 0


def test_levels_double():
    assert substring_dedup.levels(9, 35) == [18, 35] and substring_dedup.levels(9, 70) == [18, 36, 70]
    assert substring_dedup.first_offsets([18, 35]).tolist() == [0, 17]
    for length in (9, 12, 35, 70, 200):
        sizes = substring_dedup.levels(9, length)
        covered = {o + i for o in substring_dedup.first_offsets(sizes).tolist() for i in range(sizes[0])}
        assert covered == set(range(length))


def test_a_large_anchor_is_sorted_by_digit_passes(spark):
    """One anchor of 20,000 runs, of which some are equal, and one string that occurs 100,000 times."""
    hot = spark.range(100_000).selectExpr("5L AS a", "0L AS place", "cast(repeat('h', 40) AS binary) AS bytes", "id % 7 AS d", "1000 + id % 50 AS k", "id DIV 50 AS at")
    runs = spark.range(20_000).selectExpr("5L AS a", "0L AS place", "cast(concat(repeat('p', 20), lpad(cast(id % 19000 AS string), 20, '0')) AS binary) AS bytes", "id AS d", "id AS k", "3 * id AS at").selectExpr(
        "a", "place", "bytes", "d", "k", "at")
    table = hot.unionByName(runs).repartition(6)
    spans = suffix_dedup.later_suffixes(table, 40, Workspace(spark, "test_passes"), 12).collect()
    got = {(r["k"], r["at"] + i) for r in spans for i in range(r["n"])}
    first, every = {}, {}
    for r in table.collect():
        key = (r["d"], r["k"], r["at"])
        first[bytes(r["bytes"])] = min(first.get(bytes(r["bytes"]), key), key)
        every[key] = bytes(r["bytes"])
    assert got == {key[1:] for key, x in every.items() if first[x] != key}
    assert len(got) == 99_999 + 1_000 and len(spans) < 2_000


@pytest.mark.parametrize("line", [90, 180])
def test_a_line_among_many_texts_is_no_row_per_suffix(docs, monkeypatch, line):
    """A large anchor's runs become a few blocks each: no table of op4 has many more rows than the texts have anchors."""
    r = random.Random(line)
    letters = lambda n: "".join(r.choices("abcdefghij ", k=n))
    common, near = letters(line), letters(150)
    rows = [(i, letters(100) + common + letters(r.randint(60, 100))) for i in range(300)]
    rows += [(1000 + i, near[:140] + letters(10) + common) for i in range(100)]
    made, write = {}, Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, name, *codec: made.setdefault(name, [out := write(self, df, name, *codec), out.count()])[0])
    got = suffix_dedup.remove_earlier(docs(rows), gathered=40)
    assert sorted((tuple(x) for x in got.collect()), key=str) == bytes_by_brute_force(rows, 100)
    counts = {name: n for name, (_, n) in made.items()}
    assert "large" in counts or "suffixes" in counts, counts
    assert max(counts.values()) <= 2 * counts["anchors"], counts


@pytest.mark.parametrize("gathered", [0, 3, 20])
def test_blocks_lose_no_suffix(docs, gathered):
    """Texts that share all but one byte, at any place, through all levels of blocks and to single suffixes."""
    r = random.Random(9)
    base = "".join(r.choices("abcdefghij ", k=400))
    rows = [(i, base[: (p := r.randrange(400))] + r.choice("xyz") + base[p + 1 :]) for i in range(60)] + [(None, base), (7, base[100:300] * 2)]
    got = suffix_dedup.remove_earlier(docs(rows), gathered=gathered)
    assert sorted((tuple(x) for x in got.collect()), key=str) == bytes_by_brute_force(rows, 100)
    assert suffix_dedup.block_sizes(73) == [16, 4] and suffix_dedup.block_sizes(15) == [4] and suffix_dedup.block_sizes(1) == []
