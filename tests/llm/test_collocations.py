import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import collocations as co


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counts_by_definition(texts, length):
    return Counter(" ".join(w[i : i + length]) for t in texts for w in pieces(t) for i in range(len(w) - length + 1))


def collocations_by_definition(rows, longest=3, least=10, share=50, top=2000):
    by_lang = defaultdict(list)
    for lang, text in rows:
        by_lang["und" if lang is None else lang].append(text)
    out = []
    for lang, texts in by_lang.items():
        f = Counter()
        for k in range(1, longest + 1):
            f.update(counts_by_definition(texts, k))
        n = sum(c for p, c in f.items() if " " not in p)
        cand = {p: c for p, c in f.items() if " " in p and c >= least}
        found = []
        for p, a in cand.items():
            w = p.split(" ")
            score, k, left, right = min((1_000_000 * a * a // (f[x] * f[y]), k, f[x], f[y]) for k in range(1, len(w)) for x, y in [(" ".join(w[:k]), " ".join(w[k:]))])
            if not any(len(q) > len(p) and f" {p} " in f" {q} " and 100 * c >= share * a for q, c in cand.items()):
                found.append((-score, -a, p.encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def random_texts(n, seed, words=12):
    pick = random.Random(seed)
    vocabulary = ["The", "of", "é", "x-y", "漢字", "a_very_long_word" * 20, *[f"w{i}" for i in range(words)]]
    return ["".join(pick.choice(vocabulary) + pick.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\r\n", "!? ", "\x1c "]) for _ in range(pick.randint(0, 80))) for _ in range(n)]


class Everything:
    def has(self, h):
        return np.ones(len(h), bool)


@pytest.mark.parametrize("group", [3, 1 << 15])
def test_bitmaps_count_as_plain_loops(monkeypatch, group):
    monkeypatch.setattr(co, "GROUP_ENTRIES", group)
    for seed in range(4):
        texts = random_texts(30, seed)
        raw = "\n".join(texts).encode()
        for length in (1, 2, 3, 4):
            got = Counter()
            for phrases, n in co.mine_shard("en", raw, length, [Everything()] * length):
                got.update(dict(zip(phrases.to_pylist(), n.tolist(), strict=True)))
            assert got == counts_by_definition(texts, length)
    assert list(co.mine_shard("en", b"", 2, [Everything()] * 2)) == []


def test_shards_cut_between_pieces():
    text = b"one two three. four five\nsix " + b"x" * 50 + b" seven, eight"
    for most in (5, 12, 20, 1000):
        cut = list(co.pieces_of(text, most))
        assert b"".join(cut) == text
        assert sum((Counter(counts_by_definition([c.decode()], 2)) for c in cut), Counter()) == counts_by_definition([text.decode()], 2)
    assert list(co.pieces_of(b"no end of a piece here", 4)) == [b"no end of a piece here"]


def test_collocations_by_plain_loops(spark, docs):
    texts = random_texts(160, 9) + ["New York City. " * 15, "new york " * 4, None, "", "  ,.", "new york city"] * 2
    rows = [(i, t, [None, "und", "en", "fr"][i % 4]) for i, t in enumerate(texts)]
    want = collocations_by_definition([(lang, t) for _, t, lang in rows])
    table = docs(rows).selectExpr("*", "1 AS phrase", "2 AS a")
    got = sorted(tuple(r) for r in co.top_collocations(table).collect())
    assert got == want and {"en", "und"} <= {r[0] for r in got}
    longer = sorted(tuple(r) for r in co.top_collocations(docs(rows), top=5, longest=4, least=4, share=30).collect())
    assert longer == collocations_by_definition([(lang, t) for _, t, lang in rows], 4, 4, 30, 5)


def test_empty_and_wordless_tables(spark, docs):
    assert co.top_collocations(docs([])).count() == 0
    assert co.top_collocations(docs([(1, None), (2, " . ")])).count() == 0


def test_scores_stay_exact_past_64_bits(spark):
    rows = spark.createDataFrame([(999_999_999_999_989, 999_999_999_999_998, 999_999_999_999_997)], "a long, l long, r long")
    div = "(1000000 * cast(a as decimal(19, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    a, left, right = rows.first()
    assert rows.selectExpr(div).first()[0] == 1_000_000 * a * a // (left * right)
