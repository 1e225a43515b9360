import math
import random
import re
import time
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.oracle import assert_same
from tidemark.llm import language_id, pii
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, SF, QUERIES[name], ORACLE_SQL[name])


def base_by_definition(text):
    """The four base kinds by their patterns alone, over the whole text."""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                  "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans_follow_their_definition():
    r = random.Random(5)
    parts = ["a", "Z", "é", "@", ".", "-", "+", " ", "(", ")", "1", "22", "255", "256", "4111 1111 1111 1111", "10.0.0.1", "x@y.z", "+1 523 555 1055", "_", "%"]
    for _ in range(20_000):
        text = "".join(r.choices(parts, k=r.randint(0, 14)))
        assert [x[:3] for x in pii.find_spans(text) if x[0] in pii.BASE] == base_by_definition(text)


def test_pii_query_on_the_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op10_pii"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base_by_definition(texts[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]
        assert r["base_sha256"] == pii.span_digest([f"{k}:{s}:{e}" for k, s, e in want])
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(filter(None, r["spans"].split(",")))


@pytest.mark.parametrize("unit", ["1", "a", "@", ".", "1.", "1 ", "a@", "+1", "+1 ", "A1", "1-", "@a.", "a.b@c.d ", "555-123-4567 ", "1.2.3.4.", "-", " "])
def test_long_runs_take_linear_time(unit):
    started = time.process_time()
    text = unit * (1_000_000 // len(unit))
    for t in (text, "." + text + "@", "1." + text):
        pii.find_spans(t)
    assert time.process_time() - started < 30
    short = unit * (1500 // len(unit))
    for t in (short, "." + short + "@", "1." + short, short + "a@b.c"):
        assert [x[:3] for x in pii.find_spans(t) if x[0] in pii.BASE] == base_by_definition(t)


@pytest.mark.parametrize("rest", ["", " İp", " tip: version", "visaccount"])
def test_contexts_that_overlap_are_not_read_once_a_span(monkeypatch, rest):
    """Spans that no context word is near get the score that reading their contexts gives, without reading them."""
    text = rest + "1.2.3.4 a@b.c " * 500 + "xip" + "1.2.3.4 078-05-1120 " * 20 + rest
    read, score = [], pii.score
    monkeypatch.setattr(pii, "score", lambda *args: read.append(args) or score(*args))
    found = pii.find_spans(text)
    assert len(found) >= 1000 and all(v == score(text, k, s, e) for k, s, e, v in found)
    assert len(read) < 100 or "İ" in rest


def test_languages_by_plain_loops(spark):
    """The query's predictions are what the fitted machines give, text by text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in QUERIES["op9_language_id"](spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        r = got[doc_id]
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        raw = b" " + bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode()) + b"  "
        count = Counter()
        for i in range(len(raw)):
            b, c, d = (raw[(i + j) % len(raw)] for j in range(3))
            if (b, c) != (32, 32):
                count[((b << 16 | c << 8 | d) * 2654435761 % 2**32) >> 18] += 1
        total = sum(count.values())
        margin = [sum(float(w[g]) * n for g, n in count.items()) * language_id.SCALE / total + float(w[-1]) for w in model.weights]

        def choose(group, names):
            votes, sums, sure = Counter(), Counter(), Counter()
            for (g, a, b), m in zip(model.machines, margin, strict=True):
                for who, value in ((a, m), (b, -m)) if g == group else ():
                    votes[who] += value > 0
                    sums[who] += value
                    sure[who] += 1 / (1 + math.exp(-max(-30, min(30, 3 * value))))
            best = max(names, key=lambda x: votes[x] + 1e-3 * math.tanh(sums[x]))
            return best, sure[best] / (len(names) - 1) if len(names) > 1 else 1.0

        family, one = choose("family", model.families)
        lang, two = choose(family, [x for x in model.languages if model.family_of[x] == family])
        assert r["lang_pred"] == lang and abs(r["score"] - one * two) < 1e-4


def library_ids(spark, end):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(d, [*tok.encode(t or "", add_special_tokens=False).ids, end]) for d, t in rows]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_pieces_by_the_library(spark):
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in QUERIES["op5_best_fit_packing"](spark, SF).collect()}
    want = {}
    for doc_id, ids in library_ids(spark, 2):
        cuts = list(range(len(ids), 0, -1024))[::-1]
        for piece, (s, e) in enumerate(zip([0, *cuts], cuts, strict=False)):
            want[doc_id, piece] = (s, e - s, crc(ids[s:e]))
    assert got == want


def test_token_files_by_the_library(spark):
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op6_token_files"](spark, SF).collect())
    want, start = [], 0
    for doc_id, ids in library_ids(spark, 0):
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_held_out_languages(spark):
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op9_language_id"](spark, SMALL).join(truth, "doc_id").filter(F.col("held_out") & F.col("lang").isNotNull())
    right, n = got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert n > 150 and right >= 0.97


def test_sequences_are_near_the_fewest(spark):
    got = QUERIES["op5_best_fit_packing"](spark, SMALL)
    r = got.agg(F.count_distinct("sequence_id").alias("used"), F.sum("length").alias("tokens")).first()
    assert r["used"] <= 1.01 * math.ceil(r["tokens"] / 1024) + 1
    bad = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("k"), F.count(F.lit(1)).alias("m"))
    assert bad.filter("n > 1024 OR n <> end OR k <> m").count() == 0
