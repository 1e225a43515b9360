import os
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import packing, token_files
from tidemark.llm.common import Workspace
from tidemark.llm.tokenizing import default_tokenizer, encoder

os.environ["TOKENIZERS_PARALLELISM"] = "false"
ENC = encoder(default_tokenizer())


def plain(text, end):
    return [*ENC.tok.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


PARTS = ["a", "bc", "é", " ", "  ", "\n", "\t", "'", "'s", "'re", "12", "!", "??", "　", "日本", "😀", "\x1c", "<|endoftext|>", "Ᲊ", "'ll", "\r\n"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), st.text(max_size=20).filter(lambda t: t.isprintable())), max_size=5))
def test_ids_equal_the_library(texts):
    ids, counts = ENC.encode(texts)
    want = [plain(t, 0)[:-1] for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [x for w in want for x in w]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]), max_size=40))
def test_rank_code_round_trip(ranks):
    control, data = token_files.encode_ranks(np.array(ranks, np.uint32))
    assert len(control) == -(-len(ranks) // 4)
    assert token_files.decode_ranks(control, data, len(ranks)).tolist() == ranks


ROWS = [(7, "The cat sat on the mat. " * 40), (2, None), (3, ""), (5, "wörd " * 9000), (5, "wörd " * 9000), (None, "x"), (1, "It's 12 o'clock\n\n now")]


def test_token_files_round_trip(spark, docs):
    path = f"{Workspace(spark, 'test_files').path}/set"
    token_files.write_token_files(docs(ROWS).selectExpr("*", "1 AS part", "2 AS ids"), path)
    got = [tuple(r) for r in token_files.read_token_files(spark, path).orderBy("start").collect()]
    want, start = [], 0
    for doc_id, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(text, 0)
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_token_files_of_nothing(spark, docs):
    path = f"{Workspace(spark, 'test_files').path}/set"
    token_files.write_token_files(docs([]), path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_packing_places_every_piece(docs):
    got = packing.pack_documents(docs(ROWS), with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert crc(np.frombuffer(bytes(r["ids"]), "<u4")) == r["ids_crc32"]
    for doc_id, text in ROWS:
        ids = plain(text, 2)
        own = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        times = sum(d == doc_id for d, _ in ROWS)
        assert [r["length"] for r in own[::times]] == [n for _, n in packing.cut(len(ids), 1024)]
        assert all(crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in own)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack_documents(docs([])).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=200), st.integers(1, 5))
def test_open_bins(lengths, most):
    bins, used = packing.OpenBins(16, most), {}
    for n in lengths:
        k, offset = bins.place(n)
        assert used.get(k, 0) == offset and offset + n <= 16
        used[k] = offset + n
        assert bins.open <= most


def test_packing_is_near_the_fewest(docs):
    rows = [(i, "ab " * (1 + (i * 37) % 700)) for i in range(800)]
    got = packing.pack_documents(docs(rows)).collect()
    fewest = -(-sum(r["length"] for r in got) // 1024)
    assert len({r["sequence_id"] for r in got}) <= 1.02 * fewest + 1


def test_rows_without_ids_spread_over_ranges(spark, docs, tmp_path):
    rows = [(None, f"text {i}") for i in range(300)] + [(7, "same text")] * 300 + [(i, f"t {i}") for i in range(10, 60)]
    made = token_files._tokenize(docs(rows).repartition(4), default_tokenizer(), 0, 8).filter("n is not null")
    parts = made.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("ids")).collect()
    assert max(r["rows"] for r in parts) < 300 and sum(r["rows"] for r in parts) == 650
    ids = [r["doc_id"] for r in made.orderBy("part", "seq").collect()]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    token_files.write_token_files(docs(rows), str(tmp_path / "set"))
    back = token_files.read_token_files(spark, str(tmp_path / "set"))
    assert back.count() == 650 and back.filter("doc_id = 7").select("ids_crc32").distinct().count() == 1
