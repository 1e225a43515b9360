import hashlib
import re

from pyspark.sql import functions as F

from tidemark.llm import fill_in_middle as fim

TEXTS = [
    None, "", " ", "\n\t ", "one", " one ", "two words", "a <P> b", "ends <", "< P>", "x\x1fy \x1b z\x1b1 \x1b0\x1f", "é ü 漢字 😀 \x85 word", "a b c",
    "tail  \n", "\x1f", "\x1b", "many " * 3000, "q" * 200_000, "<M>", *[f"text number {i} with some <b>units</b>\n and lines\r\n" for i in range(60)],
]


def by_definition(doc_id, text, rate=50, suffix_first=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, text
    if h[3] % 100 < suffix_first:
        return len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def rows_of(df):
    return {r["doc_id"]: tuple(r[c] for c in ("fim_n", "fim_form", "fim_prefix", "fim_middle", "fim_suffix", "fim_output")) for r in df.collect()}


def test_cuts_as_defined_and_restores(spark, docs):
    table = docs(list(enumerate(TEXTS)))
    assert rows_of(fim.transform(table)) == {i: by_definition(i, t) for i, t in enumerate(TEXTS)}
    every = fim.transform(table, rate=100, suffix_first=30)
    assert rows_of(every) == {i: by_definition(i, t, 100, 30) for i, t in enumerate(TEXTS)}
    assert {r["fim_form"] for r in every.collect()} == {"plain", "psm", "spm"}
    back = every.select("doc_id", fim.restore(F.col("fim_output"), F.col("fim_form")).alias("text"))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_other_columns_repeats_and_null_keys(spark, docs):
    table = docs([(1, "a b c"), (1, "a b c"), (None, "d e f")]).withColumn("fim_n", F.lit("old")).withColumn("extra", F.lit(7))
    out = fim.transform(table)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "fim_n", "fim_form", "fim_prefix", "fim_middle", "fim_suffix", "fim_output"]
    got = out.collect()
    assert len(got) == 3 and got[0] == got[1] and got[2]["fim_n"] == 3
    assert fim.transform(docs([])).count() == 0


def test_plan_has_neither_python_nor_shuffle(docs):
    plan = fim.transform(docs([(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
