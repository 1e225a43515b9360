import random
import zlib

import pytest

from tidemark.llm import toxicity as tox
from tidemark.llm.queries import QUERIES
from tidemark.llm.toxicity import END, LexiconAutomaton, Words

SMALL = "/root/testdata/sf0.01"


def distance_to_beginning(word, entry):
    """Least edits that make some beginning of the word the entry."""
    row = list(range(len(entry) + 1))
    best = row[-1]
    for i, ch in enumerate(word, 1):
        row = _next(row, i, ch, entry)
        best = min(best, row[-1])
    return best


def _next(row, i, ch, entry):
    out = [i]
    for k, x in enumerate(entry, 1):
        out.append(min(row[k] + 1, out[-1] + 1, row[k - 1] + (x != ch)))
    return out


def test_automaton_finds_what_edit_distances_say():
    pick = random.Random(3)
    entries = [("idiot", 6.0, 2.0), ("moron", 5.0, 1.0), ("scum", 4.0, 1.0), ("worthless", 5.5, 2.5), ("worms", 3.0, 1.5), ("fool", 2.0, 0.5), ("ass" + END, 3.0, 0.0), ("abcabcabc", 1.0, 0.8)]
    words = ["idiot", "idiots", "idi0t", "1diot", "idoit", "ldiot", "moooron", "morn", "mo*on", "scum", "skum", "wortless", "wrthles", "worthlessness", "ass", "asset", "assa", "as", "i", ""]
    for _ in range(600):
        w = list(pick.choice(entries)[0].strip(END) + pick.choice(["", "s", "ness"]))
        for _ in range(pick.randint(0, 3)):
            at = pick.randrange(len(w) + 1)
            w[at : at + pick.randint(0, 1)] = pick.choice(["", "a", "o", "x", "m"])
        words.append("".join(w))
    automaton = LexiconAutomaton(entries)
    laid = Words([" ".join(words)])
    found, entry, edits, value = automaton.scan(laid)
    got = {laid.word(i): (entries[k][0], e, v) for i, k, e, v in zip(found.tolist(), entry.tolist(), edits.tolist(), value.tolist(), strict=True)}
    fold = str.maketrans(tox.STAND_INS)
    for w in {x for x in words if x}:
        options = []
        for k, (letters, exact, edited) in enumerate(entries):
            read = w.translate(fold)
            if letters.endswith(END):
                options += [(exact, 0, -k)] if read == letters[:-1] else []
            elif (e := distance_to_beginning(read, letters)) <= automaton.edits_of(letters):
                options.append((exact if e == 0 else edited / e, -e, -k))
        best = max(options, default=None)
        assert (got.get(w) and got[w][2]) == (best and best[0]), w


def test_quotation_address_and_neutral_context():
    automaton = LexiconAutomaton([("idiot", 4.0, 2.0)])
    texts = ['he said "what an idiot that is" there', "you are an idiot", "such an idiot here", "she wrote idiot", 'a "mark" and an idiot', "", None, 'open " idiot\n" next', "«un idiot»"]
    sums = tox.sums_of(Words(texts), automaton)
    assert sums[:, :2].tolist() == [[0, 4], [5, 0], [4, 0], [0, 4], [4, 0], [0, 0], [0, 0], [4, 0], [0, 4]]


@pytest.fixture(scope="module")
def labelled(spark):
    pick = random.Random(5)
    vocabulary = ["".join(pick.choice("aeioubcdlmnprst") for _ in range(pick.randint(3, 9))) for _ in range(800)]
    abuse = ["jerkwad", "numbskull", "dirtbag"]
    rows, labels = [], []
    for i in range(800):
        w = [pick.choice(vocabulary) for _ in range(pick.randint(20, 60))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                w.insert(pick.randrange(len(w)), pick.choice(abuse))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(10_000 + i, rows[8][1] + f" {i}") for i in range(200)]  # copies of a toxic text
    labels += [(10_000 + i, 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), rows, dict(labels)


def test_learns_the_terms_and_catches_misspellings(spark, labelled):
    docs, labels, rows, truth = labelled
    model = tox.fit(docs, labels)
    assert {x[:6] for x, *_ in model.automaton.entries} >= {"jerkwa", "numbsk", "dirtba"}
    assert len(model.automaton.entries) <= 6  # copies alone make no entry
    out = {r["doc_id"]: r["predicted"] for r in tox.score(docs, model).collect()}
    held = [i for i, _ in rows if i < 10_000 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(out[i] == truth[i] for i in held) >= 0.98 * len(held)
    clean = rows[1][1]
    planted = [f"{clean} jerkwaad and numbskul x dirtbagg", f"{clean} j3rkwad numb5kull d1rtbag", clean]
    assert [s >= tox.THRESHOLD for s in model.score(planted)] == [True, True, False]


def test_undefined_cases(spark, labelled, docs):
    table, labels, *_ = labelled
    model = tox.fit(table, labels)
    odd = docs([(1, None), (2, ""), (2, ""), (3, "x" * 500_000), (None, "1 2 3 ퟿ ؟")]).selectExpr("*", "5 AS score", "6 AS predicted")
    got = tox.score(odd, model)
    assert got.columns == [*odd.columns, "_score", "_predicted"]
    assert len({r["_score"] for r in got.collect() if r["doc_id"] in (1, 2)}) == 1 and got.count() == 5
    assert tox.score(docs([]), model).count() == 0
    for empty in (labels.filter("toxic = 1"), labels.filter("toxic = 0"), labels.limit(0)):
        assert {r["score"] for r in tox.score(docs([(1, "jerkwad")]), tox.fit(table, empty)).collect()} == {0.0}
    assert tox.fit(docs([]), labels).coefficients is None


def test_held_out_scores_of_the_query(spark):
    out = QUERIES["op11_toxicity"](spark, SMALL)
    rows = out.join(spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic IS NOT NULL"), "doc_id").collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    hits = sum(r["predicted"] and r["toxic"] for r in held)
    assert hits / sum(r["toxic"] for r in held) >= 0.8 and hits / max(1, sum(r["predicted"] for r in held)) >= 0.75
