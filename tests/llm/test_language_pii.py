import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import language_id, pii

WORDS = {"en": "the and of with that from thing other", "de": "und der die nicht eine werden über schön", "fr": "les des une être avec où déjà très", "es": "los las una ser con año niño está"}


def corpus(n=200):
    r = random.Random(3)
    return [(i, " ".join(r.choices(WORDS[x].split(), k=12)), x) for i in range(n) for x in [r.choice(sorted(WORDS))]]


def test_held_out_accuracy_and_unknowns(docs):
    rows = corpus() + [(1000, None, "en"), (1001, "12 !! 34", "en"), (1002, "", None), (1003, "und der " * 20_000, None), (None, "avec les", None)]
    df = docs(rows)
    got = language_id.predict(df.selectExpr("*", "1 AS score", "2 AS lang_pred"), language_id.fit(df))
    assert got.columns[-2:] == ["_lang_pred", "_score"]
    got = got.withColumn("held", language_id.is_held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held"] and r["lang"] and (r["doc_id"] or 0) < 1000]
    assert len(held) > 20 and sum(r["lang"] == r["_lang_pred"] for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["_lang_pred"] for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "de", "fr"]
    assert all(0 <= r["_score"] <= 1 for r in got)


def test_labels_decide_what_is_learned(docs):
    none = docs([(1, "some text")])
    assert language_id.predict(none, language_id.fit(none)).first()["lang_pred"] == "und"
    one = docs([(i, "some text", "xx") for i in range(8)])
    assert {r["lang_pred"] for r in language_id.predict(one, language_id.fit(one)).collect()} == {"xx"}
    assert language_id.predict(docs([]), language_id.fit(docs([]))).count() == 0


def test_any_number_of_languages(docs, monkeypatch):
    """200 languages, most of them unlisted: families from the data, all learned and told apart; only the predicted family's machines run."""
    r = random.Random(11)
    listed = sorted(language_id.FAMILY_OF)
    names = listed + [f"x{i:03}" for i in range(200 - len(listed))]
    vocabulary = {x: ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 7))) for _ in range(12)] for x in names}
    rows = [(200 * k + i, " ".join(r.choices(vocabulary[x], k=30)), x) for k in range(5) for i, x in enumerate(names)]
    df = docs(rows)
    model = language_id.fit(df)
    learned = {x for i, _, x in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert {*model.languages} == learned and len(learned) >= 198
    made = Counter(f for x, f in model.family_of.items() if x not in language_id.FAMILY_OF)
    assert len(made) > 10 and max(made.values()) <= language_id.GROUP
    assert len(model.machines) < 2500
    sizes = []
    monkeypatch.setattr(language_id.LanguageModel, "_margins", lambda self, group, groups, bounds, f=language_id.LanguageModel._margins: sizes.append((group, len(bounds) - 1)) or f(self, group, groups, bounds))
    got, _ = model.predict([t for _, t, _ in rows])
    assert sum(n for g, n in sizes if g != "family") == len(rows)  # each text in one family only
    assert sum(p == x for p, (_, _, x) in zip(got, rows, strict=True) if x in learned) >= 0.99 * sum(x in learned for *_, x in rows)


def spans(text):
    return [(k, text[s:e]) for k, s, e, _ in pii.find_spans(text)]


def test_checks_confirm_proposals():
    assert spans("é a.b@x.co, c@d 1.2.3.256 10.0.0.1.9") == [("email", "a.b@x.co"), ("ip", "10.0.0.1")]
    assert spans("4111 1111 1111 1111") == [("card", "4111 1111 1111 1111")]
    assert spans("4111 1111 1111 1112") == []
    assert spans("+1 (523) 555-1055 now, +1 2 3") == [("phone", "+1 (523) 555-1055")]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in spans("pay to GB82 WEST 1234 5698 7654 32.")
    assert spans("GB82 WEST 1234 5698 7654 33") == []
    assert spans("@" * 50 + "a@b@c.de") == [("email", "b@c.de")]


def test_context_words_adjust():
    assert spans("order 123-45-6789") == []
    assert spans("my ssn is 123-45-6789") == [("ssn", "123-45-6789")]
    assert spans("call 555-123-4567") == [("local_phone", "555-123-4567")]
    assert spans("call of nothing " + "x " * 40 + "555-123-4567") == []


def test_table(docs):
    df = docs([(1, None), (2, ""), (None, "a@b.cd"), (3, "z " * 200_000 + "a@b.cd")]).withColumn("found", F.lit(1))
    got = {r["doc_id"]: len(r["found"]) for r in pii.find_pii(df).collect()}
    assert got == {1: 0, 2: 0, None: 1, 3: 1}
    assert pii.redact("mail a@b.cd or 10.0.0.1") == "mail <email> or <ip>"
    assert pii.find_pii(docs([])).count() == 0
