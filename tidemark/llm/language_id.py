"""Language identification in two steps: the family first, then the language within it.

Every decision is a linear support vector machine between two classes, over counts of hashed
letter groups of two and three bytes in lower case. Families are told apart first, each
against each; then only the machines of the predicted family run, each language against each other, votes first, ties by
the sum of margins. Machines are fitted one per task from a sample of at most SAMPLE_ROWS whole texts a language, the
first by a hash of doc_id. Any number of languages can be learned: those that FAMILIES does not list are put into
families of at most GROUP by the similarity of their mean letter groups, so that the machines within families grow
with the number of languages. Means (one a language) and fitted weights (one vector per pair of families and of languages of
one family, 64 KB each) are what reaches the driver.

Defined cases: text that is null or has no letter is `und` with score 0; with no labelled row
every text is `und`; with one learned language every text with a letter is that; texts of any
length are read whole; rows that repeat are predicted each; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, by_bytes, free_name, join_checked, lean

SAMPLE_ROWS = 400
GROUP = 8  # languages of a family made from the data
BUCKETS = 1 << 14
SCALE = 10.0  # of a text's shares of letter groups
EPOCHS = 20
COST = 10.0
UNKNOWN = "und"
BYTES_AT_ONCE = 1 << 20

#: Families by language code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "lb", "fy", "yi"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc", "la", "ast", "rm"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk", "tt"),
    "indic": ("hi", "ur", "bn", "pa", "mr", "gu", "ne"),
    "semitic": ("ar", "he", "am", "mt"),
    "sinitic": ("zh", "yue"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[[b for b in range(128) if not 97 <= b <= 122]] = 32


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def letter_groups(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all letter groups of the texts, joined, and where each text's begin (and the end)."""
    raw = [b" " + t.lower().encode("utf-8", "replace") + b"  " for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    b = _KEEP[np.frombuffer(b"".join(raw), np.uint8)].astype(np.uint32)
    second, third = np.roll(b, -1), np.roll(b, -2)
    three = (((b << np.uint32(16)) | (second << np.uint32(8)) | third) * np.uint32(2654435761)) >> np.uint32(18)
    letters = (b != 32) | (second != 32)
    at = np.flatnonzero(letters)
    return three[at].astype(np.int64) & (BUCKETS - 1), np.searchsorted(at, bounds)


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def training_rows(docs: DataFrame, work: Workspace, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, doc_id, text) of at most sample_rows ids for each language, those that come first by hash; one text an id."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id"))).select(
        "lang", F.col("doc_id").alias("id"), F.xxhash64("doc_id").alias("h")
    )
    n = work.write(rows.groupBy("lang").count(), "languages")
    # A first cut by hash leaves little more than sample_rows of each language for the window.
    part = F.least(F.lit(1.0), F.lit(1.5 * sample_rows + 200) / F.col("count"))
    cut = join_checked(rows, n, ["lang"]).filter(F.pmod("h", F.lit(1 << 30)) < part * (1 << 30)).distinct()
    first = Window.partitionBy("lang").orderBy("h", "id")
    picked = cut.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= sample_rows).select("lang", F.col("id").alias("doc_id"))
    picked = work.write(picked, "picked")
    texts = docs.filter(F.col("text").isNotNull()).select("lang", "doc_id", "text")
    return join_checked(texts, picked, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))


def fit_pair(counts: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM by dual coordinate descent, squared hinge loss."""
    w, alpha = np.zeros(BUCKETS + 1), np.zeros(len(sign))
    norms = np.array([1.0 + v @ v for v in values]) + 0.5 / COST
    order = np.random.RandomState(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(sign)):
            margin = w[counts[i]] @ values[i] + w[BUCKETS]
            step = max(alpha[i] - (sign[i] * margin - 1 + alpha[i] * 0.5 / COST) / norms[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w[counts[i]] += step * sign[i] * values[i]
                w[BUCKETS] += step * sign[i]
    return w


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    groups, _ = letter_groups([text])
    found, n = np.unique(groups, return_counts=True)
    return found, SCALE * n / max(1, len(groups))


def alike(names: list[str], means: np.ndarray) -> list[list[str]]:
    """Groups of at most GROUP languages: halves along the main direction of their means, until all are small enough."""
    if len(names) <= GROUP:
        return [names]
    x = means - means.mean(axis=0)
    _, vectors = np.linalg.eigh(x @ x.T)
    order = np.argsort(vectors[:, -1] * (1 if vectors[np.argmax(np.abs(vectors[:, -1])), -1] > 0 else -1), kind="stable")
    half = len(order) // 2
    return [g for part in (order[:half], order[half:]) for g in alike([names[i] for i in part], means[part])]


def families_of(sample: DataFrame, languages: list[str]) -> dict[str, str]:
    """Family by language: the listed ones, and groups of those that are alike; one group is named `other`."""
    out = {x: FAMILY_OF[x] for x in languages if x in FAMILY_OF}
    rest = sorted(x for x in languages if x not in FAMILY_OF)
    if len(rest) <= GROUP:
        return out | dict.fromkeys(rest, "other")

    def mean(key, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS)
        for t in rows.sort_values("doc_id")["text"]:
            found, share = features(t)
            total[found] += share
        return pd.DataFrame({"lang": [key[0]], "mean": [(total / len(rows)).astype("<f4").tobytes()]})

    known = [F.lit(x) for x in FAMILY_OF]
    means = {r["lang"]: np.frombuffer(bytes(r["mean"]), "<f4") for r in sample.filter(~F.col("lang").isin(*known)).groupBy("lang").applyInPandas(mean, "lang string, mean binary").collect()}
    groups = alike(rest, np.stack([means[x] for x in rest]).astype(float))
    return out | {x: f"other{i}" for i, g in enumerate(groups) for x in g}


class LanguageModel:
    """Fitted machines: for families and for the languages of each, (first, second, weights)."""

    def __init__(self, family_of: dict[str, str], machines: list[tuple[str, str, str, np.ndarray]]):
        self.family_of = family_of
        self.languages = sorted(family_of)
        self.families = sorted({*family_of.values()})
        self.machines = [(g, a, b) for g, a, b, _ in machines]
        self.weights = np.stack([w for *_, w in machines]).astype(np.float32) if machines else np.zeros((0, BUCKETS + 1), np.float32)
        self.of_group: dict[str, list[int]] = {}
        for j, (g, *_) in enumerate(self.machines):
            self.of_group.setdefault(g, []).append(j)

    def _choose(self, group: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner by votes, then margins; and how sure, as the mean of its sigmoid margins."""
        votes, sums, sure = (np.zeros((len(margins), len(names))) for _ in range(3))
        place = {x: i for i, x in enumerate(names)}
        for m, j in zip(margins.T, self.of_group.get(group, []), strict=True):
            _, a, b = self.machines[j]
            for who, value in ((place[a], m), (place[b], -m)):
                votes[:, who] += value > 0
                sums[:, who] += value
                sure[:, who] += 1 / (1 + np.exp(-np.clip(3 * value, -30, 30)))
        winner = np.argmax(votes + 1e-3 * np.tanh(sums), axis=1)
        return winner, sure[np.arange(len(margins)), winner] / (len(names) - 1) if len(names) > 1 else np.ones(len(margins))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        out, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        real = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        start = 0
        while start < len(real):
            stop, size = start, 0
            while stop < len(real) and (stop == start or size < BYTES_AT_ONCE):
                size += len(texts[real[stop]])
                stop += 1
            self._predict(texts, real[start:stop], out, scores)
            start = stop
        return out, scores

    def _margins(self, group: str, groups: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of the group's machines, for texts given as joined buckets."""
        n = np.maximum(1, np.diff(bounds))
        out = np.zeros((len(n), len(self.of_group.get(group, []))))
        for k, j in enumerate(self.of_group.get(group, [])):
            w = self.weights[j]
            sums = np.append(0.0, np.cumsum(w[groups], dtype=np.float64))
            out[:, k] = SCALE * (sums[bounds[1:]] - sums[bounds[:-1]]) / n + w[BUCKETS]
        return out

    def _predict(self, texts, some, out, scores) -> None:
        groups, bounds = letter_groups([texts[i] for i in some])
        family, sure = self._choose("family", self.families, self._margins("family", groups, bounds))
        for f, name in enumerate(self.families):
            own = np.flatnonzero(family == f)
            if len(own):
                names = [x for x in self.languages if self.family_of[x] == name]
                mine = np.concatenate([groups[bounds[i] : bounds[i + 1]] for i in own])
                ends = np.append(0, np.cumsum(bounds[own + 1] - bounds[own]))
                lang, within = self._choose(name, names, self._margins(name, mine, ends))
                for i, k, s in zip(own.tolist(), lang.tolist(), (sure[own] * within).tolist(), strict=True):
                    out[some[i]], scores[some[i]] = names[k], round(float(s), 6)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from text and lang of the rows that are not held out."""
    work = Workspace(docs.sparkSession, "language_id")
    sample = work.write(training_rows(docs, work, sample_rows), "sample")
    languages = [r["lang"] for r in sample.select("lang").distinct().collect()]
    family_of = families_of(sample, languages)
    members: dict[str, list[str]] = {}
    for x in sorted(languages):
        members.setdefault(family_of[x], []).append(x)
    pairs = [("family", a, b) for a in members for b in members if a < b]
    pairs += [(family, a, b) for family, names in members.items() for a in names for b in names if a < b]
    if not pairs:
        return LanguageModel(family_of, [])
    roles = [(g, a, b, x, sign) for g, a, b in pairs for c, sign in ((a, 1.0), (b, -1.0)) for x in (members[c] if g == "family" else [c])]
    table = docs.sparkSession.createDataFrame(roles, "grp string, a string, b string, lang string, sign double")

    def fit_group(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "lang"])
        made = [features(t) for t in rows["text"]]
        w = fit_pair([f for f, _ in made], [v for _, v in made], rows["sign"].to_numpy())
        return pd.DataFrame({"grp": [key[0]], "a": [key[1]], "b": [key[2]], "w": [w.astype("<f4").tobytes()]})

    fitted = join_checked(sample, table, ["lang"]).groupBy("grp", "a", "b").applyInPandas(fit_group, "grp string, a string, b string, w binary")
    machines = [(r["grp"], r["a"], r["b"], np.frombuffer(bytes(r["w"]), "<f4")) for r in fitted.collect()]
    return LanguageModel(family_of, sorted(machines, key=lambda m: m[:3]))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The columns of docs with lang_pred and score (underscores go before names that docs uses); only text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [free_name(docs.columns, "lang_pred"), free_name(docs.columns, "score")]

    def run(batches):
        for b in by_bytes(batches, "text"):
            langs, scores = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean(run), f"{fields}, {added[0]} string, {added[1]} double")
