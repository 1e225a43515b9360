"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, with scores by context.

Lexicon. From a sample of labelled rows, word beginnings (and whole words of three letters) that toxic
texts use more often than others, by Dunning's likelihood ratio over distinct words of a text; of nested
beginnings the most telling stays. Copies count once (texts that share their least hash of three words).
The entries form a trie. The Levenshtein automata of all entries are intersected with it: a state is the set of
(trie node, edits so far) that a word's letters can have reached, made when first met, and one
table of transitions steps all words of a batch letter by letter, most of which end after a few.
Entries of five letters or more allow one edit, of nine or more two; digits and signs that stand for
letters are read as such. Endings after an entry are free.

Context. A hit within quotation marks of its line, or up to three words after a reporting word, counts as quotation; one
near a word of address counts a quarter more. A logistic model turns a text's sums of weights (abuse, quotation) and
length into a score; its sample scores come from lexicons that the other half of the sample gave.

The sample is at most SAMPLE_ROWS rows of each label, the first by a hash of doc_id. Only the lexicon
(CANDIDATES rows at most) and five numbers a sample row reach the driver. Scoring reads each text once, without a shuffle.

Defined cases: null and empty texts get the score of a text without words; without labels of both
kinds every score is 0; labels other than 0 count as 1, the highest of an id's labels holds; texts are
read whole; rows that repeat are scored each; empty tables give empty results; added columns get
underscores before names that the caller uses.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, by_bytes, free_name, lean
from tidemark.llm.language_id import is_held_out

SAMPLE_ROWS = 4000  # of each label
CANDIDATES = 20_000  # word beginnings that reach the driver
ENTRIES = 1024  # of the lexicon
LEAST_RATIO = 25.0  # likelihood ratio of an entry
LEAST_TEXTS = 3  # toxic texts that use it
SHORTEST, LONGEST = 3, 12  # letters of an entry
THRESHOLD = 0.3
WINDOW, NEAR = 5, 3  # words of context; words within which reporting words count
ADDRESSED = 1.25
STATES_KEPT = 20_000
END = "\0"

#: Digits and signs that stand for letters; the signs only between letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
SIGNS = "@$*"
QUOTES = "\"“”„‟«»"
#: Words that report what others said, and words that address the reader.
REPORTING = frozenset(
    "said says wrote writes called calls named quote quoted quotes cited word words term terms phrase sagte schrieb nannte wort begriff zitat zitierte dijo "
    "escribió llamó palabra cita dit écrit appelé mot citation".split()
)
ADDRESS = frozenset("you your yours youre u ur du dich dir dein deine ihr euch euer tú tu te ti eres usted ustedes vosotros toi ton ta vous votre".split())


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the letter that it is read as, and whether it belongs to words."""
    letter = np.arange(0x110000, dtype=np.uint32)
    inside = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    for sign, as_letter in STAND_INS.items():
        letter[ord(sign)] = ord(as_letter)
    return letter, inside


class Words:
    """The words of texts joined by line ends: code points as read, bounds of words, and each word's text."""

    def __init__(self, texts: list[str | None]):
        raw = ["\n" + (t or "").lower() for t in texts]
        self.bounds = np.cumsum([0, *map(len, raw)])
        self.points = np.frombuffer("".join([*raw, "\n"]).encode("utf-32-le", "surrogatepass"), "<u4")
        letter, inside = _tables()
        part = inside[self.points]
        sign = np.isin(self.points, np.array([*map(ord, SIGNS)], np.uint32))
        sign[1:-1] &= part[:-2] & part[2:]
        part |= sign
        edge = np.diff(np.concatenate([[False], part, [False]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.read = np.where(part, letter[self.points], 0)
        self.text_of = np.searchsorted(self.bounds, self.start, "right") - 1

    def word(self, i: int) -> str:
        return self.points[self.start[i] : self.end[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")

    def distinct(self) -> list[set[str]]:
        """Each text's different words as read."""
        whole = self.read.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        out: list[set[str]] = []
        first = np.searchsorted(self.text_of, np.arange(len(self.bounds)))
        for i in range(len(self.bounds) - 1):
            a, b = self.bounds[i], self.bounds[i + 1]
            out.append(set(whole[a:b].split(END)) - {""} if first[i] < first[i + 1] else set())
        return out


class LexiconAutomaton:
    """The trie of entries intersected with their Levenshtein automata, made deterministic as words ask for it."""

    def __init__(self, entries: list[tuple[str, float, float]]):
        """entries: (letters, weight of an exact hit, of one with an edit); letters that end with END are whole words."""
        self.entries = entries
        self.children: list[dict[int, int]] = [{}]
        self.entry_at, self.edits_below = [-1], [0]
        for k, (letters, *_) in enumerate(entries):
            node, edits = 0, self.edits_of(letters)
            self.edits_below[0] = max(self.edits_below[0], edits)
            for ch in map(ord, letters):
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.entry_at.append(-1)
                    self.edits_below.append(0)
                node = self.children[node][ch]
                self.edits_below[node] = max(self.edits_below[node], edits)
            self.entry_at[node] = k
        letters = sorted({ch for c in self.children for ch in c} - {0})
        self.alphabet = [0, -1, *letters]  # class 0: the end of a word, class 1: any other letter
        self.class_of = np.ones(0x110000, np.int32)
        self.class_of[0] = 0
        self.class_of[letters] = np.arange(2, len(self.alphabet))
        self.forget()

    @staticmethod
    def edits_of(letters: str) -> int:
        return 0 if letters.endswith(END) else (len(letters) >= 5) + (len(letters) >= 9)

    def __getstate__(self):
        return self.entries

    def __setstate__(self, entries):
        self.__init__(entries)

    def forget(self) -> None:
        self.sets: list[dict[int, int]] = []
        self.known: dict[frozenset, int] = {}
        self.step = np.full((256, len(self.alphabet)), -1, np.int32)
        self.hit, self.edits, self.value = np.full(256, -1, np.int32), np.zeros(256, np.int32), np.zeros(256)
        self.state({})
        self.state(self.closed({0: 0}))

    def closed(self, at: dict[int, int]) -> dict[int, int]:
        """With letters of entries that the word leaves out; node: least edits."""
        todo = [*at.items()]
        while todo:
            node, e = todo.pop()
            for ch, child in self.children[node].items():
                if ch and e < self.edits_below[child] and e + 1 < at.get(child, 9):
                    at[child] = e + 1
                    todo.append((child, e + 1))
        return at

    def state(self, at: dict[int, int]) -> int:
        key = frozenset(at.items())
        if key in self.known:
            return self.known[key]
        s = self.known[key] = len(self.sets)
        self.sets.append(at)
        if s == len(self.step):
            self.step = np.concatenate([self.step, np.full_like(self.step, -1)])
            self.hit, self.edits, self.value = (np.concatenate([x, fill(x)]) for x, fill in ((self.hit, lambda x: np.full_like(x, -1)), (self.edits, np.zeros_like), (self.value, np.zeros_like)))
        for node, e in at.items():
            k = self.entry_at[node]
            if k >= 0 and e <= self.edits_of(self.entries[k][0]):
                value = self.entries[k][1] if e == 0 else self.entries[k][2] / e
                if self.hit[s] < 0 or (value, -e, -k) > (self.value[s], -self.edits[s], -self.hit[s]):
                    self.hit[s], self.edits[s], self.value[s] = k, e, value
        return s

    def move(self, s: int, c: int) -> int:
        letter, out = self.alphabet[c], {}
        for node, e in self.sets[s].items():
            for ch, child in self.children[node].items():
                more = e + (ch != letter)
                if more <= self.edits_below[child] and more < out.get(child, 9) and (ch or ch == letter):
                    out[child] = more
            if letter and e < self.edits_below[node] and e + 1 < out.get(node, 9):
                out[node] = e + 1
        self.step[s, c] = t = self.state(self.closed(out))
        return t

    def scan(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, entry, edits, weight) of the words that hit an entry; of several the best one."""
        if len(self.sets) > STATES_KEPT:
            self.forget()
        classes = self.class_of[words.read]
        at, end = words.start.copy(), words.end
        live, state = np.arange(len(at)), np.ones(len(at), np.int32)
        hit, edits, value = np.full(len(at), -1, np.int32), np.zeros(len(at), np.int32), np.full(len(at), -1.0)
        while len(live):
            c = classes[at]
            after = self.step[state, c]
            missing = np.flatnonzero(after < 0)
            if len(missing):
                pair = np.unique(state[missing].astype(np.int64) * len(self.alphabet) + c[missing])
                for p in pair.tolist():
                    self.move(p // len(self.alphabet), p % len(self.alphabet))
                after = self.step[state, c]
            better = np.flatnonzero((self.hit[after] >= 0) & (self.value[after] > value[live]))
            if len(better):
                who, s = live[better], after[better]
                hit[who], edits[who], value[who] = self.hit[s], self.edits[s], self.value[s]
            keep = np.flatnonzero((after != 0) & (at < end[live]))
            live, state, at = live[keep], after[keep], at[keep] + 1
        found = np.flatnonzero(hit >= 0)
        return found, hit[found], edits[found], value[found]


def in_quotation(words: Words, hits: np.ndarray) -> np.ndarray:
    """Whether an odd number of quotation marks stands before the word on its line, and one after."""
    at = words.start[hits]
    lines = np.flatnonzero(words.points == 10)
    marks = np.flatnonzero(np.isin(words.points, np.array([*map(ord, QUOTES)], np.uint32)))
    k = np.searchsorted(lines, at)
    before = np.searchsorted(marks, at) - np.searchsorted(marks, lines[k - 1])
    after = np.searchsorted(marks, lines[k]) - np.searchsorted(marks, at)
    return (before % 2 == 1) & (after > 0)


def sums_of(words: Words, automaton: LexiconAutomaton) -> np.ndarray:
    """A row for each text: weights of abuse, weights of quotation, number of words."""
    out = np.zeros((len(words.bounds) - 1, 3))
    out[:, 2] = np.bincount(words.text_of, minlength=len(out))
    found, _, _, value = automaton.scan(words)
    quoted = in_quotation(words, found)
    for i, w, q in zip(found.tolist(), value.tolist(), quoted.tolist(), strict=True):
        own = words.text_of[i]
        around = [(j - i, words.word(j)) for j in range(max(0, i - WINDOW), min(len(words.start), i + WINDOW + 1)) if j != i and words.text_of[j] == own]
        if q or any(-NEAR <= d < 0 and x in REPORTING for d, x in around):
            out[own, 1] += w
        else:
            out[own, 0] += w * (ADDRESSED if any(x in ADDRESS for _, x in around) else 1.0)
    return out


def inputs_of(sums: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(sums)), np.log1p(sums[:, 0]), np.log1p(sums[:, 1]), np.log1p(sums[:, 2]) / 5])


#: Where the logistic model's coefficients are drawn to: a bias for rare abuse, then abuse, quotation, length.
PRIOR = np.array([-3.0, 2.0, 0.6, 0.0])


def fit_logistic(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Newton's steps towards the least penalised loss; the penalty draws to PRIOR, the bias only a little."""
    w, pull = PRIOR.copy(), np.array([0.01, strength, strength, strength])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * (w - PRIOR))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


class ToxicityModel:
    def __init__(self, entries: list[tuple[str, float, float]], coefficients: np.ndarray | None):
        self.automaton = LexiconAutomaton(entries)
        self.coefficients = coefficients

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.coefficients is None:
            return np.zeros(len(texts))
        return np.round(1 / (1 + np.exp(-np.clip(inputs_of(sums_of(Words(texts), self.automaton)) @ self.coefficients, -30, 30))), 6)


def sample_of(docs: DataFrame, labels: DataFrame, work: Workspace, sample_rows: int) -> DataFrame:
    """text, toxic, key, half of labelled rows that are not held out; one row a key."""
    rows = labels.filter(F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", (F.col("toxic") != 0).cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h"))
    picked = None
    for label in (0, 1):
        some = rows.filter(F.col("toxic") == label).orderBy("h", "doc_id").limit(sample_rows)
        picked = some if picked is None else picked.union(some)
    # Broadcast: at most two times sample_rows rows, by the limits.
    picked = work.write(picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "picked")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")

    def keyed(batches):
        for b in by_bytes(batches, "text"):
            keys = []
            for t in b.column("text").to_pylist():
                w = t.lower().split()
                grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
                keys.append(int(pd.util.hash_array(np.array(grams, object), categorize=False).min() >> np.uint64(1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], [*b.schema.names, "key"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    one = texts.mapInArrow(lean(keyed), f"{fields}, key long").groupBy("key").agg(F.min(F.struct("doc_id", "text", "toxic")).alias("s"))
    return work.write(one.select("key", (F.col("key") % 2).cast("int").alias("half"), "s.text", "s.toxic"), "sample")


def beginning_counts(sample: DataFrame) -> DataFrame:
    """term and, for each (half, label), its different words (n) and texts (d); the empty term has the totals."""
    names = [f"{c}{half}{label}" for c in "nd" for half in (0, 1) for label in (0, 1)]

    def run(batches):
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(8, np.int64))

        def out():
            yield pa.RecordBatch.from_arrays([pa.array([*counts]), *(pa.array(np.array([v[k] for v in counts.values()])) for k in range(8))], ["term", *names])
            counts.clear()

        for b in by_bytes(batches, "text"):
            for found, half, label in zip(Words(b.column("text").to_pylist()).distinct(), b.column("half").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                own = Counter(w[:k] for w in found for k in range(SHORTEST + 1, min(LONGEST, len(w)) + 1))
                own.update(w + END for w in found if len(w) == SHORTEST)
                own[""] = len(found)
                for term, n in own.items():
                    row = counts[term]
                    row[2 * half + label] += n
                    row[4 + 2 * half + label] += 1
            if len(counts) > 200_000:
                yield from out()
        if counts:
            yield from out()

    spec = "term string, " + ", ".join(f"{n} long" for n in names)
    return sample.select("text", "half", "toxic").mapInArrow(lean(run), spec).groupBy("term").agg(*[F.sum(n).alias(n) for n in names])


def likelihood_ratio(t, c, all_t, all_c):
    """Dunning's G2 of t and c uses of all_t and all_c words, for beginnings that toxic texts use more often."""
    rate = (t + c) / (all_t + all_c)
    part = lambda k, n: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(n * rate, 1e-9)), 0.0)
    return np.where(t * all_c > c * all_t, 2 * (part(t, all_t) + part(c, all_c)), 0.0)


def lexicon(rows: pd.DataFrame, halves: tuple[int, ...]) -> list[tuple[str, float]]:
    """(letters, weight) learned from the given halves of the sample; rows as of beginning_counts()."""
    t, c, d = (sum(rows[f"{k}{h}{label}"].to_numpy(float) for h in halves) for k, label in (("n", 1), ("n", 0), ("d", 1)))
    total = (rows["term"] == "").to_numpy()
    all_t, all_c = t[total].sum(), c[total].sum()
    if not all_t or not all_c:
        return []
    ratio = likelihood_ratio(t, c, all_t, all_c)
    weight = np.clip(np.log((t + 0.5) / all_t) - np.log((c + 0.5) / all_c), 0, 6)
    least = LEAST_RATIO * (1 if len(halves) == 2 else 0.7)
    good = ~total & (ratio >= least) & (d >= (LEAST_TEXTS if len(halves) == 2 else 2)) & (weight >= 0.7)
    terms = rows["term"].to_numpy()
    order = sorted(np.flatnonzero(good).tolist(), key=lambda i: (-ratio[i], -len(terms[i]), terms[i]))
    taken, beginnings = {}, set()
    for i in order:
        own = [terms[i][:k] for k in range(1, len(terms[i]) + 1)]
        if terms[i] not in beginnings and not any(x in taken for x in own):
            taken[terms[i]] = float(weight[i])
            beginnings.update(own)
        if len(taken) == ENTRIES:
            break
    return [*taken.items()]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from the text and toxic label of rows that are not held out."""
    work = Workspace(docs.sparkSession, "toxicity")
    sample = sample_of(docs, labels, work, sample_rows)
    counts = work.write(beginning_counts(sample), "beginnings")
    toxic, clean = F.col("n01") + F.col("n11"), F.col("n00") + F.col("n10")
    total = counts.filter("term = ''").toPandas()
    all_t, all_c = (float(total[[f"n0{k}", f"n1{k}"]].to_numpy(float).sum()) for k in (1, 0))
    if not all_t or not all_c:
        return ToxicityModel([], None)
    # The most telling by a bound of the ratio: uses in toxic texts times the logarithm of their excess.
    excess = F.log((toxic + 0.5) / all_t) - F.log((clean + 0.5) / all_c)
    telling = counts.filter((F.col("term") != "") & (F.col("d01") + F.col("d11") >= 2) & (excess > 0.5)).orderBy((toxic * excess).desc(), "term").limit(CANDIDATES)
    rows = pd.concat([total, telling.toPandas()])
    whole, first, second = (lexicon(rows, h) for h in ((0, 1), (0,), (1,)))
    weights = edited_weights(sample, sorted({x for lex in (whole, first, second) for x, _ in lex}), all_t, all_c)
    with_edits = lambda lex: [(x, w, min(weights.get(x, 0.0), 0.8 * w)) for x, w in lex]
    sums = held_sums(sample, [LexiconAutomaton(with_edits(second)), LexiconAutomaton(with_edits(first))]).toPandas().sort_values(["key"])
    coefficients = fit_logistic(inputs_of(sums[["abuse", "quotation", "words"]].to_numpy(float)), sums["toxic"].to_numpy(float))
    return ToxicityModel(with_edits(whole), coefficients)


def edited_weights(sample: DataFrame, letters: list[str], all_t: float, all_c: float) -> dict[str, float]:
    """Weight of an entry's misspellings: those met in the sample, or the labels' odds if none was."""
    shared = sample.sparkSession.sparkContext.broadcast(LexiconAutomaton([(x, 1.0, 0.5) for x in letters]))

    def run(batches):
        for b in by_bytes(batches, "text"):
            words = Words(b.column("text").to_pylist())
            found, entry, edits, _ = shared.value.scan(words)
            label = b.column("toxic").to_numpy(zero_copy_only=False)[words.text_of[found]]
            for k in (0, 1):
                term, n = np.unique(entry[(edits > 0) & (label == k)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), pa.array(n.astype(np.int64) * (k == 1)), pa.array(n.astype(np.int64) * (k == 0))], ["entry", "t", "c"])

    hits = sample.select("text", "toxic").mapInArrow(lean(run), "entry long, t long, c long").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()
    met = {r["entry"]: (r["t"], r["c"]) for r in hits}
    out = {}
    for k, x in enumerate(letters):
        t, c = met.get(k, (0, 0))
        out[x] = max(0.0, math.log((t + 0.25) / all_t) - math.log((c + 0.25) / all_c))
    return out


def held_sums(sample: DataFrame, automata: list[LexiconAutomaton]) -> DataFrame:
    """key, toxic and the sums of each sample row by the automaton of its half."""
    shared = sample.sparkSession.sparkContext.broadcast(automata)

    def run(batches):
        for b in by_bytes(batches, "text"):
            half = b.column("half").to_numpy(zero_copy_only=False)
            for h, automaton in enumerate(shared.value):
                own = b.filter(pa.array(half == h))
                if own.num_rows:
                    sums = sums_of(Words(own.column("text").to_pylist()), automaton)
                    yield pa.RecordBatch.from_arrays([own.column("key"), own.column("toxic"), *(pa.array(np.ascontiguousarray(s)) for s in sums.T)], ["key", "toxic", "abuse", "quotation", "words"])

    return sample.select("text", "half", "toxic", "key").mapInArrow(lean(run), "key long, toxic int, abuse double, quotation double, words double")


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of docs with score and predicted (1 from the threshold on); only text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [free_name(docs.columns, "score"), free_name(docs.columns, "predicted")]

    def run(batches):
        for b in by_bytes(batches, "text", 1 << 20):
            s = shared.value.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean(run), f"{fields}, {added[0]} double, {added[1]} int")
