"""Personal data: patterns propose, checksums confirm, context words adjust.

Each kind has a pattern that proposes spans and a validator that confirms them: digit counts
and ranges, Luhn for card numbers, mod-97 for bank account numbers. A proposal has a base
score; words near it that name its kind raise the score, words that speak against it lower
it, and a span is reported from MIN_SCORE up. The base kinds (email, ip, card, phone) are
reported at any score once validated; iban, ssn and local phone numbers are added by score.

Texts are read one by one in Arrow batches and nothing is shuffled. Offsets count code points.
Time is linear in a text's length, for runs of digits, letters or @ of any length too: patterns that
would try every start of a failing run are matched by run instead.

Defined cases: null or empty text has no spans; a text of any length is searched whole; rows
that repeat are reported each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, by_bytes, lean

MIN_SCORE = 0.6
CONTEXT_CHARS = 48
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
BASE = KINDS[:4]
START_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "local_phone": 0.4}
FOR = {
    "email": ("email", "mail", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
AGAINST = ("version", "isbn", "order", "invoice", "serial", "sample")
_CONTEXT_WORDS = sorted({*AGAINST, *(w for words in FOR.values() for w in words)})

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ADDRESS = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_IP_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_IP_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL = re.compile(r"(?<![0-9+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    code = iban.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str):
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, leftmost, each character looked at a bounded number of times.

    What stands before an @ is a whole run of address characters, so one @ has one possible start.
    """
    before, end, at = 0, 0, text.find("@")
    while at >= 0:
        head = text[max(before, end) : at]
        start = at - len(head) + len(head.rstrip(_ADDRESS))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        before = at + 1
        at = text.find("@", max(before, end))


def _ips(text: str):
    """Matches of `[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`, leftmost: each four numbers of a chain joined by single dots."""
    for chain in _IP_CHAIN.finditer(text):
        parts = [m.span() for m in _IP_PART.finditer(text, *chain.span())]
        for i in range(0, len(parts) - 3, 4):
            yield parts[i][0], parts[i + 3][1]


def _ip_ok(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))


def _card_ok(found: str) -> bool:
    digits = _NOT_DIGIT.sub("", found)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(found: str) -> bool:
    return 10 <= len(_NOT_DIGIT.sub("", found)) <= 15


def _ssn_ok(found: str) -> bool:
    return found[:3] not in ("000", "666") and found[0] != "9" and found[4:6] != "00" and found[7:] != "0000"


def proposals(text: str):
    """(kind, start, end) of confirmed proposals: per kind leftmost, not overlapping, no retries."""
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e
    for s, e in _ips(text) if "." in text else ():
        if _ip_ok(text[s:e]):
            yield "ip", s, e
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and _card_ok(m[0]):
            yield "card", *m.span()
    for m in _PHONE.finditer(text) if "+" in text else ():
        if _phone_ok(m[0]):
            yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        found = m[0]
        while not mod97(found) and " " in found:  # capitals that follow an account number are cut off again
            found = found.rpartition(" ")[0]
        if mod97(found):
            yield "iban", m.start(), m.start() + len(found)
    for m in _SSN.finditer(text) if "-" in text else ():
        if _ssn_ok(m[0]):
            yield "ssn", *m.span()
    for m in _LOCAL.finditer(text):
        yield "local_phone", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = {*re.findall(r"\w+", (text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower())}
    value = START_SCORE[kind] + 0.3 * (not near.isdisjoint(FOR[kind])) - 0.3 * (not near.isdisjoint(AGAINST))
    return round(min(1.0, max(0.0, value)), 2)


def _word_starts(text: str) -> list[int] | None:
    """Where context words begin in a text, inside other words too; None if lower case moves its characters."""
    low = text.lower()
    if len(low) != len(text):
        return None
    out = []
    for word in _CONTEXT_WORDS:
        at = low.find(word)
        while at >= 0:
            out.append(at)
            at = low.find(word, at + 1)
    return sorted(out)


def _any_from(starts: list[int], begin: int, end: int) -> bool:
    i = bisect_left(starts, begin)
    return i < len(starts) and starts[i] < end


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """Spans of one text by start, then kind: (kind, start, end, score)."""
    text = text or ""
    found = list(proposals(text))
    taken = sorted((s, e) for k, s, e in found if k in BASE)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    named = _word_starts(text) if len(found) * 2 * CONTEXT_CHARS > len(text) else None  # spans so dense that their contexts overlap
    out = []
    for kind, s, e in found:
        plain = named is not None and not _any_from(named, s - CONTEXT_CHARS, s) and not _any_from(named, e, e + CONTEXT_CHARS)
        value = START_SCORE[kind] if plain else score(text, kind, s, e)
        if kind not in BASE:
            if value < MIN_SCORE:
                continue
            before = bisect_left(starts, e)  # base spans that start before this one's end
            if before and reach[before - 1] > s:
                continue
        out.append((kind, s, e, value))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, found): found is an array of (kind, start, end, score)."""
    bound_batches(docs.sparkSession)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def scan(batches):
        for b in by_bytes(batches, "text"):
            rows = [
                [{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in find_spans(t)] for t in b.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(item))], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lean(scan), "doc_id long, found array<struct<kind:string,start:long,end:long,score:double>>"
    )


def span_digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans merge under the first kind."""
    if text is None:
        return None
    out, at = [], 0
    for kind, s, e, _ in find_spans(text):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join(out) + text[at:]
