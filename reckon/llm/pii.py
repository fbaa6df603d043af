"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts scores.

Kinds of the base set: email, ip (parts up to 255), card (12 to 19 digits that pass Luhn) and phone
(9 to 15 digits), each found leftmost and without overlap within its kind; a proposal that fails
its test is dropped without a retry inside it. Added by the method: iban (mod-97 of the account
number, country's length) and ssn (proposed by shape, taken only if context words near it raise its
score to the threshold). Every span has a score: a base by kind, raised by a word of its kind's
context within CONTEXT characters before or after it, lowered by a word that speaks against it.
Spans of the base set stay whatever their score.

Defined cases: a null text counts as empty and has no spans; offsets are code points, ends
exclusive; repeated rows each give a row; other columns are not looked at. Every pattern takes time
in proportion to the text, whatever runs of digits or letters it has.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
CONTEXT = 48
THRESHOLD = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits starts; possessive runs don't change what matches.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Lengths of account numbers by country, as published in the IBAN registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28,
    "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}

_BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
_FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|client)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|debit|payment)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security|tax id|national id)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:version|release|part|serial|isbn|example|sample|test)\b", re.I)


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    """Each match has one @ after its local part, so each @ gives at most one match: from the start
    of the run of local characters before it, or from the end of the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        else:
            done = at + 1
        at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, z) for a, z in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    score = _BASE_SCORE[kind] + 0.3 * bool(_FOR[kind].search(near)) - 0.3 * bool(_AGAINST.search(near))
    return round(min(1.0, max(0.0, score)), 3)


def find(text: str | None) -> list[Span]:
    """All spans, by start and then kind."""
    if not text:
        return []
    found = base_spans(text)
    for m in _IBAN.finditer(text):
        account = m.group().replace(" ", "")
        while account and len(account) > IBAN_LENGTHS.get(account[:2], 0) > 0 and " " in m.group():
            account = account[: IBAN_LENGTHS[account[:2]]]  # blanks also join the words that follow
        if len(account) == IBAN_LENGTHS.get(account[:2]) and mod97(account):
            end, left = m.start(), len(account)
            while left:
                left -= text[end] != " "
                end += 1
            if end == len(text) or not text[end].isalnum():
                found.append(("iban", m.start(), end))
    out = [Span(k, a, z, _score(text, k, a, z)) for k, a, z in found]
    for m in _SSN.finditer(text):
        if (score := _score(text, "ssn", m.start(), m.end())) >= THRESHOLD:
            out.append(Span("ssn", m.start(), m.end(), score))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def joined(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and found (array of kind, start, end, score) for each row of docs (doc_id, text)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [[s._asdict() for s in find(t)] for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "found": pa.array(found, kind)})

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, found array<struct<kind:string,start:long,end:long,score:double>>")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and scores of each row of docs."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n: dict[str, list[int]] = {k: [] for k in KINDS[:4]}
        sha, spans, scores = [], [], []
        for t in b.column("text").to_pylist():
            found = find(t)
            base = [s for s in found if s.kind in n]
            for k in n:
                n[k].append(sum(s.kind == k for s in base))
            sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(found))
            scores.append(",".join(f"{s.score:.3f}" for s in found))
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | {f"n_{k}": pa.array(v, pa.int64()) for k, v in n.items()} | {"base_sha256": sha, "spans": spans, "scores": scores})

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")


def mask_text(text: str | None) -> str | None:
    """text with every span (overlapping ones as one) replaced by its kind in brackets."""
    spans = find(text)
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k][:3]
        k += 1
        while k < len(spans) and spans[k].start < end:
            end = max(end, spans[k].end)
            k += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text, and n_chars (if there is such a column) counted
    anew for the texts that changed; all rows and columns stay."""
    names = docs.columns

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        old = b.column("text").to_pylist()
        new = [mask_text(t) for t in old]
        cols = {x: b.column(i) for i, x in enumerate(names)} | {"text": pa.array(new, pa.string())}
        if "n_chars" in cols:
            was = cols["n_chars"].to_pylist()
            cols["n_chars"] = pa.array([len(y) if x != y else w for x, y, w in zip(old, new, was)], cols["n_chars"].type)
        return pa.RecordBatch.from_pydict(cols)

    return map_arrow(docs, run, docs.schema)
