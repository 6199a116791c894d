"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Account numbers of a country outside the registry end at the longest end that passes the
check, and need a word near them that speaks for one.

Cases: a null or empty text has no spans. Repeated rows are each answered. Texts are
read whole, in one pass per kind whose time grows with the length. Only ``doc_id``
and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import map_rows, ship

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS

# fixed values: national lengths of account numbers, as in the IBAN registry
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27,
    "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
IBAN_LEAST = 15

# words that speak for a kind when they stand near a proposal
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "insurance"),
}
# score of a proposal that passed its check, before the context is read
START = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
START_UNKNOWN_COUNTRY = 0.3  # an account number whose length no list tells
CONTEXT_GAIN = 0.3
CONTEXT_REACH = 60
THRESHOLD = 0.5

_LOCAL = re.compile("[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of an account number: its rearranged digits leave 1 modulo 97."""
    rest = 0
    for c in account[4:] + account[:4]:
        n = int(c, 36)
        rest = (rest * (100 if n > 9 else 10) + n) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)  # a local part never holds the sign itself
        at = text.find("@", at + 1 if not found else done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    # a dotted chain is cut into fours from its left end, as leftmost matches would
    for chain in _DOTTED.finditer(text):
        parts = chain[0].split(".")
        if len(parts) < 4:
            continue
        at = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        # words in capitals may follow; the national length says where it ends, or
        # without one the longest end that passes
        length = IBAN_LENGTHS.get(m[0][:2])
        plain, ends = "", []
        for i, c in enumerate(m[0], 1):
            plain += c.strip()
            whole = i == len(m[0]) or m[0][i] == " "
            if c != " " and (len(plain) == length if length else whole and len(plain) >= IBAN_LEAST):
                ends.append((plain, m.start() + i))
        for plain, end in reversed(ends):
            if mod97(plain):
                yield m.start(), end
                break


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_REACH) : start] + " " + text[end : end + CONTEXT_REACH]
    known = CONTEXT[kind]
    hit = any(w in known for w in _WORD.findall(near.lower()))
    unknown = kind == "iban" and text[start : start + 2] not in IBAN_LENGTHS
    return min(1.0, (START_UNKNOWN_COUNTRY if unknown else START[kind]) + CONTEXT_GAIN * hit)


def find(text: str) -> list[Span]:
    """All spans by kind, then start. Base kinds stay whatever their score; added
    kinds need ``THRESHOLD``."""
    spans: list[Span] = []
    digits = _DIGIT.search(text) is not None
    proposals = [("email", _emails)] if "@" in text else []
    if digits:
        proposals += [("ip", _ips), ("card", _cards), ("phone", _phones), ("iban", _ibans), ("ssn", _ssns)]
    for kind, propose in proposals:
        for start, end in propose(text):
            score = _score(kind, text, start, end)
            if kind in BASE_KINDS or score >= THRESHOLD:
                spans.append(Span(kind, start, end, score))
    return spans


def mask(text: str, spans: Iterable[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def personal_spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``spans`` and the ``masked`` text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [find(t) for t in texts]
            yield {
                "doc_id": b.column(0),
                "spans": [[s.__dict__ for s in f] for f in found],
                "masked": [mask(t, f) for t, f in zip(texts, found)],
            }

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id bigint, spans {SPANS}, masked string")


def span_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""

    def label(keep) -> F.Column:
        return F.array_join(
            F.transform(keep, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    spans = personal_spans(docs).drop("masked")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(label(base), 256).alias("base_sha256"),
        label(F.col("spans")).alias("spans"),
    )


def masked_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced; rows and columns as they came, a null text
    stays null."""
    ship(docs.sparkSession)
    kept = [f.name for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = [None if t is None else mask(t, find(t)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    out = docs.select(*kept).mapInArrow(run, docs.schema)
    if "n_chars" in kept:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), length).otherwise(F.col("n_chars")))
    return out.select(*kept)
