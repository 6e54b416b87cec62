"""Personal data in texts.

Regular expressions propose spans, checksums confirm them, words nearby raise their scores. Kinds of the base list (email,
ip, card, phone) are reported whenever their own test passes. Further kinds need a score: IBANs have their country's length and
pass mod 97, US social security numbers need a word that says so nearby, secrets need their name and mixed characters.

Positions are code points, ends exclusive. Null text: empty. Every expression runs in time linear in the text: none can start
again inside a run that it has failed on. A text of any length is searched whole. Repeated rows: each is searched. Ties: spans that
start together come in the order of KINDS. An empty table gives no rows. Other columns stay as they are, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.llm import tokens

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
THRESHOLD = 0.6
NEAR = 48  # code points before a span, and half of that after it, in which words count
#: Words that make a kind more likely when they stand nearby, in lower case.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "tarjeta", "carte", "karte", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "whatsapp", "telefon", "teléfono"),
    "iban": ("iban", "bank", "account", "transfer", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "secret": ("secret", "private", "credential"),
}
#: Scores before any word nearby.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.85, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.8}
BONUS = 0.25

_domain = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_LENGTHS = """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27
GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19
MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24
TR26 UA29 VA22 VG24 XK20 YE30"""
#: Characters of an IBAN by country; others have 15 to 34.
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in _LENGTHS.split()}
_ssn = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_secret = re.compile(r"(?<![A-Za-z0-9_])(?:token|api_?key|secret|password|passwd)\s{0,3}[=:]\s{0,3}[\"']([A-Za-z0-9+/_=-]{16,128})[\"']", re.I)
_words = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_digits = re.compile(r"[^0-9]+")
_local_chars = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


class Span(NamedTuple):
    start: int
    order: int  # of its kind, as listed
    end: int
    score: float

    @property
    def kind(self) -> str:
        return KINDS[self.order]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """A proposal may run on into what follows: it is cut where its country's length ends, or for other countries at the last
    token's end that passes mod 97. Where none does, the search goes on behind its first four characters."""
    at = 0
    while m := _iban.search(text, at):
        start, taken, found = m.start(), "", 0
        for i in range(start, m.end()):
            if text[i] == " ":
                continue
            taken += text[i]
            following = text[i + 1 : i + 2]
            if len(taken) == IBAN_LENGTHS.get(taken[:2], max(len(taken), 15)) and not (following.isascii() and following.isalnum()) and mod_97(taken):
                found = i + 1
        if found:
            yield start, found
        at = found or start + 4


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _domain.finditer(text):
        at = start = m.start()
        while start > done and text[start - 1] in _local_chars:
            start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, order of the kind, end) of the base kinds."""
    if "@" in text:
        yield from ((a, 0, b) for a, b in emails(text))
    for m in _ip.finditer(text):
        if all(map(octet, m[0].split("."))):
            yield m.start(), 1, m.end()
    for m in _card.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(digits := _digits.sub("", m[0])) <= 19 and luhn(digits):
            yield m.start(), 2, m.end()
    if "+" in text:
        for m in _phone.finditer(text):
            if 9 <= len(_digits.sub("", m[0])) <= 15:
                yield m.start(), 3, m.end()


def more_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """The same for the other kinds, before their scores are known."""
    yield from ((a, 4, b) for a, b in ibans(text))
    if "-" in text:
        for m in _ssn.finditer(text):
            if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
                yield m.start(), 5, m.end()
    if "=" in text or ":" in text:
        for m in _secret.finditer(text):
            if any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]):
                yield m.start(1), 6, m.end(1)


def scored(text: str, start: int, order: int, end: int) -> Span:
    kind = KINDS[order]
    near = {w.lower() for w in _words.findall(text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR // 2])}
    bonus = BONUS if near.intersection(CONTEXT[kind]) else 0.0
    return Span(start, order, end, min(1.0, PRIOR[kind] + bonus))


def find(text: str) -> list[Span]:
    """All spans of a text by start, then kind as listed."""
    spans = [scored(text, *s) for s in base_spans(text)]
    spans += [s for s in (scored(text, *x) for x in more_spans(text)) if s.score >= THRESHOLD]
    return sorted(spans)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in angle brackets."""
    parts, done = [], 0
    for s in spans:
        if s.start >= done:
            parts += [text[done : s.start], f"<{s.kind.upper()}>"]
        done = max(done, s.end)
    return "".join([*parts, text[done:]]) if parts else text


REPORT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"


def detect(docs: DataFrame) -> DataFrame:
    """A row per document: counts of the base kinds, a digest of the base spans, all spans and their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    spans = find(text or "")
                    base = [s for s in spans if s.order < len(BASE)]
                    counts = [sum(s.order == k for s in base) for k in range(len(BASE))]
                    rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), [s.score for s in spans]))
                columns = list(zip(*rows)) if rows else [[]] * 7
                kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, REPORT)


def redact(docs: DataFrame) -> DataFrame:
    """documents with the spans of every text masked; other columns, and null texts, stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in tokens.slices(batch, "text"):
                made = pa.array([t if t is None else masked(t, find(t)) for t in part.column("text").to_pylist()], batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(part.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
