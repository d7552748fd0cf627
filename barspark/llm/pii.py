"""Personal data: regular expressions propose spans, validators confirm them, nearby words adjust the score.

Four kinds have a fixed base rule (email, ip, card, phone): leftmost matches that don't overlap within their kind, kept if the
validator agrees, never retried. Beyond these the finder proposes IBANs (mod 97), cards and phones inside longer runs of
digits, national phone numbers and identity numbers. Those need a score of ``ACCEPT``: what the validator is worth plus or minus what
the words around them say. A base span stays whatever its score, and an added one never overlaps a base span.

All expressions run in time linear in the text: runs are taken possessively, and an address is grown from its @ sign.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa

from pyspark.sql import DataFrame

from barspark.llm.common import pick, text_slices

KINDS = ("email", "ip", "card", "phone", "iban", "id")
ACCEPT, CONTEXT = 0.5, 40  # least score of an added span; code points looked at on either side

# ---- fixed values: words that speak for a kind, words that speak against any, lengths of IBANs by country
WORDS_FOR = {
    "email": "email mail e-mail contact correo courriel kontakt",
    "ip": "ip address host server client addr gateway dns direccion adresse",
    "card": "card credit debit visa mastercard amex payment pan tarjeta carte karte kreditkarte",
    "phone": "phone tel telephone call mobile cell fax contact telefono teléfono téléphone telefon handy móvil",
    "iban": "iban account bank transfer cuenta compte konto",
    "id": "ssn social security identity tax passport id national",
}
WORDS_AGAINST = "version release build isbn issn order invoice tracking serial sku part commit revision test example"
IBAN_LENGTHS = dict(zip(
    "AD AE AT BA BE BG CH CY CZ DE DK EE ES FI FR GB GI GR HR HU IE IL IS IT LI LT LU LV MC MD ME MK MT NL NO PL PT QA RO RS SA SE SI SK SM TN TR UA".split(),
    (24, 23, 20, 20, 16, 22, 21, 28, 24, 22, 18, 20, 24, 18, 27, 22, 23, 27, 21, 28, 22, 23, 26, 27, 21, 20, 20, 21, 27, 24, 22, 19, 31, 18, 15, 28, 25, 29, 24, 22, 24, 24, 19, 24, 27, 24, 26, 29)))
# ---- end of fixed values

_FOR = {k: frozenset(v.split()) for k, v in WORDS_FOR.items()}
_AGAINST = frozenset(WORDS_AGAINST.split())
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGIT_RUN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_DIGITS = re.compile("[0-9]+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,40}")
_STRICT_PLUS = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


class Span(NamedTuple):
    kind: str
    start: int  # code points
    end: int  # exclusive
    score: float
    base: bool


# ---------------------------------------------------------------- validators


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, nine taken off above nine; the sum ends in 0."""
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The first four characters moved to the end, letters as 10 to 35: the number leaves 1 when divided by 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def _small(part: str) -> bool:
    """A number of at most 255, however many zeros lead it."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


# ---------------------------------------------------------------- proposals


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGIT_RUN.finditer(text):
        if 16 <= m.end() - m.start() <= 37:  # 19 digits and a separator between any two
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        m = _PLUS.match(text, at)
        if m and 8 <= len(_digits(m.group())) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


BASE = {"email": emails, "ip": addresses, "card": cards, "phone": phones}
_WORTH = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7}


def _added(text: str) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, worth before context) of what the base rules don't cover."""
    for m in _IBAN.finditer(text):
        raw = m.group()
        size, seen = IBAN_LENGTHS.get(raw[:2], 0), 0
        for i, c in enumerate(raw):
            seen += c != " "
            if seen == size:
                after = text[m.start() + i + 1:m.start() + i + 2]
                if mod97(raw[:i + 1].replace(" ", "")) and not ("0" <= after <= "9" or "A" <= after <= "Z"):
                    yield "iban", m.start(), m.start() + i + 1, 0.9
                break
    for m in _DIGIT_RUN.finditer(text):  # 13 to 19 digits between separators, at the front of what is left of the run
        if m.end() - m.start() < 13:
            continue
        groups = [g.span() for g in _DIGITS.finditer(text, *m.span())]
        i = 0
        while i < len(groups):
            digits, hit = "", 0
            for j in range(i, min(len(groups), i + 19)):
                digits += text[groups[j][0]:min(groups[j][1], groups[j][0] + 20)]
                if len(digits) > 19:
                    break
                if len(digits) >= 13 and digits[0] in "3456" and luhn(digits):
                    hit = j + 1
            if hit:
                yield "card", groups[i][0], groups[hit - 1][1], 0.4
            i = hit or i + 1
    if "+" in text:
        for m in _STRICT_PLUS.finditer(text):
            yield "phone", m.start(), m.end(), 0.6
    for m in _NATIONAL.finditer(text):
        yield "phone", m.start(), m.end(), 0.3
    for m in _ID.finditer(text):
        if m.group()[:3] not in ("000", "666") and m.group()[0] != "9" and m.group()[4:6] != "00" and m.group()[7:] != "0000":
            yield "id", m.start(), m.end(), 0.3


def context(text: str, kind: str, start: int, end: int) -> float:
    """0.3 for a word of the kind within ``CONTEXT`` code points, -0.3 for a word that speaks against personal data."""
    near = _WORD.findall(text[max(0, start - CONTEXT):start].lower()) + _WORD.findall(text[end:end + CONTEXT].lower())
    return 0.3 * (not _FOR[kind].isdisjoint(near)) - 0.3 * (not _AGAINST.isdisjoint(near))


def find(text: str) -> list[Span]:
    """All spans of a text, ordered by kind as in ``KINDS``, then by start."""
    out, taken = [], []
    for kind, propose in BASE.items():
        for start, end in propose(text):
            out.append(Span(kind, start, end, min(1.0, _WORTH[kind] + context(text, kind, start, end)), True))
            taken.append((start, end))
    free = _Free(taken)
    for kind, start, end, worth in _added(text):
        if free.overlaps(start, end):
            continue
        score = min(1.0, worth + context(text, kind, start, end))
        if score >= ACCEPT:
            out.append(Span(kind, start, end, score, False))
            free.add(start, end)
    return sorted(out, key=lambda s: (KINDS.index(s.kind), s.start))


class _Free:
    """Whether a range overlaps the disjoint-enough ranges taken so far, by cells of 64 code points."""

    def __init__(self, ranges: list[tuple[int, int]]) -> None:
        self.cells: dict[int, list[tuple[int, int]]] = {}
        for r in ranges:
            self.add(*r)

    def add(self, start: int, end: int) -> None:
        for c in range(start >> 6, (end - 1 >> 6) + 1):
            self.cells.setdefault(c, []).append((start, end))

    def overlaps(self, start: int, end: int) -> bool:
        return any(a < end and start < b for c in range(start >> 6, (end - 1 >> 6) + 1) for a, b in self.cells.get(c, ()))


# ---------------------------------------------------------------- tables


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): one row per input row, spans an array of (kind, start, end, score, base) in code points.

    Null and empty texts have no spans; null and repeated ids keep their rows; other columns take no part. An empty table gives
    no rows. One task holds 8 MB of texts, or one longer text, at a time.
    """
    x = pick(docs, doc_id=doc_id, text=text)
    kind = x.schema["doc_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[s._asdict() for s in find(t)] for t in texts], spans)], ["doc_id", "spans"])

    return x.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind string, start bigint, end bigint, score double, base boolean>>")
