"""Personal data: regular expressions propose spans, checksums confirm them, nearby
context words adjust the score.

A proposal starts with the prior of its kind. A validator decides on some kinds (Luhn
for cards, mod-97 for bank account numbers); words within ``Rules.window`` characters
that speak for or against a kind raise or lower the score. Spans of the four base kinds
are always reported, with whatever score; spans of the added kinds need a score of at
least ``Rules.threshold`` and must not overlap a base span or each other.

Offsets are code points, the end exclusive. Scanning takes time in proportion to the
text: each pattern can only start where no earlier start could have matched.

Defined cases: a NULL or empty text has no spans; texts of any length are scanned whole; of
proposals of added kinds that overlap, the first by kind, then by start, is taken; a NULL id
stays NULL; repeated rows each give a row; an empty table gives none; other columns are
ignored (``spans``) or kept (``redacted``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm import frames

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "shortcard", "localphone")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


@dataclass(frozen=True)
class Rules:
    """Priors, the threshold of added kinds, and how far and how much context words count."""

    window: int = 40
    step: float = 0.3
    threshold: float = 0.6


PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "shortcard": 0.4, "localphone": 0.3}
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "shortcard": ("card", "amex", "visa", "credit", "debit", "payment"),
    "localphone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon"),
}
AGAINST = ("version", "isbn", "serial", "order", "invoice", "example", "section")

# How many characters a bank account number has in each country.
ACCOUNT_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24,
    "XK": 20,
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2} ?[A-Z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_DIGIT = re.compile(r"[0-9]")
_GROUP = re.compile(r"[0-9]+")
_CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_WORD = re.compile(r"[a-z-]+")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """The check of card numbers, over a string of digits."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of bank account numbers: letters as 10 to 35, the first four at the end."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str):
    """Leftmost non-overlapping addresses. A match starts where the run of local
    characters before its ``@`` starts, or where the match before it ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if domain and start < at:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", *span) for span in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(number := digits(m.group())) <= 19 and luhn(number):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    return found


def accounts(text: str):
    """Bank account numbers: as many letters and digits, with single spaces between, as the
    country's numbers have, confirmed by mod-97. Every place where one may start is tried, so
    what stands before or behind a number doesn't hide it."""
    done = 0
    for start in (m.start() for m in _ACCOUNT.finditer(text)):
        length = ACCOUNT_LENGTHS.get(text[start:start + 2])
        if length is None or start < done:
            continue
        at, found = start, []
        while len(found) < length and at < len(text):
            c = text[at]
            if c in _CAPITALS:
                found.append(c)
            elif c != " " or text[at - 1] == " ":
                break
            at += 1
        if len(found) == length and not (at < len(text) and text[at].isascii() and text[at].isalnum()) and mod97("".join(found)):
            yield start, at
            done = at


def short_cards(text: str):
    """Card numbers of 13 to 15 digits that pass Luhn: runs of whole groups of digits, the
    longest from each group on, without overlaps."""
    for run in _CARD.finditer(text):
        if run.end() - run.start() < 13:
            continue
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, run.start(), run.end())]
        i = 0
        while i < len(groups):
            total, ends = 0, []
            for j in range(i, len(groups)):
                total += groups[j][1] - groups[j][0]
                if total > 15:
                    break
                if total >= 13:
                    ends.append(j)
            last = next((j for j in reversed(ends) if luhn(digits(text[groups[i][0]:groups[j][1]]))), None)
            if last is None:
                i += 1
            else:
                yield groups[i][0], groups[last][1]
                i = last + 1


def added_spans(text: str) -> list[tuple[str, int, int]]:
    """Proposals of the other kinds, after their validators."""
    if not _DIGIT.search(text):
        return []
    return [*(("iban", *span) for span in accounts(text)), *(("shortcard", *span) for span in short_cards(text)),
            *(("localphone", *m.span()) for m in _LOCAL_PHONE.finditer(text))]


def score(text: str, kind: str, start: int, end: int, rules: Rules) -> float:
    """The prior, a step up for a context word of the kind, a step down for one against."""
    near = set(_WORD.findall((text[max(0, start - rules.window):start] + " " + text[end:end + rules.window]).lower()))
    value = PRIOR[kind] + rules.step * (not near.isdisjoint(CONTEXT[kind])) - rules.step * (not near.isdisjoint(AGAINST))
    return round(min(1.0, max(0.0, value)), 4)


def find(text: str | None, rules: Rules = Rules()) -> list[Span]:
    """All spans of a text, by kind as listed in ``KINDS``, then by start."""
    if not text:
        return []
    spans = [Span(*s, score(text, *s, rules)) for s in base_spans(text)]
    taken = [(s.start, s.end) for s in spans]
    for kind, start, end in added_spans(text):
        value = score(text, kind, start, end, rules)
        if value >= rules.threshold and all(end <= a or b <= start for a, b in taken):
            spans.append(Span(kind, start, end, value))
            taken.append((start, end))
    return spans


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def spans(docs: DataFrame, rules: Rules = Rules(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and the spans of every row."""

    def work():
        def step(ids, texts):
            return {key: ids, "spans": [[s._asdict() for s in find(t, rules)] for t in texts.to_pylist()]}
        return step

    kind = docs.schema[key].dataType.simpleString()
    return frames.per_document(docs, [key, text], f"{key} {kind}, spans {SPANS}", work)


def redact(text: str | None, found: list[Span]) -> str | None:
    """The text with each span replaced by its kind; overlapping spans become one."""
    if not found:
        return text
    out, done = [], 0
    for s in sorted(found, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done:s.start], f"<{s.kind.upper()}>"]
        done = max(done, s.end)
    return "".join(out) + text[done:]


def scrubbed(text: str | None, rules: Rules = Rules()) -> str | None:
    """The text without any span: what a replaced neighbour uncovers is replaced too."""
    while found := find(text, rules):
        text = redact(text, found)
    return text


def redacted(docs: DataFrame, rules: Rules = Rules(), text: str = "text", length: str = "n_chars") -> DataFrame:
    """All rows and columns, personal data in ``text`` replaced by placeholders; a column
    ``length``, if there, is set to the new number of characters of changed texts."""

    def run(incoming):
        for batch in incoming:
            texts = batch.column(text).to_pylist()
            new = [scrubbed(t, rules) for t in texts]
            at = batch.schema.get_field_index(text)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, type=batch.schema.field(at).type))
            if (at := batch.schema.get_field_index(length)) >= 0:
                lengths = [old if a == b else len(b) for a, b, old in zip(texts, new, batch.column(at).to_pylist())]
                field = batch.schema.field(at)
                batch = batch.set_column(at, field, pa.array(lengths).cast(field.type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of base spans, and the spans as text and checksum, from ``spans``."""
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(rows):
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(key, *[count(k) for k in BASE_KINDS],
                        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
