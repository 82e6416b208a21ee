"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, scheme marks, plus
signs and digits, and identifier cues. A deterministic local parser then expands each anchor to
its boundaries and validates it. No parser looks beyond the run of characters that its kind
allows, so the work is linear in the text.

Kinds: ``email``, ``ip`` (four numbers up to 255), ``card`` (12-19 digits, Luhn), ``phone``
(9-15 digits after a plus), which are the leftmost non-overlapping matches of fixed patterns, and
the anchors' own ``iban`` (after its cue, the longest run of whole words that mod-97 accepts), ``ssn``
(after its cue, which no letter precedes, and not within a longer number) and ``login`` (user:password
of a URL).

Defined results: a null or empty text has no spans; rows that repeat a doc_id, or have none, each have their own; a text of any
length is read whole, in time that grows with it; of spans that tie in their start the kinds' order decides; an empty
table gives an empty table; columns besides the id and the text are not read by ``find_pii``, and
kept, whatever their names, by ``mask_pii``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, read, steps, texts

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "login")
BASE = KINDS[:4]
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = "0123456789"
_ALNUM = _LOCAL - frozenset("._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIAL = re.compile(r"[ ().0-9-]*")
#: What may stand between a cue and what it announces.
_JOIN = r"[ \t\n:=#.]{0,4}"
_IBAN = re.compile(_JOIN + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)")
_SSN = re.compile(_JOIN + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_LOGIN = re.compile(r"([^\x00-\x20/@:?#]+:[^\x00-\x20/@?#]+)@[A-Za-z0-9-]")

_AUTOMATON = None


def automaton() -> ahocorasick.Automaton:
    """Anchors and the parser that each one calls; built once in a worker."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = ahocorasick.Automaton()
        for word, kind in [("@", "email"), ("+", "phone"), ("://", "login"), ("IBAN", "iban"), ("iban", "iban"), ("Iban", "iban"), ("SSN", "ssn"), ("ssn", "ssn"), *((d, "digit") for d in _DIGITS)]:
            _AUTOMATON.add_word(word, (kind, len(word)))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i & 1:
            n += n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _iban_ok(value: str) -> bool:
    flat = value.replace(" ", "")
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _iban_end(text: str, start: int, end: int) -> int:
    """End of the longest checked account number that starts at ``start`` and ends at a boundary up to ``end``, or 0."""
    for e in range(end, start + 14, -1):
        if text[e - 1] != " " and not (e < len(text) and text[e] in _ALNUM) and _iban_ok(text[start:e]):
            return e
    return 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, index into KINDS, end), sorted."""
    out: list[tuple[int, int, int]] = []
    email_end = number_end = grouped_end = dial_end = iban_end = 0
    for last, (kind, width) in automaton().iter(text):
        if kind == "digit":
            if last >= number_end:  # a chain of numbers joined by single dots, taken in fours
                number_end = (m := _NUMBERS.match(text, last)).end()
                parts, at = m[0].split("."), last
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    end = at + sum(map(len, four)) + 3
                    if all(map(_octet, four)):
                        out.append((at, 1, end))
                    at = end + 1
            if last >= grouped_end:  # a chain of digits with at most one space or hyphen between
                grouped_end = (m := _GROUPED.match(text, last)).end()
                if grouped_end - last >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                    out.append((last, 2, grouped_end))
        elif kind == "email":
            start, floor = last, email_end
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                out.append((start, 0, email_end))
        elif kind == "phone":
            if last >= dial_end and text[last + 1 : last + 2] in set(_DIGITS):
                run = _DIAL.match(text, last + 2)[0]
                body = run.rstrip(" ().-")
                if len(body) >= 2:
                    dial_end = last + 2 + len(body)
                    if 9 <= 1 + sum(c in _DIGITS for c in body) <= 15:
                        out.append((last, 3, dial_end))
        elif kind == "iban":
            if last - width >= iban_end - 1 and (m := _IBAN.match(text, last + 1)):
                if e := _iban_end(text, m.start(1), m.end()):
                    iban_end = e
                    out.append((m.start(1), 4, e))
        elif kind == "ssn":
            start = last - width + 1
            if not (start and text[start - 1].isalpha()) and (m := _SSN.match(text, last + 1)):
                out.append((m.start(1), 5, m.end()))
        elif m := _LOGIN.match(text, last + 1):
            out.append((m.start(1), 6, m.end(1)))
    out.sort()
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, found in steps(batches):
        rows = []
        for i, text in zip(ids, found, strict=True):
            spans = spans_of(text)
            base = [x for x in spans if x[1] < 4]
            n = [sum(x[1] == k for x in base) for k in range(4)]
            rows.append((i, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.string()] * 2, strict=True)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans and all spans (code points)."""
    return arrow(texts(docs, id_col, text_col), _digest, SCHEMA)


def masked(text: str) -> str:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first and longest names it."""
    out, at = [], 0
    spans = sorted(spans_of(text), key=lambda x: (x[0], -x[2]))
    i = 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join([*out, text[at:]]) if out else text


def _mask(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index(text_col)
        new = pa.array([None if x is None else masked(x) for x in b.column(at).to_pylist()], b.schema.field(at).type)
        yield b.set_column(at, b.schema.field(at), new)


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same columns and rows, personal data in ``text_col`` replaced; null stays null."""
    return arrow(docs, _mask, docs.schema, text_col=text_col)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data masked, n_chars follows the text."""
    out = mask_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
