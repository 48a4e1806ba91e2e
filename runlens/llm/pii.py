"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, a plus before a digit, digits with a dot or with at
most one blank or hyphen between them, URL schemes and identifier cues. A deterministic local parser expands each
anchor to its boundaries and validates what it found. Anchors come in ascending order and each kind skips those
inside what it has consumed, so a kind's spans are leftmost and do not overlap, and a candidate that fails its
validation is dropped with all it consumed.

Base kinds: email, ip, card, phone. Added by the method: ``url`` (a scheme with credentials or a personal page) and
``id`` (an identifier after a cue, such as a social security or passport number).

Cases: null and empty texts have no spans; rows that repeat a doc_id each get their row; an empty table gives no
rows; a null doc_id stays null; other columns are ignored, whatever their names. A text is scanned whole, in one
pass whose time is linear in it, however long its runs of digits, blanks or letters; memory is one Arrow batch and
its spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import in_batches
from .spans import Span, digest_batch, digest_schema

BASE = ["email", "ip", "card", "phone"]
ORDER = {k: i for i, k in enumerate([*BASE, "url", "id"])}

#: The schemes and cues that anchor the method's own kinds.
SCHEMES = ["http://", "https://", "ftp://", "ssh://", "mailto:", "tel:"]
CUES = ["ssn", "social security", "passport", "driver license", "national id", "tax id", "iban", "account number", "routing number", "date of birth"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = frozenset("0123456789.")
_CHAIN = frozenset("0123456789 -")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z]+:(?://)?[^\s<>\"']+")
_PERSONAL = re.compile(r"://[^/@\s:]+:[^/@\s]+@|/~[A-Za-z0-9_]+|/(?:users?|profile|people)/[A-Za-z0-9_.-]+|^(?:mailto|tel):", re.I)
_ID = re.compile(r"(?:\s*+(?:no\.?|number|#))?+\s*+[:=#]?+\s*+([A-Za-z0-9](?:[ /-]?[A-Za-z0-9]){4,33})(?![A-Za-z0-9])")
_automaton = None


def automaton():
    """The anchors with their kinds; built once a worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        digits = "0123456789"
        made.add_word("@", ("email", 1))
        for a in digits:
            made.add_word(f"+{a}", ("phone", 2))
            for b in digits:
                made.add_word(f"{a}.{b}", ("ip", 3))
                for gap in ("", " ", "-"):
                    made.add_word(f"{a}{gap}{b}", ("card", 2 + len(gap)))
        for word in SCHEMES:
            made.add_word(word, ("url", len(word)))
        for word in CUES:
            for form in {word, word.upper(), word.capitalize(), word.title()}:
                made.add_word(form, ("id", len(form)))
        made.make_automaton()
        _automaton = made
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _region(text: str, at: int, done: int, allowed: frozenset[str]) -> tuple[int, int]:
    """The maximal run of allowed characters around ``at``, not before ``done``."""
    a = b = at
    while a > done and text[a - 1] in allowed:
        a -= 1
    while b < len(text) and text[b] in allowed:
        b += 1
    return a, b


def octet(part: str) -> bool:
    """Whether digits, however many, are a number of at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def quads(run: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, parts) of the leftmost four dotted numbers each of a run of digits and dots, in time linear in it."""
    at, held = 0, []
    for part in [*run.split("."), ""]:
        if part:
            held.append((at, part))
        else:
            held = []
        at += len(part) + 1
        if len(held) == 4:
            yield held[0][0], at - 1, [p for _, p in held]
            held = []


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text, of every kind."""
    out: list[Span] = []
    if not text:
        return out
    done = dict.fromkeys(ORDER, 0)
    for last, (kind, width) in automaton().iter(text):
        at = last + 1 - width
        if at < done[kind]:
            continue
        if kind == "email":
            a = at
            while a > done[kind] and text[a - 1] in _LOCAL:
                a -= 1
            m = _DOMAIN.match(text, at + 1) if a < at else None
            if m:
                out.append((kind, a, m.end()))
                done[kind] = m.end()
        elif kind == "ip":
            a, b = _region(text, at, done[kind], _DOTTED)
            out += [(kind, a + i, a + j) for i, j, parts in quads(text[a:b]) if all(map(octet, parts))]
            done[kind] = b
        elif kind == "card":
            a, b = _region(text, at, done[kind], _CHAIN)
            for m in _CARD.finditer(text[a:b]):
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((kind, a + m.start(), a + m.end()))
            done[kind] = b
        elif kind == "phone":
            m = _PHONE.match(text, at)
            if m:
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((kind, at, m.end()))
                done[kind] = m.end()
        elif kind == "url":
            m = _URL.match(text, at)
            if m and _PERSONAL.search(m[0]):
                out.append((kind, at, m.end()))
            done[kind] = m.end() if m else last + 1
        elif not (at and text[at - 1].isalnum()):
            m = _ID.match(text, last + 1)
            if m and sum(c.isdigit() for c in m[1]) >= 4:
                out.append((kind, m.start(1), m.end(1)))
                done[kind] = m.end()
    return out


def _scan(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find_spans(t) for t in batch.column("text").to_pylist()]
        yield digest_batch(batch.column("doc_id"), found, BASE, ORDER)


def scan_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row of ``docs`` (doc_id, text)."""
    return in_batches(docs.select("doc_id", "text")).mapInArrow(_scan, digest_schema(BASE))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; other columns stay."""

    def clean(text: str | None) -> str | None:
        spans = sorted(find_spans(text), key=lambda s: (s[1], -s[2]))
        out, at = [], 0
        for kind, a, b in spans:
            if b > at:
                out += [text[at : max(a, at)], f"<{kind}>" if a >= at else ""]
                at = b
        return text if text is None else "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array(map(clean, batch.column(i).to_pylist()), batch.schema.field(i).type))

    return in_batches(docs).mapInArrow(run, docs.schema)
