"""License scans by ordered signature rules.

The rules are some 340 regular expressions written by hand (``license_rules``), in order of precedence. A keyword
prefilter decides which are tried: from each expression's parse tree the strings are derived of which every match has
one, and one Aho-Corasick pass finds which of them a text has. Prefilter and rules see the text with white space and
the comment marks of wrapped lines folded to one space. Detections are resolved by priority: the rule of the earlier section first, then the longer interval, then the
earlier place, then the earlier rule; a detection that lies within the interval of one accepted before it is suppressed.

Base labels come from fixed phrases whose words stand consecutively, found by word hashes and compared with the
words themselves; they are reported whatever the rules find. The score is 1 minus the product of (1 - weight) over distinct
labels, weights by section.

Cases: null and empty texts have no words, labels "" and score 0; rows that repeat a doc_id each get their row;
an empty table gives no rows; a null doc_id stays null; other columns are ignored, whatever their names.
Whole texts are scanned; memory is one chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .license_rules import SECTIONS
from .secrets import MOST_STRINGS, few_strings, parser
from .shared import in_batches
from .words import LOWER, Words, alnum_words, chunks, span_hashes

#: The base phrases (by their words) and labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
BASE_WEIGHT = 0.8


class Rule(NamedTuple):
    label: str
    needs: list[str]  # every match has one of these
    pattern: re.Pattern
    section: int
    place: int
    weight: float


def needs(pattern: str) -> list[str]:
    """Strings of which every match of ``pattern`` has one.

    Those of the stretch of the expression that matches one of few strings and whose shortest string is longest.
    """
    stretches, strings = [], {""}
    for node in parser.parse(pattern):
        more = few_strings(node)
        if more is not None and len(strings) * len(more) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in more}
        else:
            stretches.append(strings)
            strings = more or {""}
    best = max([*stretches, strings], key=lambda x: (min(map(len, x)), -len(x)))
    if min(map(len, best)) < 3:
        raise ValueError(f"no keyword is mandatory in {pattern}")
    return sorted(best)


def rules() -> list[Rule]:
    """All rules in the order they are tried."""
    out: list[Rule] = []
    for k, (weight, section) in enumerate(SECTIONS):
        for label, pattern in section:
            out.append(Rule(label, needs(pattern), re.compile(pattern), k, len(out), weight))
    return out


class Prefilter:
    """The keywords of all rules, and the rules that each lets be tried."""

    def __init__(self, found: list[Rule]):
        import ahocorasick

        self.by_word: dict[str, list[Rule]] = {}
        for rule in found:
            for word in rule.needs:
                self.by_word.setdefault(word, []).append(rule)
        self.keywords = ahocorasick.Automaton()
        for word in self.by_word:
            self.keywords.add_word(word, word)
        self.keywords.make_automaton()

    def tried(self, text: str) -> list[Rule]:
        """The rules that a folded text has a keyword of, each once."""
        return list({r.place: r for word in {w for _, w in self.keywords.iter(text)} for r in self.by_word[word]}.values())


_prefilter: Prefilter | None = None


def prefilter() -> Prefilter:
    """The worker's prefilter."""
    global _prefilter
    if _prefilter is None:
        _prefilter = Prefilter(rules())
    return _prefilter


_STRETCH = 256

_MARK = rb"(?:/\*+|\*+/|\*+|//+|#+|;+|%+|--+|>+|\|+|!+|<!--+|(?:dnl|rem)(?=\s))"

_LEAD, _TAIL = re.compile(rb"(?:\s*" + _MARK + rb")+"), re.compile(rb"\s" + _MARK + rb"\s*\Z")
_LEADS, _TAILS = frozenset(b"/*#;%->|!<dr"), frozenset(b"/*#;%->|!lm")


def folded(low: bytes) -> bytes:
    """The text with each run of white space as one space, without comment marks before and after its line breaks."""
    lines = low.splitlines()
    for k, line in enumerate(lines):
        body = line.strip()
        if k and body and body[0] in _LEADS:
            m = _LEAD.match(line)
            line = line[m.end() :] if m else line
        if k < len(lines) - 1 and body and body[-1] in _TAILS:
            m = _TAIL.search(line)
            line = line[: m.start()] if m else line
        lines[k] = line
    return b" ".join(b" ".join(lines).split())


def detect(low: bytes) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of the accepted detections in a lower-cased text, as places of its ``folded`` form."""
    text = folded(low).decode("utf-8", "replace")
    tried = prefilter().tried(text)
    if not tried:
        return []
    found = [(m.start(), m.end(), rule) for rule in tried for m in rule.pattern.finditer(text)]
    found.sort(key=lambda d: (d[2].section, d[0] - d[1], d[0], d[2].place))
    kept: list[tuple[int, int, Rule]] = []
    near: dict[int, list[tuple[int, int]]] = {}  # accepted intervals by the stretches of text they touch
    for a, b, rule in found:
        if not any(x <= a and b <= y for x, y in near.get(a // _STRETCH, ())):
            kept.append((a, b, rule))
            for k in range(a // _STRETCH, b // _STRETCH + 1):
                near.setdefault(k, []).append((a, b))
    return kept


def phrase_places(words: Words) -> list[tuple[np.ndarray, str]]:
    """For each base phrase, the numbers (in the chunk) of the words it starts at, and its label."""
    hashes = words.hashes()
    text_of = np.repeat(np.arange(len(words.first) - 1), words.counts())
    out = []
    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        wanted = [span_hashes(np.frombuffer(p, np.uint8), np.array([0]), np.array([len(p)]))[0] for p in parts]
        at = np.flatnonzero(hashes == wanted[0])
        for k, h in enumerate(wanted[1:], 1):
            at = at[at + k < len(hashes)]
            at = at[(hashes[at + k] == h) & (text_of[at + k] == text_of[at])]
        at = np.array([i for i in at.tolist() if words.text(i, i + len(parts)) == phrase.encode()], np.int64)
        out.append((at, label))
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _chunk(doc_ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    words = Words(data, offsets, alnum_words())
    n = len(offsets) - 1
    places: list[list[int]] = [[] for _ in range(n)]
    base: list[set[str]] = [set() for _ in range(n)]
    for at, label in phrase_places(words):
        for i, k in zip((np.searchsorted(words.first, at, "right") - 1).tolist(), at.tolist(), strict=True):
            places[i].append(k - int(words.first[i]))
            base[i].add(label)
    low = LOWER[data].tobytes()
    labels, scores = [], []
    for i in range(n):
        weights = dict.fromkeys(base[i], BASE_WEIGHT)
        for _, _, rule in detect(low[offsets[i] : offsets[i + 1]]):
            weights[rule.label] = max(weights.get(rule.label, 0), rule.weight)
        labels.append(",".join(sorted(weights)))
        rest = 1.0
        for label in sorted(weights):
            rest *= 1 - weights[label]
        scores.append(round(1 - rest, 9))
    columns = [
        doc_ids.cast(pa.int64()),
        pa.array(words.counts().astype(np.int64)),
        pa.array([len(p) for p in places], pa.int64()),
        pa.array([min(p, default=None) for p in places], pa.int64()),
        pa.array([max(p, default=None) for p in places], pa.int64()),
        pa.array([",".join(sorted(b)) for b in base], pa.string()),
        pa.array(labels, pa.string()),
        pa.array(scores, pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def _scan(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in chunks(batch.column("text")):
            yield _chunk(batch.column("doc_id").slice(i, j - i), data, offsets)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of ``docs`` (doc_id, text)."""
    return in_batches(docs.select("doc_id", "text")).mapInArrow(_scan, SCHEMA)
