"""Secret scans by a trigram inverted index.

Every rule is a regular expression. From its parse tree a Boolean query over lower-cased trigrams is derived: a
sequence is an AND over its runs of literal text, an alternation an OR over its branches. For each chunk of whole
texts the postings (trigram -> texts) of all trigrams that some rule asks for are built in one pass over the
bytes; a rule's candidates are found by intersecting and uniting postings, and each candidate text is verified
with the expression itself. Rules without a mandatory trigram (such as ``hex``) scan every text.

Base kinds: assign, access, hex. The method's own kinds are listed in RULES after them.

Cases: null and empty texts have no spans; texts under three bytes have no postings and so match only rules that
scan fully; rows that repeat a doc_id each get their row; an empty table gives no rows; a null doc_id stays null;
other columns are ignored, whatever their names. Whole texts are indexed and verified; memory is one chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as K
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import in_batches
from .spans import Span, digest_batch, digest_schema
from .words import LOWER, chunks


def any_case(word: str) -> str:
    """A pattern of ``word`` with ASCII letters in either case (an IGNORECASE flag would also fold letters beyond ASCII)."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else re.escape(c) for c in word)


_KEY = "|".join(map(any_case, ["password", "passwd", "secret", "token"])) + f"|{any_case('api')}_?{any_case('key')}"

#: Kind -> (pattern, least length of group 1 or of the match, 0 for any).
RULES: dict[str, tuple[str, int]] = {
    "assign": (rf"(?:{_KEY})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]{24,}", 0),  # the runs of [0-9a-f]+ with 24 or more: a run is matched from its first character
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0),
    "github_pat": (r"github_pat_[A-Za-z0-9_]{22,}", 0),
    "gitlab": (r"glpat-[A-Za-z0-9_-]{20,}", 0),
    "slack": (r"xox[abposr]-[A-Za-z0-9-]{10,}", 0),
    "slack_hook": (r"hooks\.slack\.com/services/T[A-Za-z0-9]+/B[A-Za-z0-9]+/[A-Za-z0-9]+", 0),
    "google": (r"AIza[A-Za-z0-9_-]{35}", 0),
    "google_oauth": (r"ya29\.[A-Za-z0-9_-]{20,}", 0),
    "stripe": (r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", 0),
    "sendgrid": (r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", 0),
    "twilio": (r"(?:account_?sid|twilio)[^A-Za-z0-9]{1,8}AC[0-9a-f]{32}", 0),
    "npm": (r"npm_[A-Za-z0-9]{36}", 0),
    "pypi": (r"pypi-AgEI[A-Za-z0-9_-]{50,}", 0),
    "shopify": (r"shp(?:at|ca|pa|ss)_[A-Fa-f0-9]{32}", 0),
    "square": (r"sq0(?:atp|csp)-[A-Za-z0-9_-]{22,}", 0),
    "telegram": (r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}", 0),
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
    "private_key": (r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----", 0),
    "url_login": (r"[a-z][a-z0-9+.-]{1,12}://[^\s/:@]{1,64}:[^\s/@]{3,64}@[A-Za-z0-9.-]+", 0),
    "bearer": (r"[Bb]earer [A-Za-z0-9_.=-]{20,}", 0),
}
BASE = ["assign", "access", "hex"]
ORDER = {k: i for i, k in enumerate(RULES)}

Query = list  # an AND of clauses; a clause is an OR of queries or the code of a trigram; [] holds always
MOST_STRINGS = 32


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every match of ``pattern`` satisfies, over lower-cased UTF-8 bytes."""
    return _of_sequence(parser.parse(pattern))


def _grams(word: bytes) -> Query:
    return sorted({int.from_bytes(word[i : i + 3], "big") for i in range(len(word) - 2)})


def _flush(strings: set[str], query: Query) -> None:
    words = [s.encode() for s in strings]
    if words and all(len(w) > 2 for w in words):
        query += _grams(words[0]) if len(words) == 1 else [[_grams(w) for w in words]]


def few_strings(node) -> set[str] | None:
    """The strings that a node of a parse tree matches, lower-cased, if they are few."""
    op, arg = node
    if op is K.LITERAL:
        c = chr(arg)
        return {c.lower() if c.isascii() else c}
    if op is K.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is not K.LITERAL:
                return None
            out.add(chr(value).lower() if value < 128 else chr(value))
        return out if len(out) <= 8 else None
    if op is K.SUBPATTERN:
        return _strings(arg[3])
    if op is K.BRANCH:
        found = [_strings(x) for x in arg[1]]
        return None if None in found else set().union(*found)
    if op is K.MAX_REPEAT and arg[:2] == (0, 1):
        inner = _strings(arg[2])
        return None if inner is None else inner | {""}
    return None


def _strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = few_strings(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _of_sequence(nodes) -> Query:
    query: Query = []
    run = {""}
    for node in nodes:
        more = few_strings(node)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        _flush(run, query)
        run = {""} if more is None else more
        if more is None:
            op, arg = node
            if op is K.SUBPATTERN:
                query += _of_sequence(arg[3])
            elif op is K.BRANCH:
                parts = [_of_sequence(x) for x in arg[1]]
                if all(parts):
                    query.append(parts)
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0:
                query += _of_sequence(arg[2])
    _flush(run, query)
    return query


def _codes(query: Query) -> Iterator[int]:
    for clause in query:
        if isinstance(clause, int):
            yield clause
        else:
            for part in clause:
                yield from _codes(part)


class Index:
    """The trigrams that the rules ask for, and their postings in a chunk."""

    def __init__(self, rules: dict[str, tuple[str, int]]):
        self.rules = {k: (re.compile(p), n) for k, (p, n) in rules.items()}
        self.queries = {k: trigram_query(p) for k, (p, _) in rules.items()}
        wanted = sorted({c for q in self.queries.values() for c in _codes(q)})
        self.number = {c: i + 1 for i, c in enumerate(wanted)}
        self.table = np.zeros(1 << 24, np.uint16)  # trigram -> its number, 0 for none
        self.table[wanted] = np.arange(1, len(wanted) + 1)

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """For each rule, the mask of the chunk's texts that its query holds for."""
        low = LOWER[data].astype(np.int32)
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else low[:0]
        number = self.table[codes]
        at = np.flatnonzero(number)
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + 2 < offsets[text + 1]
        postings = np.zeros((len(self.number) + 1, len(offsets) - 1), bool)
        postings[number[at[inside]], text[inside]] = True
        return {k: self._holds(q, postings) for k, q in self.queries.items()}

    def _holds(self, query: Query, postings: np.ndarray) -> np.ndarray:
        out = np.ones(postings.shape[1], bool)
        for clause in query:
            if isinstance(clause, int):
                out &= postings[self.number[clause]]
            else:
                out &= np.logical_or.reduce([self._holds(part, postings) for part in clause])
        return out

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[list[Span]]:
        """The spans of every text of the chunk."""
        found: list[list[Span]] = [[] for _ in range(len(offsets) - 1)]
        raw = data.tobytes()
        texts: dict[int, str] = {}
        for kind, mask in self.candidates(data, offsets).items():
            pattern, least = self.rules[kind]
            for i in np.flatnonzero(mask).tolist():
                if i not in texts:
                    texts[i] = raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")
                for m in pattern.finditer(texts[i]):
                    if len(m[pattern.groups]) >= least:
                        found[i].append((kind, m.start(), m.end()))
        return found


_index: Index | None = None


def index() -> Index:
    """The worker's index of RULES."""
    global _index
    if _index is None:
        _index = Index(RULES)
    return _index


def _scan(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for i, j, data, offsets in chunks(batch.column("text")):
            yield digest_batch(ids.slice(i, j - i), index().spans(data, offsets), BASE, ORDER)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of ``docs`` (doc_id, text)."""
    return in_batches(docs.select("doc_id", "text")).mapInArrow(_scan, digest_schema(BASE))
