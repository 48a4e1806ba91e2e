from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

WORDS = "the of and invoice pays renders footer voids Über ño clause token".split()


def ascii_lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and repeated texts, repeated and null ids, ties, a long text, and columns with clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    texts = [None, "", "   ", "a", "A b c", "a B c", "x y z w v u", "X Y z w v u", long, long, "password = hunter2hunter2 ä", "Apache License", None]
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "c", 1) for i, t in enumerate(texts)]
    rows += [(3, "a", "en", "s", 1, 0.5, "c", 1), (None, "A b c", None, None, None, None, None, None), (20, "unique text of its own here", "fr", "s", 1, 0.5, "c", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, rank int")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
