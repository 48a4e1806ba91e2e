"""Spans (kind, start, end) in code points, and their digest columns; shared by secret and personal-data scans."""

from __future__ import annotations

import hashlib

import pyarrow as pa

Span = tuple[str, int, int]


def joined(spans: list[Span], order: dict[str, int]) -> str:
    """kind:start:end by start, then by the kind's place in ``order`` and the end, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], order[s[0]], s[2])))


def digest_batch(doc_ids: pa.Array, found: list[list[Span]], base: list[str], order: dict[str, int]) -> pa.RecordBatch:
    """doc_id, n_<kind> for each base kind, base_sha256 and spans."""
    counts = {k: [0] * len(found) for k in base}
    digests, texts = [], []
    for i, spans in enumerate(found):
        own = [s for s in spans if s[0] in counts]
        for s in own:
            counts[s[0]][i] += 1
        digests.append(hashlib.sha256(joined(own, order).encode()).hexdigest())
        texts.append(joined(spans, order))
    columns = [doc_ids.cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"])


def digest_schema(base: list[str]) -> str:
    return "doc_id long, " + ", ".join(f"n_{k} long" for k in base) + ", base_sha256 string, spans string"
