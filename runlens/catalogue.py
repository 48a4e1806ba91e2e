"""Every query of the catalogue, and the SQL that checks it, whichever module it is in."""

from __future__ import annotations

from . import queries_ingest, queries_values
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_ingest", "queries_values"]
