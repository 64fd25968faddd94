"""Registered queries of the library's own operators, each beside its SQL twin."""

from __future__ import annotations

from quillspan.jobs.retrieve import flagship
from quillspan.queries import ingest, layout, memory, retrieval, streams, web  # noqa: F401
from quillspan.queries.core import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
