"""Operators as DataFrame transforms; importing this package registers their queries."""

from . import cues, documents, dynamics, edits, evaluation, interval_queries, ledger, mixing, pictures, replay, search, segments, signal, textsearch  # noqa: F401
