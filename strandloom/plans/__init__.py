"""Registered queries: name to (function of session and folder, SQL for an oracle or None)."""

from __future__ import annotations


def registered() -> dict:
    from . import clipping, consensus, edits, features, formats, layout, lookups, matching, reads, sequences, statistics

    out: dict = {}
    for module in (reads, sequences, consensus, clipping, formats, lookups, matching, edits, statistics, layout, features):
        out |= module.QUERIES
    return out
