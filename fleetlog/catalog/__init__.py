"""Registered queries: each operator run over whole driver tables, with SQL that computes the same.

The tables hold no device logs. Most queries therefore *render* table rows as log lines in the log
grammar (``render.py``), run the real extractor over all of them, and compare with SQL that works on
the structured columns.
"""

from fleetlog.catalog import ask_q, docs_q, facts_q, extract_q, knowledge_q, lines_q, ordered_q, sessions_q, stall_q  # noqa: F401
from fleetlog.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
