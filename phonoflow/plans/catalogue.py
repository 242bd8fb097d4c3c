"""All registered queries of the speech and language-model operators, with their DuckDB oracles."""

from __future__ import annotations

from phonoflow.plans import file_queries, model_queries, signal_queries, text_queries  # noqa: F401  (they register)
from phonoflow.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
