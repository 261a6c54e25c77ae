"""All registered queries."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict = {}

for _name in ("queries_text", "queries_vectors", "queries_eval", "queries_ops", "queries_stream", "queries_files",
              "queries_reports"):
    _module = importlib.import_module(f"notemill.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
