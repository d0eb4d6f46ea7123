"""The query catalog: each name's DataFrame query and, where SQL can express it, its DuckDB form."""

from __future__ import annotations

from millrace.queries import documents, evaluations, files, logs, ranking, services, web_pages  # noqa: F401
from millrace.queries.registry import CATALOG, ORACLES

flagship = CATALOG["q02_pdf_inventory"]

__all__ = ["CATALOG", "ORACLES", "flagship"]
