"""Every registered query. Importing the package fills the registry."""

import importlib

from tidewatch.catalog.registry import QUERIES, Query

for _module in ("ingest", "stories", "reading", "moving", "places", "archive", "entities"):
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["QUERIES", "Query"]
