"""All queries of the engine and their oracles."""

from __future__ import annotations

from fathomline.plans import catalog, catalog_aggregates, catalog_formats, catalog_kernels, catalog_matching, catalog_more

PARTS = (catalog, catalog_aggregates, catalog_kernels, catalog_more, catalog_matching, catalog_formats)
QUERIES = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLE = {k: v for part in PARTS for k, v in part.ORACLE.items()}
