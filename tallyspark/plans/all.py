"""The catalogs together."""

from tallyspark.plans import catalog_cases, catalog_gates, catalog_more, catalog_notes, catalog_pages, catalog_rules, catalog_structure, catalog_views  # noqa: F401  register their queries
from tallyspark.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
