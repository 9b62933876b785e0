"""All queries of the library and their SQL."""

from tessera.plans import catalogs, discovery, evidence, history, jobs, merges, more, quality, retrieval, schemas, semantics, tables, texts  # noqa: F401  they register themselves
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
