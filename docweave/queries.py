"""All queries of the engine and their oracles."""

from .plans import documents, fixtures, pages, storage, structure
from .plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "documents", "fixtures", "pages", "storage", "structure"]
