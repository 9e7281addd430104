"""Full-text search and ranking on Spark."""

from .functions.scoring import BM25
from .index import IndexBuilder, SearchIndex, build_from_documents, create_builder
from .operators.build import IndexOptions, get_default
from .plans.query import AND, AND_NOT, OR, WILDCARD, Combination

__all__ = ["AND", "AND_NOT", "BM25", "Combination", "IndexBuilder", "IndexOptions", "OR", "SearchIndex", "WILDCARD", "build_from_documents", "create_builder", "get_default"]
