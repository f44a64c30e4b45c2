"""Registered queries over the given tables."""

from fieldloom.plans import (
    claims_queries, document_queries, graph_queries, mapping_queries, response_queries, source_queries, vector_queries)
from fieldloom.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
