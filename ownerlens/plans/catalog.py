"""All registered queries."""
from ownerlens.plans import (  # noqa: F401  (register on import)
    eval_queries, extract_queries, feed_queries, graph_queries, landing_queries, psc_queries, run_queries, search_queries, similarity_queries, text_queries,
)
from ownerlens.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
