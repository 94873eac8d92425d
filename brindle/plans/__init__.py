"""Query text to plan."""

from brindle.plans.search import QuerySpec, apropos, batch_search, compile_query, search

__all__ = ["QuerySpec", "apropos", "batch_search", "compile_query", "search"]
