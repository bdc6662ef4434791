"""Registered queries: one per operator, each with the SQL that must give the same rows."""

from doctopics.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "load_all"]


def load_all() -> None:
    from doctopics.plans import (  # noqa: F401
        check_queries,
        cleaning_queries,
        comparison_queries,
        evaluation_queries,
        model_queries,
        selection_queries,
        term_queries,
        topic_queries,
        vector_queries,
    )
