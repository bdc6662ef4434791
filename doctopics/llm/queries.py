"""Registers the queries of all operators."""

from doctopics.llm.base import ORACLES, QUERIES
from doctopics.llm import q_pages, q_text  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
