"""Ready-made queries over the test tables, each with its SQL twin."""

from paperfold.plans import (  # noqa: F401
    chats, extractions, functions, jobs, lineages, retrievals, reviews, scopes, sources, topics, views,
)
from paperfold.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
