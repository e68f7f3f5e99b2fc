"""Registered queries, each with the SQL it must agree with."""

from . import checks, comparison, corpus, evaluation, kernels, ordered, relational, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
