"""Registered queries over the standard tables, each with its SQL where SQL can express it."""

from . import evolution_queries, profile_queries, score_queries, search_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
