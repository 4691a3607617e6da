"""Runnable queries over the shared test tables, one per operator."""

from . import modeling, pages, tables, terms, text  # noqa: F401
from .base import QUERIES, SQL


def all_queries():
    return dict(QUERIES)


def all_sql():
    return dict(SQL)
