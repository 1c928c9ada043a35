"""Imports every query module, so that the registry is full."""

from gazette.plans import (  # noqa: F401
    book, contracts, corpus, documents, evaluation, fields, geography, ingest, publication, search,
    streams,
)
from gazette.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
