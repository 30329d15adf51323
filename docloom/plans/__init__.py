"""Whole flows, the derived corpus and the registered queries."""

from . import record_queries as record_queries
