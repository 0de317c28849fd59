"""Registered queries of the fact engine."""

from factloom.plans import audits, durable, governance, lifecycle, listing, retrieval, upkeep  # noqa: F401
from factloom.plans.registry import QUERIES as CORE_QUERIES
from factloom.plans.registry import SQL as CORE_SQL

__all__ = ["CORE_QUERIES", "CORE_SQL"]
