"""All registered queries."""

from claimloom.plans import claims, documents, learned, stored, streams  # noqa: F401
from claimloom.plans.registry import QUERIES

__all__ = ["QUERIES"]
