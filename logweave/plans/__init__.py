"""Whole runs, put together from the operators."""

from logweave.plans.search import LogSearch

__all__ = ["LogSearch"]
