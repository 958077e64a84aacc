"""Queries over the driver's tables: each binds operators to whole tables and registers its SQL."""

from . import evidence, facts, faithfulness, methods, quality, retrieval, scalars, sequence, steps, verdicts, verification  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
