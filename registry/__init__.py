"""Queries over the given tables, one module per operator family."""

from . import annotated, findings, rules, structure, tokens, verdicts  # noqa: F401
from .core import ORACLE, QUERIES, with_stages


def oracle() -> dict[str, str]:
    """SQL twins with their shared stages."""
    return {name: with_stages(sql) for name, sql in ORACLE.items()}


__all__ = ["ORACLE", "QUERIES", "oracle"]
