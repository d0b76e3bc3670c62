"""Registered queries: importing this package fills the registry."""

from . import candles, catalogue, conditions, cross_section, evidence, features, matrix, models, outcomes, patterns, recursive, research, rest, studies, tables, templates  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
