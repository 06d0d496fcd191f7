"""Registered queries and their SQL."""

from . import code, core, derived, enforcement, graphs, memory, patterns, streams, structure, text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
