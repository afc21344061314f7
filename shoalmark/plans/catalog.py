"""All registered queries."""

from . import q_blocks, q_catch, q_compare, q_index, q_infer, q_length, q_sources, q_spatial  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
