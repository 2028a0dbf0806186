"""Imports every query module so that the registry is complete."""

from . import model_queries, profile_queries, table_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
