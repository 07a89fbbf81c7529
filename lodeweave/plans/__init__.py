"""Queries over the star-schema tables, with the SQL they must agree with."""

from . import analytics, loading, recommend  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
