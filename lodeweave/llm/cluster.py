"""What the corpus operators use of the cluster: the shared folder and the tables."""

from __future__ import annotations

from ..session import cut, folder, shared, written
from ..sources.files import table

__all__ = ["cut", "folder", "shared", "table", "written"]
