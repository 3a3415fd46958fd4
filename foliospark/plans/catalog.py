"""The registered queries of the retrieval engine and their SQL oracles."""

from __future__ import annotations

from .oracles import ORACLES
from .queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
