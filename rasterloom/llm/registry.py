"""All queries of this subpackage, with the pipeline of the repository's top folder."""

from __future__ import annotations

from rasterloom.llm import queries  # noqa: F401
from rasterloom.llm.shared import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
