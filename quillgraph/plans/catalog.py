"""All registered queries of the citation-graph operators."""

from __future__ import annotations

from quillgraph.plans import collection, external, graph, maps, meaning, model, text  # noqa: F401
from quillgraph.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
