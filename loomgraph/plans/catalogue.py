"""All core queries by name."""

from __future__ import annotations

from loomgraph.plans import feeds, graph

FLAGSHIP = "claim_confidence"
_MODULES = (graph, feeds)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
