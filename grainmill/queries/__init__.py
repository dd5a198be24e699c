"""The engine's queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import data, graph, web

QUERIES = {**web.QUERIES, **data.QUERIES, **graph.QUERIES}
ORACLES = {**web.ORACLES, **data.ORACLES, **graph.ORACLES}
