"""All queries of the engine by name, and their SQL oracles."""

from __future__ import annotations

from ..functions import probes
from ..operators import assembly, calculations, catalog, checks, edges, explore, findings, graph, integrity, rules, sequences, texts, tree
from ..streaming import sessions
from . import service, templates

_MODULES = (catalog, edges, calculations, checks, integrity, rules, sequences, texts, graph, explore, findings, tree, assembly, service, templates, sessions, probes)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
