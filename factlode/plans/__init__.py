"""Named queries over the driver's tables, each beside its DuckDB equivalent."""

from . import claims, graphs, history, literals, rollup, search

_MODULES = (search, history, rollup, graphs, claims, literals)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
