"""Every registered query of the engine's own operators, with its DuckDB SQL."""

from __future__ import annotations

from . import modelling, movement, relational, series, statistics, texts

MODULES = (relational, statistics, series, texts, modelling, movement)
FLAGSHIP = "wn01_latest_per_key"


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
