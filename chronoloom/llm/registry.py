"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import decontamination, exact_dedup, jaccard_join, language_id, line_dedup, piece_sampling, quality, suffix_dedup, token_counts, toxicity

MODULES = (token_counts, language_id, piece_sampling, exact_dedup, decontamination, quality, jaccard_join, suffix_dedup, line_dedup, toxicity)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
