"""Operators for preparing language-model training data, one module each.

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()`` gather what the modules register.
"""

from __future__ import annotations


def _modules():
    from weftline.llm import bpe, cotrain, decontam, html_runs, jaccard_join, pii, ppm, quality_kn, token_counts, toxicity

    return ppm, toxicity, html_runs, pii, token_counts, bpe, jaccard_join, quality_kn, decontam, cotrain


def queries() -> dict:
    """Name -> function of (spark, sf_dir) for the ten operators."""
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    """Name -> DuckDB SQL, for the operators that SQL can express."""
    return {name: q for m in _modules() for name, q in getattr(m, "ORACLE_SQL", {}).items()}
