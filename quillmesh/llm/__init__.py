"""Operators for large training corpora. Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib

#: Modules with a QUERIES table (name -> callable) and an ORACLES table (name -> SQL).
_MODULES = (
    "url_filter",
    "byte_bpe",
    "simhash",
    "mpeg_audio",
    "quality",
    "pii",
    "token_store",
    "packing",
    "sharding",
    "ann",
)


def _modules():
    return [importlib.import_module(f"{__name__}.{m}") for m in _MODULES]


def queries() -> dict:
    """One query for each operator."""
    out = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict:
    """DuckDB SQL for those queries that SQL can express."""
    from quillmesh.llm import url_oracle

    out = {}
    for m in _modules():
        out |= m.ORACLES
    out["op1_url_filter"] = url_oracle.sql()
    return out
