"""The registered queries: Spark callables and the SQL that they are held against."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES (id -> callable) and ORACLE_SQL (id -> SQL).
MODULES: tuple[str, ...] = ("larkspur.plans.queries_model", "larkspur.plans.queries_scalar", "larkspur.plans.queries_search", "larkspur.plans.queries_graph", "larkspur.plans.queries_evidence", "larkspur.plans.queries_gates", "larkspur.plans.queries_code")


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(name).QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(name).ORACLE_SQL
    return out
