"""The catalogue of queries over the driver's tables, with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("corpus", "preferences", "sampling", "evaluation", "artifacts", "exchange", "contracts")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"selvedge.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"selvedge.plans.{m}").SQL.items()}
