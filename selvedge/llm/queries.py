"""The pN_ queries and their SQL, collected from the problem modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("pii", "formatting_copies", "spam_pages", "eval_leaks", "token_budget", "packing", "lookalikes", "broken_pairs", "near_duplicates", "split_overlaps",)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"selvedge.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"selvedge.llm.{m}").SQL.items()}
