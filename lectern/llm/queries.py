"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("joins", "languages", "licenses", "neighbours", "pages", "pieces", "pseudonyms", "transport", "arrow_files", "packing")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(import_module(f"{__package__}.{m}"), "ORACLES", {}).items()}
