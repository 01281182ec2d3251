"""All registered queries and their SQL oracles."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("texts", "readings", "naming", "dictionaries", "rules", "blocks", "streams")


def queries() -> dict:
    return {name: q for m in MODULES for name, q in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__package__}.{m}").ORACLES.items()}
