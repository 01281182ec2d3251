"""Reading the driver's tables, and small literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def values(rows: list[tuple], columns: str, alias: str = "t") -> str:
    """A literal table that both engines read: (VALUES ...) AS t(columns)."""

    def cell(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        if isinstance(x, int | float):
            return str(x)
        return "'" + x.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS {alias}({columns})"
