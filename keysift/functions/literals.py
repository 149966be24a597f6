"""Small fixed tables as literal rows (known size to the optimiser, no Python workers)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from keysift.functions.text import sql_text


def literal_table(spark: SparkSession, columns: str, rows: Sequence[tuple]) -> DataFrame:
    """``columns`` is a comma-separated list of names; cells are ints, strings or None."""
    def cell(v) -> str:
        return "null" if v is None else sql_text(v) if isinstance(v, str) else str(v)

    values = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")
