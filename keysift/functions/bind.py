"""Computing intermediate columns once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def computed_once(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add SQL columns that later steps may use and filter on without repeating them.

    A filter on a plain projected column is pushed below the projection with the whole
    expression copied into it, once per use; for long rule chains the plan then grows
    many times over.  The rows of a one-element array are a boundary it does not cross.
    """
    fields = ", ".join(f"'{name}', {sql}" for name, sql in columns.items())
    return df.selectExpr("*", f"inline_outer(array(named_struct({fields})))")
