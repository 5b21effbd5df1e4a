"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that later expressions and filters see as values, not as copies of their expressions.

    They are made in a projection, which Spark compiles, and then go through an inlined struct, through which Spark
    moves no expression. A column of the same name is replaced. The columns may not hold Python functions.
    """
    made = rows.withColumns(columns)
    kept = [F.col(f"`{c}`") for c in made.columns if c not in columns]
    return made.select(*kept, F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in columns]))))
