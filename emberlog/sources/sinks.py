"""Writers that don't overwrite unless told to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import safe_csv_cell


def _mode(force: bool) -> str:
    return "overwrite" if force else "errorifexists"


def write_csv(df: DataFrame, path: str, force: bool = False) -> None:
    """CSV with a header; text cells that a spreadsheet would run are neutralised."""
    cells = [safe_csv_cell(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema]
    df.select(*cells).write.mode(_mode(force)).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, force: bool = False) -> None:
    """JSON lines."""
    df.write.mode(_mode(force)).json(path)


def write_rows(df: DataFrame, column: str, path: str, force: bool = False) -> None:
    """One text column, a line for each row."""
    df.select(F.col(column).alias("value")).write.mode(_mode(force)).text(path)
