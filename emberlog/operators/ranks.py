"""Exact numbers from 1 in an order, over a whole table or inside groups, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.scratch import scratch, stored

#: Row counts (one for each task and group) that are broadcast, at most; with more, they are joined by a shuffle.
MOST_BROADCAST = 100_000
#: monotonically_increasing_id() holds the number of a row in its task in so many bits.
ROW_BITS = 33


def numbered(rows: DataFrame, *order: Column, groups: tuple[str, ...] = (), name: str = "rank", total: str | None = None) -> DataFrame:
    """rows with `name`, their number (bigint) from 1 in the order given, in each of groups if there are any.

    total: a further column, the number of rows of the group. Rows that are equal in order are numbered in any order,
    fixed once they are stored; give enough columns to decide it. Null is a group like any other.

    Rows are dealt to tasks by ranges of (groups, order) and sorted there. A row's number is its place in its task plus
    what the tasks before it hold of its group: prefix sums over one row a task and group. A group or an order of very
    many equal rows is cut by a random column behind the order, so no task gets more than its share. rows is read twice.
    """
    path = scratch(rows.sparkSession, "numbers")
    keys = [F.col(f"`{g}`").alias(f"_number_group{k}") for k, g in enumerate(groups)]
    own = [f"_number_group{k}" for k in range(len(keys))]
    # the order's columns are those of the caller, so they are sorted by before they are dropped
    ranged = rows.select("*", *keys, F.rand(7).alias("_number_tie"))
    by = [F.col(c).asc_nulls_first() for c in own] + [*order, F.col("_number_tie")]
    placed = ranged.repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    placed = placed.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *own, F.shiftright(at, ROW_BITS).alias("task"), at.alias("at"))
    placed = stored(placed, f"{path}/placed")
    counts = placed.groupBy(*own, "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    counts = stored(counts, f"{path}/counts") if groups else counts
    every = Window.partitionBy(*own)  # without groups one row a task
    earlier = F.coalesce(F.sum("n").over(every.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(c).alias(f"of_{c}") for c in own], F.col("task").alias("of_task"), (earlier - F.col("first") + 1).alias("start"), F.sum("n").over(every).alias("total"))
    if not groups or counts.count() <= MOST_BROADCAST:  # without groups a row a task
        starts = F.broadcast(starts)
    same = [F.col("task") == F.col("of_task"), *[F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in own]]
    out = [(F.col("start") + F.col("at")).alias(name), *([F.col("total").alias(total)] if total else [])]
    return placed.join(starts, same).select("row.*", *out)
