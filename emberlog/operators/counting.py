"""Counts of login attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.time import iso_seconds, local_hour
from emberlog.operators.ranks import numbered
from emberlog.scratch import scratch, stored
from emberlog.sources.logins import unparsed_lines

#: What counts can be ranked by, the largest first; ties by the key.
ORDERS = {"failure": ("failure", "total"), "total": ("total", "failure"), "success": ("success", "total"), "rate": ("failure_rate", "total"), "key": ()}


def _tally() -> list[Column]:
    count = lambda outcome: F.coalesce(F.sum(F.when(F.col("outcome") == outcome, F.col("n"))), F.lit(0))
    return [count("success").alias("success"), count("failure").alias("failure"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")]


def counts_by(events: DataFrame, key: str) -> DataFrame:
    """(key, success, failure, total)."""
    return events.groupBy(F.col(key).alias("key")).agg(*_tally())


def _totals() -> list[Column]:
    invalid = F.coalesce(F.sum(F.when(F.col("invalid_user") & (F.col("outcome") == "failure"), F.col("n"))), F.lit(0))
    return [*_tally(), invalid.alias("invalid_user_failures"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")]


def login_totals(events: DataFrame) -> DataFrame:
    """One row: totals, failure_rate in percent (null without attempts), failures of unknown accounts, first and last time."""
    return events.agg(*_totals()).withColumn("failure_rate", F.try_divide(100.0 * F.col("failure"), F.col("total")))


def counts_grouping_sets(events: DataFrame) -> DataFrame:
    """(dimension, key, success, failure, total) by user, by ip, and over all, in one pass."""
    grouped = events.groupingSets([[F.col("user")], [F.col("ip")], []], "user", "ip").agg(*_tally(), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 1, "user").when(F.col("g") == 2, "ip").otherwise("total")
    return grouped.select(dimension.alias("dimension"), F.coalesce("user", "ip").alias("key"), "success", "failure", "total")


def counts_export(events: DataFrame) -> DataFrame:
    """(dimension, key, success, failure, total) of all users and then all addresses, each ranked: the rows of a counts file."""
    return counts_grouping_sets(events).where("dimension != 'total'").orderBy(F.desc("dimension"), F.desc("failure"), F.desc("total"), "key")


def failure_rates(counts: DataFrame) -> DataFrame:
    """counts with failure_rate in percent, null without attempts."""
    return counts.withColumn("failure_rate", F.try_divide(100.0 * F.col("failure"), F.col("total")))


def failures_by_hour(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """(hour, failures, total) of each hour of the day in a zone, also of those without attempts."""
    counts = events.groupBy(local_hour(F.col("ts"), zone).alias("hour")).agg(*_tally())
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    filled = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return F.broadcast(hours).join(counts, "hour", "left").select("hour", filled("failure").alias("failures"), filled("total"))


def ranked(counts: DataFrame, top: int = 0, by: str = "failure") -> DataFrame:
    """counts with place, their number from 1; top 0: all rows.

    by: one of ORDERS. By default most failures come first, then most attempts, then the key; `rate` needs failure_rates.
    """
    if by not in ORDERS:
        raise ValueError(f"counts are ranked by {', '.join(ORDERS)}, not by {by!r}")
    order = [*[F.desc(c) for c in ORDERS[by]], F.col("key")]
    if top:
        return counts.orderBy(*order).limit(top).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # top rows
    return numbered(stored(counts, f"{scratch(counts.sparkSession, 'counts')}/counts"), *order, name="place")


def file_stats(parsed: DataFrame) -> DataFrame:
    """Lines, events (repeats counted), ignored and unparsed lines of each source."""
    return parsed.groupBy("source", "fmt").agg(
        F.max("line_no").alias("lines"),
        F.coalesce(F.sum(F.when(F.col("status") == "event", F.col("n"))), F.lit(0)).alias("events"),
        F.count_if(F.col("status") == "ignored").alias("ignored"),
        F.count_if(F.col("status") == "unparsed").alias("unparsed"),
    )


def unparsed_sample(unparsed: DataFrame, most: int = 500) -> DataFrame:
    """The first unparsed lines in reading order."""
    return unparsed.orderBy("source", "line_no").limit(most)


def summary_json(parsed: DataFrame) -> DataFrame:
    """(section, name, json): the summary of parsed lines (with fmt) as JSON records; times are UTC, to the second.

    One record of the section totals, one for each source (file), account (user), address (ip) and line of the sample
    of unparsed ones. Accounts and addresses grow with the logs, so each is a row, not an element of one document.
    """
    record = lambda df, section, name, *columns: df.select(F.lit(section).alias("section"), name.alias("name"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
    # lines that are no event have neither n nor a time, so they count for nothing but unparsed
    totals = parsed.agg(*_totals(), F.count_if(F.col("status") == "unparsed").alias("unparsed"))
    times = [iso_seconds(F.col(c)).alias(c) for c in ("first_seen", "last_seen")]
    out = record(totals, "totals", F.lit(""), "success", "failure", "total", "invalid_user_failures", *times, "unparsed")
    out = out.union(record(file_stats(parsed), "file", F.col("source"), "source", F.col("fmt").alias("format"), "lines", "events", "ignored", "unparsed"))
    counts = counts_grouping_sets(parsed.where("status = 'event'"))
    for side in ("user", "ip"):
        out = out.union(record(counts.where(F.col("dimension") == side), side, F.col("key"), F.col("key").alias(side), "success", "failure", "total"))
    sample = unparsed_sample(unparsed_lines(parsed))
    return out.union(record(sample, "unparsed", F.concat_ws(":", "source", F.col("line_no").cast("string")), "source", F.col("line_no").alias("line"), "reason", "text"))
