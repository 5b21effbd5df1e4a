"""Summaries of validated security events, and their rows for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import html_escape, md_escape
from emberlog.functions.time import format_timestamp, local_day
from emberlog.operators.ranks import numbered
from emberlog.schemas import NO_SOURCE, SEVERITIES, SEVERITY_LABELS, URGENT
from emberlog.scratch import scratch, stored

MOST_SOURCES = 50
#: Two events with the same values here are the same event, wherever each was read from.
SAME = ("ts", "severity", "title", "source", "description", "ip", "user")
NOTABLE = 3


def severities(spark) -> DataFrame:
    """(severity, rank, label): the five severities."""
    return spark.createDataFrame(list(zip(SEVERITIES, range(len(SEVERITIES)), SEVERITY_LABELS, strict=True)), "severity string, rank int, label string")


def severity_rank(severity: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1).cast("int")


def severity_label(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in zip(SEVERITIES, SEVERITY_LABELS, strict=True) for x in pair]), severity)


def events_by_severity(events: DataFrame) -> DataFrame:
    """(severity, rank, events): every severity, also those without events."""
    counts = events.groupBy("severity").agg(F.count("*").alias("events"))
    return F.broadcast(severities(events.sparkSession)).join(counts, "severity", "left").select("severity", "rank", F.coalesce("events", F.lit(0)).alias("events"))


def _top(counts: DataFrame, most: int) -> DataFrame:
    return counts.orderBy(F.desc("events"), "name").limit(most)


def events_by_source(events: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    """(name, events) of the most frequent sources; ties by name."""
    return _top(events.groupBy(F.coalesce(F.nullif("source", F.lit("")), F.lit(NO_SOURCE)).alias("name")).agg(F.count("*").alias("events")), most)


def top_values(events: DataFrame, column: str, most: int = 5) -> DataFrame:
    """(name, events) of the most frequent values of ip or user; absent ones don't count."""
    return _top(events.where(F.col(column) != "").groupBy(F.col(column).alias("name")).agg(F.count("*").alias("events")), most)


def events_per_day(events: DataFrame, zone: str = "UTC") -> DataFrame:
    return events.groupBy(local_day(F.col("ts"), zone).alias("day")).agg(F.count("*").alias("events"))


def report_period(events: DataFrame) -> DataFrame:
    """One row: events, first and last."""
    return events.agg(F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def report_highlights(events: DataFrame) -> DataFrame:
    """(kind, name, events): urgent events, and the most repeated address and account if they appear NOTABLE times or more."""
    urgent = events.agg(F.count_if(F.col("severity").isin(*URGENT)).alias("events")).select(F.lit("urgent").alias("kind"), F.lit("").alias("name"), "events")
    for column in ("ip", "user"):
        urgent = urgent.union(top_values(events, column, 1).where(F.col("events") >= NOTABLE).select(F.lit(f"repeated {column}"), "name", "events"))
    return urgent


def compare_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """(severity, rank, before, after, new, gone) of every severity: events of an earlier report and of a later one, those that only the later has, and those that only the earlier has.

    Equal events count as often as they stand in each: two of them before and three after are one new one.
    """
    side = lambda df, was: df.select(*SAME, F.lit(int(was)).alias("was"), F.lit(int(not was)).alias("now"))
    each = side(before, True).union(side(after, False)).groupBy(*SAME).agg(F.sum("was").alias("was"), F.sum("now").alias("now"))
    more = lambda a, b: F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0)))
    counts = each.groupBy("severity").agg(F.sum("was").alias("before"), F.sum("now").alias("after"), more("now", "was").alias("new"), more("was", "now").alias("gone"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("before", "after", "new", "gone")]
    return F.broadcast(severities(before.sparkSession)).join(counts, "severity", "left").select("severity", "rank", *filled)


def ranked_events(events: DataFrame) -> DataFrame:
    """events with severity rank and label, and place: their number from 1, most severe first, then by time and origin. Stored on the way."""
    rows = events.withColumns({"rank": severity_rank(F.col("severity")), "label": severity_label(F.col("severity"))})
    rows = stored(rows, f"{scratch(events.sparkSession, 'report')}/events")
    return numbered(rows, F.col("rank"), F.col("ts"), F.col("origin"), name="place")


def urgent_details(events: DataFrame) -> DataFrame:
    """Urgent events that have a description."""
    return events.where(F.col("severity").isin(*URGENT) & (F.col("description") != ""))


def markdown_rows(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """(origin, row): a Markdown table row for each event."""
    code = F.when(F.col("ip") != "", F.concat(F.lit("`"), "ip", F.lit("`"))).otherwise("")
    cells = [format_timestamp(F.col("ts"), zone), severity_label(F.col("severity")), md_escape(F.col("source")), md_escape(F.col("title")), code, md_escape(F.col("user")), md_escape(F.col("origin"))]
    return events.select("origin", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row"))


def html_rows(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """(origin, row): an HTML table row for each event."""
    code = F.when(F.col("ip") != "", F.concat(F.lit("<code>"), html_escape(F.col("ip")), F.lit("</code>"))).otherwise("")
    cells = [html_escape(format_timestamp(F.col("ts"), zone)), severity_label(F.col("severity")), html_escape(F.col("source")), html_escape(F.col("title")), code, html_escape(F.col("user")), html_escape(F.col("origin"))]
    return events.select("origin", F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>")).alias("row"))
