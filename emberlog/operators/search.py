"""Search in numbered lines: keywords, addresses, networks, dates, context lines and statistics."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.columns import settled
from emberlog.functions.ip import any_in_networks, canonical, find_ips
from emberlog.functions.text import casefold
from emberlog.functions.time import date_bound, leading_instant, leading_texts, zone_of
from emberlog.scratch import scratch, stored

MOST_KEYWORDS, LONGEST_KEYWORD = 20, 200
MOST_MATCHES, MOST_CONTEXT = 10_000, 20
#: Numbers of lines to show that are broadcast, at most.
MOST_BROADCAST = 500_000


@dataclass(frozen=True)
class Query:
    """What a line must have: a keyword (or all), an address or network, a leading date in a range. Made by `query`."""

    keywords: tuple[str, ...] = ()
    match_all: bool = False
    case_sensitive: bool = False
    ips: tuple[str, ...] = ()
    networks: tuple[ipaddress.IPv4Network | ipaddress.IPv6Network, ...] = field(default=())
    start: datetime | None = None
    end: datetime | None = None
    zone: str = "UTC"
    year: int = 2026


def query(keywords=(), *, match_all=False, case_sensitive=False, ips=(), cidrs=(), start=None, end=None, zone="UTC", year=2026) -> Query:
    """A checked query. Raises ValueError for a criterion that is invalid, or if there is none."""
    words = tuple(keywords)
    if len(words) > MOST_KEYWORDS:
        raise ValueError(f"more than {MOST_KEYWORDS} keywords")
    if any(not w.strip() or len(w) > LONGEST_KEYWORD for w in words):
        raise ValueError(f"a keyword is blank or longer than {LONGEST_KEYWORD} characters")
    exact = tuple(sorted({canonical(x.strip()) or "" for x in ips}))
    if "" in exact:
        raise ValueError("an address is invalid")
    networks = tuple(ipaddress.ip_network(x.strip(), strict=False) for x in cidrs)
    zone_of(zone)
    first, last = start and date_bound(start, zone), end and date_bound(end, zone, end=True)
    if first and last and first > last:
        raise ValueError("the start is after the end")
    if not (words or exact or networks or first or last):
        raise ValueError("at least one criterion is needed")
    return Query(words if case_sensitive else tuple(w.casefold() for w in words), match_all, case_sensitive, exact, networks, first or None, last or None, zone, year)


def keyword_hit(text: Column, q: Query) -> Column:
    hay, hit = text if q.case_sensitive else casefold(text), F.lit(q.match_all)
    for w in q.keywords:
        found = F.contains(hay, F.lit(w))
        hit = (hit & found) if q.match_all else (hit | found)
    return hit


def _criteria(lines: DataFrame, q: Query) -> tuple[DataFrame, list[str], Column, Column]:
    """lines with helper columns, their names (which no column of the caller has), and whether a line matches or is undated."""
    text, others, helpers = F.col("text"), F.lit(True), []

    def helper(label: str, value: Column, once: bool = False) -> Column:
        nonlocal lines
        while label.lower() in {c.lower() for c in lines.columns}:
            label += "_"
        lines = settled(lines, **{label: value}) if once else lines.withColumn(label, value)
        helpers.append(label)
        return F.col(label)

    if q.keywords:
        others &= keyword_hit(text, q)
    if q.ips or q.networks:
        found = helper("_ips", find_ips(text))
        others &= F.arrays_overlap(found, F.array(*[F.lit(x) for x in q.ips]).cast("array<string>")) | any_in_networks(found, list(q.networks))
    in_range, undated = F.lit(True), F.lit(False)
    if q.start or q.end:
        iso, old = (helper(f"_text{k}", found, once=True) for k, found in enumerate(leading_texts(text)))
        us = helper("_us", F.unix_micros(leading_instant(iso, old, q.year, q.zone)), once=True)
        micros = lambda t: int(t.timestamp()) * 1_000_000 + t.microsecond
        undated = us.isNull()
        in_range = ~undated & (us >= micros(q.start) if q.start else F.lit(True)) & (us <= micros(q.end) if q.end else F.lit(True))
    others = helper("_others", F.coalesce(others, F.lit(False)))
    return lines, helpers, others & in_range, others & undated


def evaluated(lines: DataFrame, q: Query) -> DataFrame:
    """lines (text) with is_match and undated: all other criteria hold, but a date is asked for and the line has none.

    Columns of these two names are replaced, all others are kept.
    """
    rows, _, hit, undated = _criteria(lines, q)
    own = [F.col(f"`{c}`") for c in lines.columns if c.lower() not in ("is_match", "undated")]
    return rows.select(*own, hit.alias("is_match"), undated.alias("undated"))


def matches(lines: DataFrame, q: Query) -> DataFrame:
    """The lines that match, with all their columns."""
    rows, helpers, hit, _ = _criteria(lines, q)
    return rows.where(hit).drop(*helpers)


def capped(lines: DataFrame, q: Query, most: int | None = MOST_MATCHES) -> tuple[DataFrame, DataFrame]:
    """The first `most` matches of each source, and (source, stop) of the sources that have one more, stop being its line.

    None: all matches, and no source is stopped. Only matches are ranked, and no more than most + 1 of a source are
    shuffled.
    """
    found = matches(lines, q).select("source", "line_no")
    if most is None:
        return found, found.where("false").select("source", F.col("line_no").alias("stop"))
    if most < 1:
        raise ValueError("most must be 1 or more")
    order = Window.partitionBy("source").orderBy("line_no")
    few = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most + 1)
    return few.where(F.col("place") <= most).drop("place"), few.where(F.col("place") == most + 1).select("source", F.col("line_no").alias("stop"))


def search(lines: DataFrame, q: Query, context: int = 0, most: int | None = None) -> DataFrame:
    """(source, line_no, text, is_match, block): matches and the lines around them, each once; block counts runs of adjacent lines.

    most: matches of a source that are shown (see capped), all by default. The numbers of the lines to show are stored
    and counted: up to MOST_BROADCAST are broadcast, so that no text of another line is shuffled; beyond that lines and
    numbers are joined by a shuffle.
    """
    if not 0 <= context <= MOST_CONTEXT:
        raise ValueError(f"context must be 0 to {MOST_CONTEXT}")
    found, stops = capped(lines, q, most)
    near = found.select("source", F.explode(F.sequence(F.col("line_no") - context, F.col("line_no") + context)).alias("line_no"), F.col("line_no").alias("of"))
    shown = near.groupBy("source", "line_no").agg(F.max(F.col("of") == F.col("line_no")).alias("is_match"))
    if most is not None:
        shown = shown.join(stops, "source", "left").where(F.col("stop").isNull() | (F.col("line_no") < F.col("stop"))).drop("stop")
    shown = stored(shown, f"{scratch(lines.sparkSession, 'search')}/shown")
    side = F.broadcast(shown) if shown.count() <= MOST_BROADCAST else shown
    rows = lines.select("source", "line_no", "text").join(side, ["source", "line_no"])
    order = Window.partitionBy("source").orderBy("line_no")
    gap = (F.col("line_no") - F.lag("line_no", 1).over(order) > 1).cast("int")
    return rows.withColumn("block", F.coalesce(gap, F.lit(1))).withColumn("block", F.sum("block").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def search_stats(lines: DataFrame, q: Query, most: int | None = None) -> DataFrame:
    """(source, lines_read, matches, undated, truncated, stopped_early).

    most: with it, lines after the match that is one too many don't count (see capped); by default all do. The stops, a
    row a source, are stored and counted, and broadcast up to MOST_BROADCAST.
    """
    lines = lines if "truncated" in lines.columns else lines.withColumn("truncated", F.lit(False))
    read, stop = evaluated(lines, q).select("source", "line_no", "is_match", "undated", "truncated"), F.lit(None).cast("bigint")
    if most is not None:
        stops = stored(capped(lines, q, most)[1], f"{scratch(lines.sparkSession, 'search')}/stops")
        side, stop = F.broadcast(stops) if stops.count() <= MOST_BROADCAST else stops, F.col("stop")
        read = read.join(side, "source", "left").where(stop.isNull() | (F.col("line_no") <= stop))
    out = read.groupBy("source").agg(F.max("line_no").alias("lines_read"), F.count_if("is_match").alias("found"), F.count_if("undated").alias("undated"), F.count_if("truncated").alias("truncated"), F.max(stop).isNotNull().alias("stopped_early"))
    shown = F.col("found") if most is None else F.least("found", F.lit(most))
    return out.select("source", "lines_read", shown.alias("matches"), "undated", "truncated", "stopped_early")


def search_json(found: DataFrame, stats: DataFrame) -> DataFrame:
    """(source, line_no, json): the statistics of each source as a JSON record, with line_no 0, and each shown line as one."""
    record = lambda df, *names: df.select("source", F.col("line_no").cast("bigint").alias("line_no"), F.to_json(F.struct(*names)).alias("json"))
    head = record(stats.withColumn("line_no", F.lit(0)), "source", "lines_read", "matches", "undated", "stopped_early")
    return head.union(record(found, "source", "line_no", "is_match", "text"))
