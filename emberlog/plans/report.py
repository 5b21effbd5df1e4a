"""Queries that validate and summarise security events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import report
from emberlog.plans.inputs import SECURITY, event_rows
from emberlog.scratch import scratch, stored
from emberlog.sources import events as sources


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.validated(event_rows(spark, sf_dir))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.valid_events(_checked(spark, sf_dir))


def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(spark, sf_dir).select("origin", F.unix_micros("ts").alias("us"), "severity", "title", "source", "ip", F.col("user").alias("account"))


def rejected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.rejected(_checked(spark, sf_dir))


def rejected_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_events(spark, sf_dir).orderBy("origin").limit(100)


def load_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.load_stats(_checked(spark, sf_dir))


def events_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.events_by_severity(_valid(spark, sf_dir))


def events_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.events_by_source(_valid(spark, sf_dir))


def top_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_values(_valid(spark, sf_dir), "ip")


def top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_values(_valid(spark, sf_dir), "user")


def events_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.events_per_day(_valid(spark, sf_dir), "-06:00").select(F.col("day").cast("string").alias("day"), "events")


def report_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_period(_valid(spark, sf_dir)).select("events", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


def report_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the first two thirds of the period, and the one of the last two thirds."""
    events = stored(_valid(spark, sf_dir), f"{scratch(spark, 'report')}/valid")
    first, last = events.agg(F.coalesce(F.unix_micros(F.min("ts")), F.lit(0)), F.coalesce(F.unix_micros(F.max("ts")), F.lit(0))).first()
    third, us = (last - first) // 3, F.unix_micros("ts")
    return report.compare_reports(events.where(us < first + 2 * third), events.where(us >= first + third))


def report_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_highlights(_valid(spark, sf_dir))


def events_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ranked_events(_valid(spark, sf_dir)).select("place", "rank", "label", F.unix_micros("ts").alias("us"), "origin")


def urgent_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.urgent_details(_valid(spark, sf_dir)).select("origin", "severity")


def report_rows_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.markdown_rows(_valid(spark, sf_dir))


def report_rows_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.html_rows(_valid(spark, sf_dir))


NAMES = "validate_events rejected_events rejected_sample load_stats events_by_severity events_by_source top_ips top_users events_per_day report_period report_changes report_highlights events_ranked urgent_details report_rows_md report_rows_html".split()
QUERIES = {name: globals()[name] for name in NAMES}

_WITH = f"WITH {SECURITY}"
_TOP = lambda column: f"SELECT {column} AS name, count(*) AS events FROM sec WHERE {column} != '' GROUP BY 1 ORDER BY events DESC, name LIMIT"
_TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00:00'"

SQL = {
    "validate_events": f"{_WITH} SELECT origin, us, severity, event_type AS title, source, ip, account FROM sec",
    "rejected_events": f"{_WITH} SELECT origin, reason FROM judged WHERE reason IS NOT NULL",
    "rejected_sample": f"{_WITH} SELECT origin, reason FROM judged WHERE reason IS NOT NULL ORDER BY origin LIMIT 100",
    "load_stats": f"{_WITH} SELECT count(*) AS rows_read, count(*) FILTER (WHERE reason IS NULL) AS valid, count(reason) AS rejected FROM judged",
    "events_by_severity": f"""{_WITH} SELECT severity, rank, coalesce(events, 0) AS events FROM (VALUES ('critica', 0), ('alta', 1), ('media', 2), ('baja', 3), ('info', 4)) s(severity, rank)
      LEFT JOIN (SELECT severity, count(*) AS events FROM sec GROUP BY severity) USING (severity)""",
    "events_by_source": f"{_WITH} SELECT CASE source WHEN '' THEN '(sin fuente)' ELSE source END AS name, count(*) AS events FROM sec GROUP BY 1 ORDER BY events DESC, name LIMIT 50",
    "top_ips": f"{_WITH} {_TOP('ip')} 5",
    "top_users": f"{_WITH} {_TOP('account')} 5",
    "events_per_day": f"{_WITH} SELECT CAST(CAST(ts - INTERVAL 6 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS events FROM sec GROUP BY 1",
    "report_period": f"{_WITH} SELECT count(*) AS events, min(us) AS first_us, max(us) AS last_us FROM sec",
    "report_changes": f"""{_WITH}, ends AS (SELECT min(us) AS a, (max(us) - min(us)) // 3 AS third FROM sec),
      same AS (SELECT severity, CAST(count(*) FILTER (WHERE us < a + 2 * third) AS BIGINT) AS was, CAST(count(*) FILTER (WHERE us >= a + third) AS BIGINT) AS now
        FROM sec, ends GROUP BY severity, us, event_type, source, CASE WHEN described THEN value END, ip, account),
      counts AS (SELECT severity, sum(was) AS before, sum(now) AS after, sum(greatest(now - was, 0)) AS new, sum(greatest(was - now, 0)) AS gone FROM same GROUP BY severity)
      SELECT severity, rank, CAST(coalesce(before, 0) AS BIGINT) AS before, CAST(coalesce(after, 0) AS BIGINT) AS after, CAST(coalesce(new, 0) AS BIGINT) AS new, CAST(coalesce(gone, 0) AS BIGINT) AS gone
      FROM (VALUES ('critica', 0), ('alta', 1), ('media', 2), ('baja', 3), ('info', 4)) s(severity, rank) LEFT JOIN counts USING (severity)""",
    "report_highlights": f"""{_WITH} SELECT 'urgent' AS kind, '' AS name, count(*) FILTER (WHERE rank < 2) AS events FROM sec
      UNION ALL SELECT 'repeated ip', * FROM ({_TOP('ip')} 1) WHERE events >= 3 UNION ALL SELECT 'repeated user', * FROM ({_TOP('account')} 1) WHERE events >= 3""",
    "events_ranked": f"{_WITH} SELECT row_number() OVER (ORDER BY rank, ts, origin) AS place, rank, label, us, origin FROM sec",
    "urgent_details": f"{_WITH} SELECT origin, severity FROM sec WHERE rank < 2 AND described",
    "report_rows_md": f"""{_WITH} SELECT origin, '| ' || concat_ws(' | ', {_TIME}, label, source, event_type, CASE ip WHEN '' THEN '' ELSE '`' || ip || '`' END, replace(account, '_', '\\_'), origin) || ' |' AS row FROM sec""",
    "report_rows_html": f"""{_WITH} SELECT origin, '<tr><td>' || concat_ws('</td><td>', {_TIME}, label, source, event_type, CASE ip WHEN '' THEN '' ELSE '<code>' || ip || '</code>' END, account, origin) || '</td></tr>' AS row FROM sec""",
}
