"""Queries on login logs: parsing, counting, bursts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import bursts, counting
from emberlog.plans.inputs import BURSTS, CSV, LAB, LAB_TEXT, LOGINS, PARSE, SYSLOG, csv_files, csv_lines, folders, lab_lines, logins, syslog_lines
from emberlog.scratch import scratch, stored
from emberlog.settings import Rule
from emberlog.sources import events as security
from emberlog.sources import logins as parsers
from emberlog.sources import sinks
from emberlog.sources.lines import read_lines as numbered_lines


def _parsed(df: DataFrame) -> DataFrame:
    return df.select("source", "line_no", "status", "reason", F.unix_micros("ts").alias("us"), F.col("user").alias("account"), "ip", "outcome", "invalid_user", "n")


def parse_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(parsers.parse_lab(lab_lines(spark, sf_dir), PARSE))


def parse_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(parsers.parse_syslog(syslog_lines(spark, sf_dir), PARSE))


def parse_csv_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(parsers.parse_csv(csv_lines(spark, sf_dir), PARSE))


def parse_csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV logins written as files, every 7th with a line feed in its user, and read back with the numbers of their lines."""
    lines = numbered_lines(spark, *csv_files(spark, sf_dir), folders=True)
    return _parsed(parsers.parse_csv(lines, PARSE)).withColumn("source", F.element_at(F.split("source", "/source="), -1))


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lab lines, written as text in several parts and read back with their numbers."""
    rows = numbered_lines(spark, *folders(spark, lab_lines(spark, sf_dir), "lines"), folders=True)
    return rows.select(F.element_at(F.split("source", "/source="), -1).alias("source"), "line_no", "text")


def _all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [lab_lines(spark, sf_dir), syslog_lines(spark, sf_dir), csv_lines(spark, sf_dir)]
    return stored(parts[0].unionByName(parts[1]).unionByName(parts[2]), f"{scratch(spark, 'lines')}/all")  # made once, read for each format


def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    # line numbers within each file: the lines of events that are no attempts are missing
    lines = _all_lines(spark, sf_dir)
    return parsers.detect_formats(lines)


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.load_events(_all_lines(spark, sf_dir), settings=PARSE)


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parsers.login_events(_loaded(spark, sf_dir))
    return events.select("source", "fmt", "line_no", F.unix_micros("ts").alias("us"), F.col("user").alias("account"), "ip", "outcome", "n")


def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.file_stats(_loaded(spark, sf_dir))


def line_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).groupBy("source", "status").agg(F.count("*").alias("lines"))


def unparsed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.unparsed_sample(parsers.unparsed_lines(parsers.parse_lab(lab_lines(spark, sf_dir), PARSE))).select("source", "line_no", "reason")


def expand_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parsers.login_events(parsers.parse_syslog(syslog_lines(spark, sf_dir), PARSE))
    return parsers.expand_repeats(events).select("source", "line_no", "repeat")


def counts_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.counts_by(logins(spark, sf_dir), "user")


def counts_by_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.counts_by(logins(spark, sf_dir), "ip")


def counts_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.counts_grouping_sets(logins(spark, sf_dir))


def login_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counting.login_totals(logins(spark, sf_dir))
    return out.select("success", "failure", "total", "invalid_user_failures", F.round("failure_rate", 6).alias("failure_rate"), F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


def _ranked(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return counting.ranked(counting.counts_by(logins(spark, sf_dir), key), 10)


def top_users_by_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, "user")


def top_ips_by_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, "ip")


def users_by_failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counting.ranked(counting.failure_rates(counting.counts_by(logins(spark, sf_dir), "user")), by="rate")
    return out.select("place", "key", "failure", "total", F.round("failure_rate", 6).alias("failure_rate"))


def failures_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.failures_by_hour(logins(spark, sf_dir), "-06:00")


def burst_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.window_counts(logins(spark, sf_dir), BURSTS)


def burst_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = bursts.burst_alerts(logins(spark, sf_dir), BURSTS)
    return alerts.select("rule", "key", "burst", "failures", "first_us", "last_us", "duration_s", "n_related", F.array_join("related", " ").alias("related"))


def burst_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.burst_evidence(bursts.member_failures(logins(spark, sf_dir), BURSTS), BURSTS)


def burst_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.burst_related(bursts.member_failures(logins(spark, sf_dir), BURSTS))


def burst_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of addresses from which at least six different accounts fail in twelve hours, however often each does."""
    spraying = replace(BURSTS, threshold=6, rules=(Rule("spraying", "ip", "user", "related"),))
    return bursts.burst_alerts(logins(spark, sf_dir), spraying).select("rule", "key", "burst", "failures", "first_us", "last_us", "n_related")


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.detect_bursts(logins(spark, sf_dir), BURSTS)


def burst_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).select("rank", "rule", "key", "first_us", "last_us", "failures", "severity", F.col("success.us").alias("success_us"), F.col("success.line_no").alias("success_line"))


def burst_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts over the events of all three formats together."""
    events = parsers.login_events(_loaded(spark, sf_dir))
    events = stored(events, f"{scratch(spark, 'events')}/parsed")  # parsed once, read three times
    return bursts.burst_alerts(events, BURSTS).select("rule", "key", "failures", "first_us", "last_us")


def detection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.detection_stats(logins(spark, sf_dir))


def out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts out of order if the table is read in another order than that of time."""
    mixed = logins(spark, sf_dir).withColumn("line_no", F.col("event_id") * 7919 % 1000003).withColumn("file_idx", F.floor(F.col("event_id") / 1000003))
    return bursts.out_of_order(mixed, chunk=50_000)


def evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.evidence_text(bursts.burst_alerts(logins(spark, sf_dir), BURSTS))


def alert_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.explanations(_detected(spark, sf_dir), BURSTS).select("rule", "key", "first_us", F.array_join("explanation", " / ").alias("explanation"))


def alerts_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts, those of a scanner's addresses marked."""
    own = spark.createDataFrame([("192.0.2.16/28",), ("192.0.2.20",), ("2001:db8::/32",)], "network string")
    return bursts.mark_excluded(_detected(spark, sf_dir), own, BURSTS).select("rank", "rule", "key", "severity", "excluded")


def alerts_as_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts written as JSON lines, read back as security events and validated as such."""
    path = scratch(spark, "alerts")
    sinks.write_rows(bursts.alerts_json(bursts.explanations(_detected(spark, sf_dir), BURSTS)), "json", path)
    events = security.valid_events(security.validated(security.load_alerts(spark, path, settings=BURSTS), exact=("description",)))
    return events.select(F.unix_micros("ts").alias("us"), "severity", "title", "source", "description", "ip", F.col("user").alias("account"))


def alerts_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.alerts_flat(_detected(spark, sf_dir))


def alerts_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.alerts_json(bursts.explanations(_detected(spark, sf_dir), BURSTS))


def login_summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = stored(parsers.parse_syslog(syslog_lines(spark, sf_dir), PARSE), f"{scratch(spark, 'summary')}/parsed")  # read five times
    return counting.summary_json(parsed.withColumn("fmt", F.lit("syslog")))


def write_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts file, written and read back."""
    path = scratch(spark, "counts")
    sinks.write_csv(counting.counts_export(logins(spark, sf_dir)), path)
    return spark.read.option("header", True).schema("dimension string, key string, success bigint, failure bigint, total bigint").csv(path)


NAMES = (
    "parse_lab parse_syslog parse_csv_logins parse_csv_records read_lines detect_format load_events file_stats line_status_counts unparsed_sample expand_repeats "
    "counts_by_user counts_by_ip counts_grouping_sets login_totals top_users_by_failure top_ips_by_failure users_by_failure_rate failures_by_hour burst_window_counts burst_alerts burst_evidence burst_related burst_distinct_users "
    "burst_success burst_multi_source detection_stats out_of_order evidence_text alert_explanations alerts_excluded alerts_as_events alerts_flat alerts_json login_summary_json write_counts"
).split()
QUERIES = {name: globals()[name] for name in NAMES}

_TALLY = "CAST(coalesce(sum(n) FILTER (WHERE outcome = 'success'), 0) AS BIGINT) AS success, CAST(coalesce(sum(n) FILTER (WHERE outcome = 'failure'), 0) AS BIGINT) AS failure, CAST(coalesce(sum(n), 0) AS BIGINT) AS total"
_HOURS12 = 12 * 3_600_000_000
_PARSED = "CASE WHEN status = 'event' THEN {0} END AS {1}"


def _parse_sql(cte: str, name: str, line: str, us: str, invalid: str, n: str) -> str:
    columns = ", ".join(_PARSED.format(*x) for x in ((us, "us"), ("account", "account"), ("ip", "ip"), ("outcome", "outcome"), (invalid, "invalid_user"), (n, "n")))
    return f"WITH {cte} SELECT file AS source, {line} AS line_no, status, reason, {columns} FROM {name}"


_SYSLOG_US = "us // 1000000 * 1000000"
_INVALID = "invalid_user AND outcome = 'failure'"
_LOADED = LOGINS + LAB.removeprefix(LOGINS) + SYSLOG.removeprefix(LOGINS) + CSV.removeprefix(LOGINS) + f""", loaded AS (
  SELECT file AS source, 'lab' AS fmt, line_no, us, account, ip, outcome, 1 AS n, status FROM lab UNION ALL
  SELECT file, 'syslog', line_no, {_SYSLOG_US}, account, ip, outcome, n, status FROM syslog UNION ALL
  SELECT file, 'csv', file_line, us, account, ip, outcome, 1, status FROM csv)"""
#: Bursts of the rows of `attempts` (us, account, ip, outcome, source, file_idx, line_no, n): members, then alerts.
_BURSTS = f""", keyed AS (
  SELECT 'user' AS rule, account AS key, ip AS related, * FROM attempts UNION ALL SELECT 'ip', ip, account, * FROM attempts),
points AS (SELECT rule, key, us, CAST(sum(n) AS BIGINT) AS n FROM keyed WHERE outcome = 'failure' GROUP BY ALL),
counted AS (SELECT *, CAST(sum(n) OVER (PARTITION BY rule, key ORDER BY us RANGE BETWEEN {_HOURS12} PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM points),
hots AS (SELECT rule, key, us, lag(us) OVER (PARTITION BY rule, key ORDER BY us) AS before FROM counted WHERE in_window >= 3),
opened AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR before < us - {_HOURS12} THEN 1 ELSE 0 END) OVER (PARTITION BY rule, key ORDER BY us) AS BIGINT) AS burst FROM hots),
members AS (
  SELECT p.rule, p.key, p.us, p.n, min(o.burst) AS burst FROM points p
  JOIN opened o ON o.rule = p.rule AND o.key = p.key AND o.us >= p.us AND o.us - {_HOURS12} <= p.us GROUP BY ALL),
alerts AS (SELECT rule, key, burst, CAST(sum(n) AS BIGINT) AS failures, min(us) AS first_us, max(us) AS last_us FROM members GROUP BY ALL),
rows AS (SELECT k.*, m.burst FROM keyed k JOIN members m ON m.rule = k.rule AND m.key = k.key AND m.us = k.us WHERE outcome = 'failure'),
related AS (SELECT rule, key, burst, count(DISTINCT related) AS n_related, string_agg(DISTINCT related, ' ' ORDER BY related) AS related FROM rows GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER w AS place, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows WINDOW w AS (PARTITION BY rule, key, burst ORDER BY us, file_idx, line_no, source)),
evidence AS (SELECT rule, key, burst, place, source, line_no, CAST(least(n, 4 - before) AS INTEGER) AS times FROM placed WHERE before < 4),
wins AS (
  SELECT a.rule, a.key, a.burst, first(k.us ORDER BY k.us, k.file_idx, k.line_no) AS success_us, first(k.line_no ORDER BY k.us, k.file_idx, k.line_no) AS success_line,
    first(k.related ORDER BY k.us, k.file_idx, k.line_no) AS success_related, first(k.source ORDER BY k.us, k.file_idx, k.line_no) AS success_source
  FROM alerts a JOIN keyed k ON k.rule = a.rule AND k.key = a.key AND k.outcome = 'success' AND k.us >= a.first_us AND k.us <= a.last_us + {_HOURS12} GROUP BY ALL),
detected AS (SELECT a.*, r.n_related, r.related, w.* EXCLUDE (rule, key, burst), CASE WHEN success_us IS NULL THEN 'media' ELSE 'alta' END AS severity,
  (last_us - first_us) // 1000000 AS duration_s FROM alerts a JOIN related r USING (rule, key, burst) LEFT JOIN wins w USING (rule, key, burst))"""
_DETECT = f"WITH {LOGINS}, attempts AS (SELECT * EXCLUDE (ts, event_id, invalid_user) FROM logins){_BURSTS}"
#: The same for a rule of its own: six different accounts of an address in a window.
_SPRAYING = (
    _DETECT.replace("SELECT 'user' AS rule, account AS key, ip AS related, * FROM attempts UNION ALL SELECT 'ip', ip, account, * FROM attempts", "SELECT 'spraying' AS rule, ip AS key, account AS related, * FROM attempts")
    .replace(f"CAST(sum(n) OVER (PARTITION BY rule, key ORDER BY us RANGE BETWEEN {_HOURS12} PRECEDING AND CURRENT ROW) AS BIGINT)",
             f"(SELECT count(DISTINCT related) FROM keyed k WHERE k.outcome = 'failure' AND k.key = points.key AND k.us BETWEEN points.us - {_HOURS12} AND points.us)").replace("in_window >= 3", "in_window >= 6")
)
_SECONDS = lambda us: f"strftime(make_timestamp(CAST({us} AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || '+00:00'"
_LOCAL = lambda us: f"strftime(make_timestamp(CAST({us} AS BIGINT)), '%Y-%m-%d %H:%M:%S') || '+00:00'"
_SPAN = lambda s: f"CASE WHEN {s} >= 3600 THEN ({s} // 3600) || ' h ' || ({s} % 3600 // 60) || ' min ' || ({s} % 60) || ' s' WHEN {s} >= 60 THEN ({s} // 60) || ' min ' || ({s} % 60) || ' s' ELSE {s} || ' s' END"

#: The sentences of an alert's explanation.
_SENTENCES = f"""failures || ' failed attempts from ' || {_LOCAL('first_us')} || ' to ' || {_LOCAL('last_us')} || ' (' || {_SPAN('duration_s')} || ').',
        'Rule: 3 or more failures in a window of 720 min.',
        CASE rule WHEN 'user' THEN 'Addresses' ELSE 'Accounts' END || ' (' || n_related || '): ' || replace(related, ' ', ', '),
        CASE WHEN success_us IS NULL THEN 'No successful login of the same ' || CASE rule WHEN 'user' THEN 'account' ELSE 'address' END || ' up to 720 min after the burst.'
          ELSE 'Successful login ' || CASE WHEN success_us <= last_us THEN 'during the burst' ELSE ({_SPAN('((success_us - last_us) // 1000000)')}) || ' after the last failure' END
            || ': ' || {_LOCAL('success_us')} || CASE rule WHEN 'user' THEN ' from ' ELSE ' as ' END || success_related || ' (' || success_source || ':' || success_line || '). Check whether it was legitimate.' END"""

#: The text of a syslog line.
_SYSLOG_TEXT = """CASE WHEN event_id % 19 = 0 THEN 'Feb 31 10:00:00' ELSE strftime(ts, '%b %-d %H:%M:%S') END || CASE WHEN event_id % 29 = 0 THEN ' host CRON[7]: ' ELSE ' host sshd[777]: ' END
        || CASE WHEN n > 1 THEN 'message repeated ' || n || ' times: [ ' ELSE '' END
        || CASE WHEN outcome = 'success' THEN 'Accepted password for ' ELSE 'Failed password for ' || CASE WHEN invalid_user THEN 'invalid user ' ELSE '' END END || account
        || CASE WHEN event_id % 23 = 0 THEN '' ELSE ' from ' || CASE WHEN event_id % 17 = 0 THEN '999.1.1.1' ELSE ip END || ' port 51877 ssh2' END || CASE WHEN n > 1 THEN ']' ELSE '' END"""

SQL = {
    "parse_lab": _parse_sql(LAB, "lab", "line_no", "us", "false", "1"),
    "parse_syslog": _parse_sql(SYSLOG, "syslog", "line_no", _SYSLOG_US, _INVALID, "n"),
    "parse_csv_logins": _parse_sql(CSV, "csv", "file_line", "us", "false", "1"),
    # a record's number is that of its last line: its place and the line feeds in users up to it
    "parse_csv_records": f"""WITH {CSV}, spread AS (
        SELECT *, event_id % 7 = 0 AND event_id % 23 != 0 AS broken, 1 + row_number() OVER w + CAST(count(*) FILTER (WHERE event_id % 7 = 0 AND event_id % 23 != 0) OVER w AS BIGINT) AS last_line
        FROM csv WINDOW w AS (PARTITION BY file ORDER BY event_id ROWS UNBOUNDED PRECEDING))
      SELECT file AS source, last_line AS line_no, status, reason, CASE WHEN status = 'event' THEN us END AS us,
        CASE WHEN status = 'event' THEN CASE WHEN broken THEN 'u' || chr(10) || substr(account, 2) ELSE account END END AS account,
        CASE WHEN status = 'event' THEN ip END AS ip, CASE WHEN status = 'event' THEN outcome END AS outcome, CASE WHEN status = 'event' THEN false END AS invalid_user, CASE WHEN status = 'event' THEN 1 END AS n
      FROM spread""",
    "read_lines": f"""WITH {LAB} SELECT file AS source, row_number() OVER (PARTITION BY file ORDER BY line_no) AS line_no,
      {LAB_TEXT} AS text FROM lab""",
    "detect_format": f"WITH {_LOADED} SELECT DISTINCT source, fmt FROM loaded",
    "load_events": f"WITH {_LOADED} SELECT source, fmt, line_no, us, account, ip, outcome, n FROM loaded WHERE status = 'event'",
    "file_stats": f"""WITH {_LOADED} SELECT source, fmt, max(line_no) AS lines, CAST(coalesce(sum(n) FILTER (WHERE status = 'event'), 0) AS BIGINT) AS events,
      count(*) FILTER (WHERE status = 'ignored') AS ignored, count(*) FILTER (WHERE status = 'unparsed') AS unparsed FROM loaded GROUP BY source, fmt""",
    "line_status_counts": f"WITH {_LOADED} SELECT source, status, count(*) AS lines FROM loaded GROUP BY source, status",
    "unparsed_sample": f"WITH {LAB} SELECT file AS source, line_no, reason FROM lab WHERE status = 'unparsed' ORDER BY file, line_no LIMIT 500",
    "expand_repeats": f"WITH {SYSLOG} SELECT file AS source, line_no, CAST(unnest(range(1, n + 1)) AS INTEGER) AS repeat FROM syslog WHERE status = 'event'",
    "counts_by_user": f"WITH {LOGINS} SELECT account AS key, {_TALLY} FROM logins GROUP BY account",
    "counts_by_ip": f"WITH {LOGINS} SELECT ip AS key, {_TALLY} FROM logins GROUP BY ip",
    "counts_grouping_sets": f"""WITH {LOGINS} SELECT CASE grouping(account, ip) WHEN 1 THEN 'user' WHEN 2 THEN 'ip' ELSE 'total' END AS dimension, coalesce(account, ip) AS key, {_TALLY}
      FROM logins GROUP BY GROUPING SETS ((account), (ip), ())""",
    "login_totals": f"""WITH {LOGINS} SELECT {_TALLY}, CAST(sum(n) FILTER (WHERE invalid_user AND outcome = 'failure') AS BIGINT) AS invalid_user_failures,
      round(100.0 * sum(n) FILTER (WHERE outcome = 'failure') / sum(n), 6) AS failure_rate, min(us) AS first_us, max(us) AS last_us FROM logins""",
    "top_users_by_failure": f"WITH {LOGINS} SELECT row_number() OVER (ORDER BY failure DESC, total DESC, key) AS place, * FROM (SELECT account AS key, {_TALLY} FROM logins GROUP BY account) ORDER BY place LIMIT 10",
    "top_ips_by_failure": f"WITH {LOGINS} SELECT row_number() OVER (ORDER BY failure DESC, total DESC, key) AS place, * FROM (SELECT ip AS key, {_TALLY} FROM logins GROUP BY ip) ORDER BY place LIMIT 10",
    "users_by_failure_rate": f"""WITH {LOGINS}, rates AS (SELECT *, 100.0 * failure / total AS rate FROM (SELECT account AS key, {_TALLY} FROM logins GROUP BY account))
      SELECT row_number() OVER (ORDER BY rate DESC, total DESC, key) AS place, key, failure, total, round(rate, 6) AS failure_rate FROM rates""",
    "failures_by_hour": f"""WITH {LOGINS}, counts AS (SELECT CAST(hour(ts - INTERVAL 6 HOUR) AS INTEGER) AS hour, {_TALLY} FROM logins GROUP BY 1)
      SELECT CAST(h AS INTEGER) AS hour, coalesce(failure, 0) AS failures, coalesce(total, 0) AS total FROM range(24) r(h) LEFT JOIN counts ON hour = h""",
    "burst_window_counts": f"{_DETECT} SELECT * FROM counted",
    "burst_alerts": f"{_DETECT} SELECT rule, key, burst, failures, first_us, last_us, duration_s, n_related, related FROM detected",
    "burst_evidence": f"{_DETECT} SELECT * FROM evidence",
    "burst_related": f"{_DETECT} SELECT rule, key, burst, row_number() OVER (PARTITION BY rule, key, burst ORDER BY related) AS place, related FROM (SELECT DISTINCT rule, key, burst, related FROM rows)",
    "burst_distinct_users": f"{_SPRAYING} SELECT rule, key, burst, failures, first_us, last_us, n_related FROM alerts JOIN related USING (rule, key, burst)",
    "burst_success": f"{_DETECT} SELECT row_number() OVER (ORDER BY first_us, rule, key) AS rank, rule, key, first_us, last_us, failures, severity, success_us, success_line FROM detected",
    "burst_multi_source": f"""WITH {_LOADED}, attempts AS (SELECT us, account, ip, outcome, source, 0 AS file_idx, line_no, n FROM loaded WHERE status = 'event'){_BURSTS}
      SELECT rule, key, failures, first_us, last_us FROM alerts""",
    "detection_stats": f"""WITH {LOGINS}, seen AS (SELECT *, max(us) OVER (ORDER BY file_idx, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM logins)
      SELECT CAST(sum(n) AS BIGINT) AS events, CAST(sum(n) FILTER (WHERE outcome = 'failure') AS BIGINT) AS failures, CAST(sum(n) FILTER (WHERE outcome = 'success') AS BIGINT) AS successes,
        CAST(coalesce(sum(n) FILTER (WHERE us < top), 0) AS BIGINT) AS out_of_order FROM seen""",
    "out_of_order": f"""WITH {LOGINS}, seen AS (SELECT *, max(us) OVER (ORDER BY event_id // 1000003, event_id * 7919 % 1000003 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM logins)
      SELECT CAST(coalesce(sum(n) FILTER (WHERE us < top), 0) AS BIGINT) AS n FROM seen""",
    "evidence_text": f"""{_DETECT}, labels AS (
        SELECT rule, key, burst, source, min(place) AS place, line_no || CASE WHEN sum(times) > 1 THEN ' (x' || CAST(sum(times) AS BIGINT) || ')' ELSE '' END AS label FROM evidence GROUP BY rule, key, burst, source, line_no),
      parts AS (SELECT rule, key, burst, min(place) AS place, source || ': ' || string_agg(label, ', ' ORDER BY place) AS part FROM labels GROUP BY rule, key, burst, source)
      SELECT rule, key, burst, string_agg(part, '; ' ORDER BY place) AS text FROM parts GROUP BY rule, key, burst""",
    "alert_explanations": f"""{_DETECT} SELECT rule, key, first_us, concat_ws(' / ', {_SENTENCES}) AS explanation FROM detected""",
    "alerts_excluded": f"""{_DETECT}, own AS (SELECT *, CASE rule WHEN 'ip' THEN CAST(split_part(key, '.', 4) AS INTEGER) END AS host FROM detected)
      SELECT row_number() OVER (ORDER BY first_us, rule, key) AS rank, rule, key, severity, CASE WHEN host = 20 THEN '192.0.2.20' WHEN host BETWEEN 16 AND 31 THEN '192.0.2.16/28' END AS excluded FROM own""",
    "alerts_as_events": f"""{_DETECT} SELECT first_us // 1000000 * 1000000 AS us, severity, 'Failed logins in a burst, rule ' || rule || ': ' || failures AS title, 'logins' AS source,
        left(concat_ws(' ', {_SENTENCES}), 2000) AS description, CASE rule WHEN 'ip' THEN key ELSE '' END AS ip, CASE rule WHEN 'user' THEN key ELSE '' END AS account FROM detected""",
    "alerts_flat": f"""{_DETECT}, places AS (SELECT rule, key, burst, string_agg(repeat(source || ':' || line_no || ' ', times), '' ORDER BY place) AS evidence FROM evidence GROUP BY rule, key, burst)
      SELECT rule, key, severity, {_SECONDS('first_us')} AS first_seen, {_SECONDS('last_us')} AS last_seen, duration_s, failures, n_related, related, trim(evidence) AS evidence, {_SECONDS('success_us')} AS success_at, success_source || ':' || success_line AS success_location
      FROM detected JOIN places USING (rule, key, burst)""",
    "alerts_json": f"""{_DETECT}, shown AS (
        SELECT rule, key, burst, string_agg('{{"source":"' || source || '","line_no":' || line_no || ',"times":' || times || '}}', ',' ORDER BY place) AS evidence FROM evidence GROUP BY rule, key, burst)
      SELECT rule, key, first_us, '{{"rule":"' || rule || '","key":"' || key || '","severity":"' || severity || '","first_seen":"' || {_SECONDS('first_us')} || '","last_seen":"' || {_SECONDS('last_us')}
        || '","duration_s":' || duration_s || ',"failures":' || failures || ',"related":["' || replace(related, ' ', '","') || '"],"evidence":[' || evidence || ']'
        || ',"success_after":' || CASE WHEN success_us IS NULL THEN 'null' ELSE '{{"timestamp":"' || {_SECONDS('success_us')} || '","user":"' || CASE rule WHEN 'user' THEN key ELSE success_related END
          || '","ip":"' || CASE rule WHEN 'user' THEN success_related ELSE key END || '","location":"' || success_source || ':' || success_line || '"}}' END || ',"explanation":["' || array_to_string([{_SENTENCES}], '","') || '"]}}' AS json
      FROM detected JOIN shown USING (rule, key, burst)""",
    "write_counts": f"WITH {LOGINS} SELECT 'user' AS dimension, account AS key, {_TALLY} FROM logins GROUP BY account UNION ALL SELECT 'ip', ip, {_TALLY} FROM logins GROUP BY ip",
    "login_summary_json": f"""WITH {SYSLOG}, done AS (SELECT * FROM syslog WHERE status = 'event'),
      counts AS (SELECT 'user' AS section, account AS name, {_TALLY} FROM done GROUP BY account UNION ALL SELECT 'ip', ip, {_TALLY} FROM done GROUP BY ip),
      bad AS (SELECT * FROM syslog WHERE status = 'unparsed' ORDER BY file, line_no LIMIT 500)
      SELECT section, name, '{{"' || section || '":"' || name || '","success":' || success || ',"failure":' || failure || ',"total":' || total || '}}' AS json FROM counts
      UNION ALL SELECT 'totals', '', '{{"success":' || success || ',"failure":' || failure || ',"total":' || total || ',"invalid_user_failures":' || invalid || ',"first_seen":"' || {_SECONDS('first_us')} || '","last_seen":"' || {_SECONDS('last_us')}
        || '","unparsed":' || (SELECT count(*) FROM syslog WHERE status = 'unparsed') || '}}'
        FROM (SELECT {_TALLY}, CAST(coalesce(sum(n) FILTER (WHERE {_INVALID}), 0) AS BIGINT) AS invalid, min({_SYSLOG_US}) AS first_us, max({_SYSLOG_US}) AS last_us FROM done)
      UNION ALL SELECT 'file', file, '{{"source":"' || file || '","format":"syslog","lines":' || max(line_no) || ',"events":' || CAST(coalesce(sum(n) FILTER (WHERE status = 'event'), 0) AS BIGINT)
        || ',"ignored":' || count(*) FILTER (WHERE status = 'ignored') || ',"unparsed":' || count(*) FILTER (WHERE status = 'unparsed') || '}}' FROM syslog GROUP BY file
      UNION ALL SELECT 'unparsed', file || ':' || line_no, '{{"source":"' || file || '","line":' || line_no || ',"reason":"' || reason || '","text":"' || {_SYSLOG_TEXT} || '"}}' FROM bad""",
}
