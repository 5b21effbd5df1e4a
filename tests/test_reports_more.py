"""Counts by hour and by choice, marked alerts, alerts as events, and reports side by side."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import duckdb
import pytest

from emberlog.operators import bursts, counting, report
from emberlog.plans import registry
from emberlog.settings import BurstSettings, Rule
from emberlog.sources import events as sources
from emberlog.sources import sinks

START = datetime(2026, 3, 1, 3, 30, tzinfo=timezone.utc)
EVENT = "ts timestamp, severity string, title string, source string, description string, ip string, user string"


def _attempts(spark, rows):
    """rows: (minute, user, ip, outcome)."""
    columns = "ts timestamp, user string, ip string, outcome string, source string, line_no bigint, file_idx int, invalid_user boolean, n int"
    return spark.createDataFrame([(START + timedelta(minutes=m), u, i, o, "a.log", k + 1, 0, False, 1) for k, (m, u, i, o) in enumerate(rows)], columns)


def test_hours_of_a_zone(spark):
    attempts = _attempts(spark, [(0, "a", "192.0.2.1", "failure"), (29, "a", "192.0.2.1", "success"), (30, "b", "192.0.2.1", "failure"), (31, "b", "192.0.2.1", "failure")])
    of = lambda zone: {r["hour"]: (r["failures"], r["total"]) for r in counting.failures_by_hour(attempts, zone).collect()}
    none = dict.fromkeys(range(24), (0, 0))
    assert of("UTC") == none | {3: (1, 2), 4: (2, 2)} and of("-06:00") == none | {21: (1, 2), 22: (2, 2)}
    assert of("Asia/Kolkata") == none | {9: (3, 4)}  # half an hour beside the others
    assert {r["failures"] for r in counting.failures_by_hour(attempts.limit(0)).collect()} == {0}
    with pytest.raises(ValueError):
        counting.failures_by_hour(attempts, "Nowhere")


def test_rankings_by_choice(spark):
    counts = spark.createDataFrame([("a", 4, 1, 5), ("b", 0, 1, 1), ("c", 5, 6, 11), ("d", 0, 0, 0), ("e", 5, 5, 10)], "key string, success bigint, failure bigint, total bigint")
    rates = counting.failure_rates(counts)
    order = lambda by, top=0: "".join(r["key"] for r in counting.ranked(rates, top, by).orderBy("place").collect())
    assert [order(by) for by in ("failure", "total", "success", "rate", "key")] == ["ceabd", "ceabd", "ceabd", "bcead", "abcde"]
    assert order("rate", 2) == "bc" and {r["key"]: r["failure_rate"] for r in rates.collect()}["d"] is None
    with pytest.raises(ValueError):
        counting.ranked(counts, by="name")


def test_marked_alerts_stay(spark):
    rows = [(k, user, ip, "failure") for k in range(3) for user, ip in (("u", "192.0.2.20"), ("192.0.2.20", "198.51.100.9"), ("v", "2001:db8::5"), ("w", "203.0.113.1"))]
    settings = BurstSettings(threshold=3, rules=("user", Rule("source", "ip", "user", "failures")))
    alerts = bursts.detect_bursts(_attempts(spark, rows), settings)
    own = spark.createDataFrame([("192.0.2.0/24",), ("192.0.2.16/28",), ("2001:db8::/32",)], "network string")
    marked = bursts.mark_excluded(alerts, own, settings)
    assert marked.columns == [*alerts.columns, "excluded"]
    got = {(r["rule"], r["key"]): r["excluded"] for r in marked.collect()}
    assert len(got) == 8 and {k: v for k, v in got.items() if v} == {("source", "192.0.2.20"): "192.0.2.16/28", ("source", "2001:db8::5"): "2001:db8::/32"}
    none = bursts.mark_excluded(alerts, own.limit(0), settings).collect()
    assert len(none) == 8 and not any(r["excluded"] for r in none)


def test_alerts_become_events(spark, tmp_path):
    rows = [(k, "u\u202e|x", "2001:db8::7", "failure") for k in range(4)] + [(5, "u\u202e|x", "2001:db8::7", "success")]
    settings = BurstSettings(threshold=4)
    alerts = bursts.explanations(bursts.detect_bursts(_attempts(spark, rows), settings), settings)
    sinks.write_rows(bursts.alerts_json(alerts), "json", f"{tmp_path}/alerts")
    (tmp_path / "bad.jsonl").write_text('{"rule": "ip", "key": "192.0.2.1"}\nno json\n[1]\n')
    checked = sources.validated(sources.load_alerts(spark, f"{tmp_path}/alerts", f"{tmp_path}/bad.jsonl", settings=settings))
    valid = {(r["ip"], r["user"]): r for r in sources.valid_events(checked).collect()}
    assert set(valid) == {("2001:db8::7", ""), ("", "u\u202e|x")}
    event = valid["2001:db8::7", ""]
    assert (event["severity"], event["source"], event["title"]) == ("alta", "logins", "Failed logins in a burst, rule ip: 4") and "Successful login" in event["description"]
    assert [r["reason"] for r in sources.rejected(checked).orderBy("origin").collect()] == ["not an alert", "invalid JSON", "not an alert"]


def test_alerts_with_long_explanations_are_no_rejects(spark, tmp_path):
    rows = [(k / 100, f"account-number-{k:04}", "192.0.2.1", "failure") for k in range(200)]
    settings = BurstSettings(threshold=200, rules=("ip",))
    alerts = bursts.explanations(bursts.detect_bursts(_attempts(spark, rows), settings), settings)
    sinks.write_rows(bursts.alerts_json(alerts), "json", f"{tmp_path}/alerts")
    (event,) = sources.validated(sources.load_alerts(spark, f"{tmp_path}/alerts", settings=settings)).collect()
    assert event["reason"] is None and len(event["description"]) > 1_990


def test_reports_side_by_side(spark):
    row = lambda m, severity, title="t", user="": (START + timedelta(minutes=m), severity, title, "s", "", "", user)
    before = spark.createDataFrame([("o1", *row(0, "alta")), ("o2", *row(0, "alta")), ("o3", *row(1, "media")), ("o4", *row(2, "baja", "x"))], f"origin string, {EVENT}")
    after = spark.createDataFrame([("p1", *row(0, "alta")), ("p2", *row(0, "alta")), ("p3", *row(0, "alta")), ("p4", *row(1, "media", user="u")), ("p5", *row(2, "baja", "x"))], f"origin string, {EVENT}")
    got = {r["severity"]: (r["rank"], r["before"], r["after"], r["new"], r["gone"]) for r in report.compare_reports(before, after).collect()}
    assert got == {"critica": (0, 0, 0, 0, 0), "alta": (1, 2, 3, 1, 0), "media": (2, 1, 1, 1, 1), "baja": (3, 1, 1, 0, 0), "info": (4, 0, 0, 0, 0)}
    assert all(r["new"] == r["gone"] == 0 for r in report.compare_reports(after, after).collect())
    assert sum(r["gone"] for r in report.compare_reports(before, after.limit(0)).collect()) == 4


def test_descriptions_cut_at_a_blank_equal_sql(spark, tmp_path):
    """Nine addresses with 300 accounts each, whose descriptions are cut at nine places of an account and its comma."""
    con = duckdb.connect()
    con.sql(f"""copy (SELECT k * 300 + i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS ts, CASE i WHEN 0 THEN CAST(10 ** k AS BIGINT) ELSE 200000 + i END AS user_id,
      'view' AS event_type, 1.0 AS value, '{{"k": ' || k || '}}' AS props FROM range(9) a(k), range(300) b(i)) to '{tmp_path}/events.parquet'""")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    columns = ["us", "severity", "title", "source", "description", "ip", "account"]
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()['alerts_as_events']})").fetchall()
    ends = {d[-1] for *_, d, _, _ in expected if len(d) == 2000}
    assert {" ", ","} < ends
    assert sorted(map(tuple, registry.queries()["alerts_as_events"](spark, str(tmp_path)).select(*columns).collect())) == sorted(expected)
