"""Parsers and bursts on hand-made rows, and bursts against a plain sliding window."""

from __future__ import annotations

import random
from collections import deque
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from emberlog.functions import time as times
from emberlog.operators import bursts, counting
from emberlog.plans.inputs import BURSTS
from emberlog.settings import BurstSettings, ParseSettings
from emberlog.sources import logins

START = datetime(2025, 3, 2, 21, 30, tzinfo=timezone.utc)


def _lines(spark, *texts):
    return spark.createDataFrame([("a.log", 0, k + 1, t) for k, t in enumerate(texts)], "source string, file_idx int, line_no bigint, text string")


def _events(spark, rows):
    """rows: (minute, user, ip, outcome)."""
    data = [(START + timedelta(minutes=m), u, i, o, "a.log", k + 1, 0, False, 1) for k, (m, u, i, o) in enumerate(rows)]
    return spark.createDataFrame(data, "ts timestamp, user string, ip string, outcome string, source string, line_no bigint, file_idx int, invalid_user boolean, n int")


def test_lab_reasons(spark):
    cases = [
        ("2025-03-02T23:45:00+02:15 LOGIN_SUCCESS user=mira ip=198.51.100.77 via=key", "event", None), ("   ", "ignored", None), ("#", "ignored", None),
        ("2025-03-02T23:45:00Z LOGIN_RESET user=mira ip=198.51.100.77", "unparsed", "unknown event"), ("mira logged in", "unparsed", "not a lab line"), ("2025-03-02T23:45:00Z", "unparsed", "not a lab line"),
        ("2025-03-02T23:45:00Z LOGIN_FAILURE ip=198.51.100.77", "unparsed", "missing user="), ("2025-03-02T23:45:00Z LOGIN_FAILURE user= ip=", "unparsed", "missing user=, ip="),
        ("2025-02-29T23:45:00Z LOGIN_FAILURE user=mira ip=198.51.100.77", "unparsed", "nonexistent date"), ("02/03/2025 LOGIN_FAILURE user=mira ip=198.51.100.77", "unparsed", "unrecognised timestamp"),
        ("2025-03-02T23:45:00Z LOGIN_FAILURE user=mira ip=198.51.100", "unparsed", "invalid address"), ("2025-03-02T23:45:00 LOGIN_FAILURE User=x ip=::1 USER=teo=2 IP=[2001:DB8:0::77]", "event", None),
        ("2025-03-02T23:45:00Z LOGIN_FAILURE user=mira ip=::1 =odd", "unparsed", "field without key=value"), ("2025-03-02T23:45:00Z LOGIN_FAILURE", "unparsed", "missing user=, ip="),
    ]
    parsed = logins.parse_lab(_lines(spark, *(t for t, _, _ in cases))).orderBy("line_no").collect()
    assert [(r["status"], r["reason"]) for r in parsed] == [x[1:] for x in cases]
    assert parsed[0]["ts"] == datetime(2025, 3, 2, 21, 30) and parsed[0]["outcome"] == "success" and (parsed[11]["user"], parsed[11]["ip"]) == ("teo=2", "2001:db8::77")


def test_syslog(spark):
    tail = "from 198.51.100.77 port 2222 ssh2"
    cases = [
        (f"Mar  2 21:30:00 gate sshd[5]: Failed publickey for invalid user guest {tail}", "event", None), ("Mar 2 21:30:00 gate cron[9]: done", "ignored", None), ("Mar 2 21:30:00 gate sshd without a colon", "ignored", None),
        (f"Mar 2 21:30:00 gate sshd[5]: message repeated 7 times: [ Failed password for mira {tail} ]", "event", None), ("Feb 29 21:30:00 gate cron[9]: x", "unparsed", "nonexistent date"), ("Mrz 2 21:30:00 gate cron: x", "unparsed", "unknown month"), ("gate is up", "unparsed", "no syslog header"),
        ("2025-03-02T21:30:00.25+00:30 gate sshd-session: Accepted password for teo from 2001:db8::77 port 9 ssh2", "event", None), ("2025-03-02T25:30:00Z gate cron: x", "unparsed", "nonexistent date"), ("Mar 2 21:30:00 gate sshd[5]: Failed password for mira", "unparsed", "incomplete login message"),
        ("Mar 2 21:30:00 gate sshd[5]: Failed none for  from 192.0.2.77 port 4", "event", None), ("Mar 2 21:30:00 gate sshd[5]: Accepted none for  from 192.0.2.77 port 4", "unparsed", "incomplete login message"), ("Mar 2 21:30:00 gate sshd[5]: message repeated 0 times: [ x]", "unparsed", "repeat count out of range"),
        ("Mar 2 21:30:00 gate sshd[5]: Failed password for mira from gate.example port 4", "unparsed", "invalid address"), ("Mar 2 21:30:00 gate sshd[5]: Connection closed", "ignored", None), ("", "ignored", None),
    ]
    parsed = logins.parse_syslog(_lines(spark, *(t for t, _, _ in cases)), ParseSettings(year=2025, zone="Europe/Madrid")).orderBy("line_no").collect()
    assert [(r["status"], r["reason"]) for r in parsed] == [x[1:] for x in cases]
    assert parsed[0]["invalid_user"] and parsed[0]["ts"] == datetime(2025, 3, 2, 20, 30) and parsed[3]["n"] == 7 and parsed[10]["user"] == "(vacío)"
    assert parsed[7]["ts"] == datetime(2025, 3, 2, 21, 0, 0, 250_000) and not parsed[3]["invalid_user"]


def test_csv(spark):
    rows = _lines(spark, "RESULT,note, Ip ,User,timestamp", "Failure,x,198.51.100.77,mira,2025-03-02 21:30:00Z", "success,x,198.51.100.77,,", "odd,,198.51.100.77,mira,2025-03-02 21:30:00Z", "")
    parsed = logins.parse_csv(rows).orderBy("line_no").collect()
    assert [(r["line_no"], r["reason"]) for r in parsed] == [(2, None), (3, "empty columns: timestamp, user"), (4, "unknown result")]
    with pytest.raises(ValueError):
        logins.parse_csv(_lines(spark, "user,ip", "x,y"))


@pytest.mark.parametrize(("minutes", "expected"), [
    ([7, 8], []), ([1, 3, 6], [3]), ([1, 3, 6.1], []), ([0, 2, 4, 6, 8, 10, 12, 14], [8]), ([10, 11, 12, 90, 91, 92, 93], [3, 4]), ([0, 9, 11, 12, 13], [4]), ([5, 5, 5], [3]),
])
def test_bursts_by_hand(spark, minutes, expected):
    rows = _events(spark, [(m, "mira", f"198.51.100.{k}", "failure") for k, m in enumerate(minutes)])
    found = bursts.burst_alerts(rows, BurstSettings(rules=("user",), threshold=3)).orderBy("first_us").collect()
    assert [r["failures"] for r in found] == expected and all(r["n_related"] == r["failures"] for r in found)


def test_success_after(spark):
    base = [(m, "mira", "198.51.100.7", "failure") for m in (0, 1, 2)]
    for minute, severity in ((0, "alta"), (1.5, "alta"), (17, "alta"), (-0.5, "media"), (17.1, "media")):
        events = _events(spark, [*base, (minute, "mira", "198.51.100.8", "success")])
        assert [r["severity"] for r in bursts.detect_bursts(events, BurstSettings(rules=("user",), threshold=3)).collect()] == [severity]


def test_evidence_counts_repeats(spark):
    rows = _events(spark, [(k, "mira", "198.51.100.7", "failure") for k in range(4)]).withColumn("n", F.lit(4))
    found = bursts.burst_alerts(rows, BurstSettings(rules=("ip",))).first()
    assert found["failures"] == 16 and [(e["line_no"], e["times"]) for e in found["evidence"]] == [(1, 4), (2, 4), (3, 2)]  # ten by default


def test_bursts_against_a_sliding_window(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(0, 400), rng.choice("abc"), f"192.0.2.{rng.randrange(3)}", "failure") for _ in range(300)]
    found = {(r["key"], r["failures"], r["first_us"], r["last_us"]) for r in bursts.burst_alerts(_events(spark, rows), BurstSettings(rules=("user",), threshold=4)).collect()}
    expected = set()
    for user in "abc":
        window, alerts = deque(), []
        for position, t in enumerate(sorted(m for m, u, _, _ in rows if u == user)):
            window.append((position, t))
            while window[0][1] < t - 5:
                window.popleft()
            if len(window) >= 4:
                if alerts and alerts[-1][-1][1] >= t - 5:  # all of the window that the alert hasn't yet
                    alerts[-1] += [x for x in window if x > alerts[-1][-1]]
                else:
                    alerts.append(list(window))
        us = lambda m: round((START + timedelta(minutes=m)).timestamp() * 1e6)
        expected |= {(user, len(a), us(a[0][1]), us(a[-1][1])) for a in alerts}
    assert found == expected and len(found) > 5


@pytest.mark.parametrize("span", [2, 3, 32])
def test_bursts_and_successes_over_spans(spark, monkeypatch, span):
    """Bursts go over the edges of spans, some with successes far behind; spans of every length find the same."""
    monkeypatch.setattr(bursts, "SPAN", span)
    rng, settings = random.Random(9), BurstSettings(rules=("user",), threshold=3, success_after=timedelta(minutes=40))
    rows = [(rng.randrange(-900, 900) / 2, rng.choice("abc"), "192.0.2.1", "failure") for _ in range(700)] + [(rng.randrange(-400, 480), rng.choice("abc"), "192.0.2.2", "success") for _ in range(25)]
    events, us = _events(spark, rows), lambda m: round((START + timedelta(minutes=m)).timestamp() * 1e6)
    counts = {(r["key"], r["us"]): r["in_window"] for r in bursts.window_counts(events, settings).collect()}
    at = lambda user: sorted(us(m) for m, u, _, o in rows if u == user and o == "failure")
    width = us(5) - us(0)
    assert counts == {(u, t): sum(t - width <= x <= t for x in at(u)) for u in "abc" for t in at(u)}
    expected = set()
    for user in "abc":
        hots = sorted({t for t in at(user) if counts[user, t] >= 3})
        groups = [[t] for t in hots[:1]]
        for before, t in zip(hots[:-1], hots[1:], strict=True):
            groups += [[t]] if before < t - width else []
            groups[-1] += [] if before < t - width else [t]
        for number, group in enumerate(groups, 1):
            own = [x for x in at(user) if next((h for h in hots if h >= x), x + 2 * width) in group and any(h - width <= x <= h for h in group)]
            wins = sorted(us(m) for m, u, _, o in rows if u == user and o == "success" and own[0] <= us(m) <= own[-1] + 8 * width)
            expected.add((user, number, len(own), own[0], own[-1], wins[0] if wins else None))
    found = {(r["key"], r["burst"], r["failures"], r["first_us"], r["last_us"], r["success"] and r["success"]["us"]) for r in bursts.detect_bursts(events, settings).collect()}
    assert found == expected and len(found) > 20


def test_all_related_values_are_listed(spark):
    users = [f"u{k:04}" for k in range(1_203)]  # one address sprays them all
    found = bursts.burst_alerts(_events(spark, [(0, u, "192.0.2.1", "failure") for u in users]), replace(BURSTS, rules=("ip",))).collect()
    assert [(r["n_related"], r["related"]) for r in found] == [(len(users), users)]


def test_ranking_and_settings(spark):
    attempts = {"kim": (4, 3), "lou": (0, 3), "max": (0, 3), "ned": (9, 1)}  # successes, failures
    rows = [(0, user, "x", outcome) for user, counts in attempts.items() for outcome, n in zip(("success", "failure"), counts, strict=True) for _ in range(n)]
    assert [r["key"] for r in counting.ranked(counting.counts_by(_events(spark, rows), "user")).collect()] == ["kim", "lou", "max", "ned"]
    for bad in ({"threshold": 1}, {"rules": ()}, {"rules": ("host",)}, {"window": timedelta(0)}, {"success_after": timedelta(-1)}, {"max_evidence": 0}):
        with pytest.raises(ValueError):
            BurstSettings(**bad)


def test_zones_and_bounds():
    assert [times.zone_of(z).utcoffset(START) for z in ("z", "+0345", " -11:30 ", "Asia/Tokyo")] == [timedelta(0), timedelta(hours=3, minutes=45), -timedelta(hours=11, minutes=30), timedelta(hours=9)]
    for bad in ("Tokyo", "+24:00", "-03:60", "3", ""):
        with pytest.raises(ValueError):
            times.zone_of(bad)
    utc = lambda *x: datetime(*x, tzinfo=timezone.utc)
    assert times.date_bound("2025-03-02", "Asia/Tokyo") == utc(2025, 3, 1, 15) and times.date_bound("2025-03-02", "Asia/Tokyo", end=True) == utc(2025, 3, 2, 14, 59, 59, 999_999)
    assert times.date_bound("2025-03-02t10:00:00.5z", "Asia/Tokyo", end=True) == utc(2025, 3, 2, 10, 0, 0, 500_000) and times.date_bound("2025-03-02 10:00:00", "+01:00") == utc(2025, 3, 2, 9)
    for bad in ("2025-3-2", "20250302", "2025-02-30", "soon", "2025-03-02T10:00"):
        with pytest.raises(ValueError):
            times.date_bound(bad)


def test_summer_time(spark):
    zone, rows = "America/New_York", [("2024-11-03T01:30:00",), ("2024-03-10T02:30:00",), ("2024-07-01T00:00:00",)]  # repeated, left out, plain
    local = spark.createDataFrame(rows, "x string")
    got = local.select(times.iso_timestamp(F.col("x"), zone).alias("a"), times.to_utc(F.to_timestamp("x"), zone).alias("b"), times.format_timestamp(times.iso_timestamp(F.col("x"), zone), zone).alias("c")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == [datetime(2024, 11, 3, 5, 30), datetime(2024, 3, 10, 7, 30), datetime(2024, 7, 1, 4)]
    assert [r["c"] for r in got] == ["2024-11-03 01:30:00-04:00", "2024-03-10 03:30:00-04:00", "2024-07-01 00:00:00-04:00"]


@pytest.mark.parametrize("most", [0, 100])
def test_csv_headers_of_several_files(spark, monkeypatch, most):
    """Two kinds of headers in three files; headers by broadcast and by a shuffle."""
    monkeypatch.setattr(logins, "MOST_BROADCAST", most)
    texts = {"p.csv": ["timestamp,user,ip,result", "2025-03-02T21:30:00Z,mira,192.0.2.77,failure"], "q.csv": ["Result, IP,User,Timestamp", "", "SUCCESS,192.0.2.78,teo,2025-03-02T21:31:00Z"], "r.csv": ["timestamp,user,ip,result"]}
    lines = spark.createDataFrame([(s, k, t) for s, own in texts.items() for k, t in enumerate(own, 1)], "source string, line_no bigint, text string")
    rows = logins.parse_csv(lines).orderBy("source").collect()
    assert [(r["source"], r["line_no"], r["user"], r["ip"], r["outcome"]) for r in rows] == [("p.csv", 2, "mira", "192.0.2.77", "failure"), ("q.csv", 3, "teo", "192.0.2.78", "success")]
    with pytest.raises(ValueError, match="columns missing"):
        logins.parse_csv(lines.union(spark.createDataFrame([("s.csv", 1, "timestamp,user")], lines.schema)))
    with pytest.raises(ValueError, match="no header"):
        logins.parse_csv(lines.where("false"))


def test_summary_of_nothing_and_of_unparsed_lines(spark):
    parsed = lambda *t: logins.parse_lab(_lines(spark, *t)).withColumn("fmt", F.lit("lab"))
    records = lambda df: [(r["section"], r["name"], r["json"]) for r in counting.summary_json(df).orderBy("section", "name").collect()]
    empty = '{"success":0,"failure":0,"total":0,"invalid_user_failures":0,"first_seen":null,"last_seen":null,"unparsed":%d}'
    assert records(parsed("x").where("false")) == [("totals", "", empty % 0)]
    assert records(parsed('say "no"')) == [
        ("file", "a.log", '{"source":"a.log","format":"lab","lines":1,"events":0,"ignored":0,"unparsed":1}'), ("totals", "", empty % 1),
        ("unparsed", "a.log:1", '{"source":"a.log","line":1,"reason":"not a lab line","text":"say \\"no\\""}'),
    ]


def test_parsers_of_ones_own(spark):
    """A format that isn't among the library's own, beside one that is."""
    lines = spark.createDataFrame([("a.log", 1, "2025-03-02T21:30:00Z LOGIN_FAILURE user=mira ip=192.0.2.7"), ("b.txt", 1, "teo@192.0.2.8"), ("b.txt", 2, "odd")], "source string, line_no bigint, text string")
    formats = spark.createDataFrame([("a.log", "lab"), ("b.txt", "at")], "source string, fmt string")

    def parse_at(rows, settings):
        part, good = F.split("text", "@"), F.contains("text", F.lit("@"))
        event = {"ts": F.lit(START).cast("timestamp"), "user": F.get(part, F.lit(0)), "ip": F.get(part, F.lit(1)), "outcome": F.lit("failure"), "invalid_user": F.lit(False), "n": F.lit(1)}
        return rows.select("*", F.when(good, "event").otherwise("unparsed").alias("status"), F.when(~good, "no at sign").alias("reason"), *[F.when(good, c).alias(k) for k, c in event.items()])

    got = logins.load_events(lines, formats, more={"at": parse_at}).orderBy("source", "line_no").collect()
    assert [(r["fmt"], r["status"], r["user"], r["ip"], r["reason"]) for r in got] == [("lab", "event", "mira", "192.0.2.7", None), ("at", "event", "teo", "192.0.2.8", None), ("at", "unparsed", None, None, "no at sign")]
    with pytest.raises(ValueError, match="no parser"):
        logins.load_events(lines, formats)
