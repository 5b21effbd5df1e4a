"""Search helpers, and the registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from emberlog.operators import search
from emberlog.plans import registry

TABLES = "/root/testdata/sf0.001"


def _plain(rows, columns):
    return sorted(tuple(str(float(v)) if isinstance(v, float) else str(v) for v in (r[c] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", ["parse_lab", "counts_grouping_sets", "burst_alerts", "burst_success", "detection_stats", "search_any", "search_cidr", "search_combined", "search_context", "search_stats", "rejected_events", "report_rows_md", "fn_parse_iso", "fn_find_ips", "fn_normalize_ip", "fn_md_escape", "fn_kv_map", "load_json_events", "load_jsonl_events", "load_csv_events", "write_counts", "login_summary_json", "search_json", "search_dates", "parse_csv_records", "load_long_json_events", "search_networks", "search_folded", "burst_related", "burst_distinct_users", "events_ranked", "top_users_by_failure", "users_by_failure_rate", "failures_by_hour", "alerts_excluded", "alerts_as_events", "report_changes"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = registry.queries()[name](spark, TABLES)
    other = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(other.columns)
    columns = sorted(df.columns)
    expected = [dict(zip(other.columns, r, strict=True)) for r in other.fetchall()]
    assert _plain(df.collect(), columns) == _plain(expected, columns)


def test_repeats_count_in_bursts_of_several_sources(spark):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{TABLES}/events.parquet'")
    sql = registry.oracle_sql()["burst_multi_source"]
    df = registry.queries()["burst_multi_source"](spark, TABLES)
    expected = con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(expected) and expected


def test_query_checks():
    for bad in ({}, {"keywords": [" "]}, {"ips": ["999.1.1.1"]}, {"cidrs": ["x"]}, {"start": "2024-02-01", "end": "2024-01-01"}, {"start": "yesterday"}):
        with pytest.raises(ValueError):
            search.query(**bad)


def test_addresses_in_lines(spark):
    lines = spark.createDataFrame([("a", 1, "from 192.0.2.10 at 08:10:02"), ("a", 2, "x 192.0.2.1."), ("a", 3, "to 2001:0db8::0025 and ::ffff:198.51.100.7")], "source string, line_no bigint, text string")
    hit = lambda **q: [r["line_no"] for r in search.matches(lines, search.query(**q)).orderBy("line_no").collect()]
    assert hit(ips=["192.0.2.1"]) == [2] and hit(cidrs=["192.0.2.0/24"]) == [1, 2] and hit(cidrs=["2001:db8::/32"]) == [3]


def test_search_keeps_the_callers_columns(spark):
    lines = spark.createDataFrame([("a", 1, "2024-01-05T10:00:00Z one 192.0.2.1", 7, "u", "o", "t"), ("a", 2, "none", 8, "u", "o", "t")], "source string, line_no bigint, text string, _ips int, _US string, _others string, undated string")
    q = search.query(["one"], cidrs=["192.0.2.0/24"], start="2024-01-05", year=2024)
    found = search.matches(lines, q)
    assert found.columns == lines.columns and [tuple(r)[3:] for r in found.collect()] == [(7, "u", "o", "t")]
    rows = {r["line_no"]: r for r in search.evaluated(lines, q).collect()}
    assert (rows[1]["_ips"], rows[1]["_others"], rows[1]["is_match"], rows[1]["undated"]) == (7, "o", True, False) and not rows[2]["is_match"]


@pytest.mark.parametrize("most", [0, 100])
def test_context_against_brute_force(spark, monkeypatch, most):
    """Lines to show by broadcast and by a shuffle; the third match of a source is one too many."""
    monkeypatch.setattr(search, "MOST_BROADCAST", most)
    texts = {s: ["hit" if (k * k + len(s)) % 11 == 0 else "miss" for k in range(1, 40)] for s in ("a", "bb", "ccc")}
    lines = spark.createDataFrame([(s, k, t) for s, own in texts.items() for k, t in enumerate(own, 1)], "source string, line_no bigint, text string")
    expected = []
    for s, own in texts.items():
        hits = [k for k, t in enumerate(own, 1) if t == "hit"]
        stop = hits[2] if len(hits) > 2 else len(own) + 1
        shown, block = [k for k in range(1, stop) if any(abs(k - h) <= 2 for h in hits[:2])], 0
        for at, k in enumerate(shown):
            block += at == 0 or k - shown[at - 1] > 1
            expected.append((s, k, k in hits[:2], block))
    got = search.search(lines, search.query(["hit"]), context=2, most=2)
    assert sorted((r["source"], r["line_no"], r["is_match"], r["block"]) for r in got.collect()) == expected
