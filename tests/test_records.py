"""Records over lines against Python's csv module; numbered lines whose splits change."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import functions as F

from emberlog.sources import events, lines, logins, records


def _numbered(spark, texts):
    rows = [(s, k, t, f"{s}{k}") for s, own in texts.items() for k, t in enumerate(own, 1)]
    return spark.createDataFrame(rows, "source string, line_no bigint, text string, other string")


def _by_module(own):
    reader, out, before = csv.reader([t + "\n" for t in own]), [], 0
    for row in reader:
        out.append((before + 1, reader.line_num, row))
        before = reader.line_num
    return out


@pytest.mark.parametrize(("chunk", "most"), [(3, 0), (5, 500_000), (100_000, 500_000)])
def test_records_equal_the_csv_module(spark, monkeypatch, chunk, most):
    """Fields over several lines and chunks, quotes inside and after fields, an unclosed quote at the end of one source."""
    monkeypatch.setattr(records, "CHUNK", chunk)
    monkeypatch.setattr(records, "MOST_BROADCAST", most)
    rng, texts = random.Random(chunk), {}
    pieces = ["a", "", "b c", '"q"', '"x,y"', '"two""quotes"', 'mid"dle', '"tail"end', '"open', 'close"', '""', '"', '"a""']
    for s in range(12):
        texts[f"s{s}"] = [",".join(rng.choice(pieces) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 30))]
    texts["plain"] = ["a,b", "", "c"]
    texts["unclosed"] = ["a,b", 'c,"d', "e", "f,g", ""]
    found = records.csv_records(_numbered(spark, texts))
    got = found.withColumn("fields", F.transform(records.fields_of(F.col("text")), records.field_value)).collect()
    assert any(r["open"] for r in got) and sum(r["line_no"] > r["first_line"] for r in got) > 20
    for s, own in texts.items():
        expected = [(a, b, row or [""]) for a, b, row in _by_module(own)]
        mine = sorted((r["first_line"], r["line_no"], r["fields"]) for r in got if r["source"] == s)
        if mine[-1][2] != expected[-1][2] and any(r["open"] for r in got if r["source"] == s):  # the module ends an open field with the last line's break
            mine[-1][2][-1] += "\n"
        assert mine == expected, s
        assert all(r["other"] == f"{s}{r['first_line']}" for r in got if r["source"] == s)


def test_long_records_keep_their_first_lines(spark):
    texts = {"closed": ['a,"b', *"cdefg", 'h"', "next"], "endless": ["x", 'a,"b', *"cdefghijk"]}
    got = records.csv_records(_numbered(spark, texts), most_lines=3).orderBy("source", "line_no").collect()
    assert [(r["source"], r["first_line"], r["line_no"], r["text"], r["open"]) for r in got] == [
        ("closed", 1, 3, 'a,"b\nc\nd', True), ("closed", 8, 8, "next", False), ("endless", 1, 1, "x", False), ("endless", 2, 4, 'a,"b\nc\nd', True),
    ]


def test_logins_and_events_over_lines(spark, tmp_path):
    (tmp_path / "l.csv").write_text('Time,timestamp,"User ",ip,result\n1,2025-03-02T21:30:00Z,"two\nlines",192.0.2.7,success\n\n2,2025-03-02T21:31:00Z,"say ""hi""",192.0.2.8,Failure,more\n   \n3,2025-03-02T21:31:00Z,"never closed\n,\n')
    got = logins.parse_csv(lines.read_lines(spark, f"{tmp_path}/l.csv")).orderBy("line_no").collect()
    assert [(r["line_no"], r["user"], r["reason"]) for r in got] == [(3, "two\nlines", None), (5, 'say "hi"', None), (6, None, "empty columns: timestamp, user, ip, result"), (8, None, "quoted field without an end")]
    (tmp_path / "e.csv").write_text('title,severity,timestamp\n"one\nword",low,2025-03-02T21:30:00Z\nx,low\n"a, ""b""",high,2025-03-02T21:30:00Z\n')
    (tmp_path / "f.csv").write_text('timestamp,title,note,severity\n2025-03-02T21:30:00Z,other,,media\n')
    rows = {r["origin"]: r for r in events.validated(events.load_csv(spark, f"{tmp_path}/e.csv", f"{tmp_path}/f.csv")).collect()}
    assert {k: (r["title"], r["reason"]) for k, r in rows.items()} == {"e.csv:3": ("oneword", None), "e.csv:4": ("", "fewer columns than the header"), "e.csv:5": ('a, "b"', None), "f.csv:2": ("other", None)}
    with pytest.raises(ValueError, match="columns missing"):
        events.load_csv(spark, f"{tmp_path}/l.csv")


def test_lines_are_numbered_without_a_copy_and_fail_if_splits_change(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.log").write_text("".join(f"{k} {i} {'x' * (i % 50)}\n" for i in range(3_000)))
    spark.conf.unset(lines.SPLITS)
    rows = lines.read_lines(spark, *(f"{tmp_path}/{k}.log" for k in range(3)))
    pinned = spark.conf.get(lines.SPLITS)
    assert "Parquet" not in rows.select("text")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    try:
        spark.conf.set(lines.SPLITS, "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        with pytest.raises(Exception, match="have changed since"):
            rows.collect()
    finally:
        spark.conf.set(lines.SPLITS, pinned)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r["file_idx"], r["line_no"], r["text"]) for r in rows.select("*").collect()) == [(k, i + 1, f"{k} {i} {'x' * (i % 50)}") for k in range(3) for i in range(3_000)]
