"""Rules of one's own, related values as rows, and bursts on streams."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from emberlog.operators import bursts
from emberlog.settings import BurstSettings, Rule
from emberlog.streaming.bursts import stream_bursts

START = datetime(2025, 3, 2, 21, 30, tzinfo=timezone.utc)
COLUMNS = "ts timestamp, user string, ip string, outcome string, source string, line_no bigint, file_idx int, invalid_user boolean, n int"


def _events(spark, rows):
    """rows: (minute, user, ip, outcome)."""
    return spark.createDataFrame([(START + timedelta(minutes=m), u, i, o, "a.log", k + 1, 0, False, 1) for k, (m, u, i, o) in enumerate(rows)], COLUMNS)


@pytest.mark.parametrize("span", [2, 32])
def test_different_related_values_in_a_sliding_window(spark, monkeypatch, span):
    """Few values that come again and again, over the edges of spans, beside a rule that counts failures."""
    monkeypatch.setattr(bursts, "SPAN", span)
    rng = random.Random(span)
    rows = [(rng.randrange(-300, 300) / 2, rng.choice("abcdefgh"), rng.choice(["x", "y"]), "failure") for _ in range(500)]
    settings = BurstSettings(threshold=4, rules=(Rule("spraying", "ip", "user", "related"), "user"))
    us = lambda m: round((START + timedelta(minutes=m)).timestamp() * 1e6)
    got = {(r["rule"], r["key"], r["us"]): r["in_window"] for r in bursts.window_counts(_events(spark, rows), settings).collect()}
    for ip in ("x", "y"):
        own = [(us(m), u) for m, u, i, _ in rows if i == ip]
        for at in {t for t, _ in own}:
            assert got["spraying", ip, at] == len({u for t, u in own if at - 300_000_000 <= t <= at})
    for user in "ab":
        own = [us(m) for m, u, _, _ in rows if u == user]
        assert all(got["user", user, at] == sum(at - 300_000_000 <= t <= at for t in own) for at in own)
    said = bursts.explanations(bursts.detect_bursts(_events(spark, rows), settings), settings).where("rule = 'spraying'").first()["explanation"]
    assert said[1] == "Rule: 4 or more different accounts failing in a window of 5 min."


def test_rules_are_checked():
    for bad in (("user", "user"), (Rule("r", "a", "b", "sum"),), (Rule("user", "ip", "user"), "user"), ("host",)):
        with pytest.raises(ValueError):
            BurstSettings(rules=bad)


def test_very_many_related_values_are_dealt_out(spark):
    """200,000 accounts that one address sprays: as rows, no task numbers more than a share of them; as a list, the first ten."""
    settings = BurstSettings(rules=("ip",), max_related=10)
    many = spark.range(200_000).select(F.lit(START).cast("timestamp").alias("ts"), F.format_string("u%06d", "id").alias("user"), F.lit("192.0.2.1").alias("ip"), F.lit("failure").alias("outcome"), F.lit("a").alias("source"), F.col("id").alias("line_no"), F.lit(1).alias("n"))
    alert = bursts.burst_alerts(many, settings).first()
    assert alert["n_related"] == 200_000 and alert["related"] == [f"u{k:06}" for k in range(10)]
    each = bursts.burst_related(bursts.member_failures(many, settings))
    found = each.select(F.spark_partition_id().alias("task"), "place", "related")
    assert found.where("related != format_string('u%06d', place - 1)").isEmpty() and found.count() == 200_000
    assert max(r["count"] for r in found.groupBy("task").count().collect()) < 120_000


def test_ranks_of_alerts(spark):
    rows = [(m, u, "192.0.2.1", "failure") for u in "cab" for m in (0, 1, 2, 50, 51, 52)]
    got = bursts.detect_bursts(_events(spark, rows), BurstSettings(threshold=3)).orderBy("rank").collect()
    keys = [(r["first_us"], r["rule"], r["key"]) for r in got]
    assert keys == sorted(keys) and [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_stream_of_batches_out_of_order(spark, tmp_path):
    """Five files, each in any order and some of it late by less than an hour; a last attempt moves the watermark on."""
    rng, settings = random.Random(21), BurstSettings(threshold=4, window=timedelta(minutes=10), success_after=timedelta(minutes=25))
    rows = [(rng.randrange(0, 3_000) / 2, rng.choice("abcd"), rng.choice(["192.0.2.1", "192.0.2.2"]), rng.choice(["failure"] * 4 + ["success"])) for _ in range(900)]
    files = [[] for _ in range(5)]
    for r in rows:
        files[min(4, int((r[0] + rng.randrange(0, 50)) // 310))].append(r)
    for k, own in enumerate(files):
        rng.shuffle(own)
        _events(spark, own).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    _events(spark, [(40_000, "z", "198.51.100.1", "success")]).coalesce(1).write.parquet(f"{tmp_path}/in/5")
    for k in range(6):  # one file a batch, in the order of their times of change
        for f in (tmp_path / "in" / str(k)).glob("part-*.parquet"):
            f.rename(tmp_path / f"{k}.parquet")

            os.utime(tmp_path / f"{k}.parquet", (1_700_000_000 + k * 60,) * 2)
    (tmp_path / "all").mkdir()
    for k in range(6):
        (tmp_path / f"{k}.parquet").rename(tmp_path / "all" / f"{k}.parquet")
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")
    out = stream_bursts(stream, settings, late="1 hour").writeStream.format("memory").queryName("bursts_found").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    out.awaitTermination(300)
    columns = ["rule", "key", "failures", "first_us", "last_us", "success_us", "severity"]
    batch = bursts.detect_bursts(_events(spark, rows), settings).select(*columns[:5], F.col("success.us").alias("success_us"), "severity")
    expected = sorted(map(str, (tuple(r) for r in batch.collect())))
    assert sorted(map(str, (tuple(r) for r in spark.table("bursts_found").select(*columns).collect()))) == expected and len(expected) > 40
    assert sum("alta" in e for e in expected) > 5 < sum("media" in e for e in expected)
    with pytest.raises(ValueError):
        stream_bursts(stream, BurstSettings(rules=(Rule("r", "ip", "user", "related"),)))
