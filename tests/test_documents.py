"""JSON documents cut into elements, against the json module; scratch folders that are cleared."""

from __future__ import annotations

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from emberlog import scratch as folders
from emberlog.plans import functions
from emberlog.sources import documents, events


def _value(rng, depth=0):
    kind = rng.random()
    text = "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "a", "é", "\n", "💡"]) for _ in range(rng.randrange(8)))
    if depth < 3 and kind < 0.55:
        return {f"{k}{text}": _value(rng, depth + 1) for k in range(rng.randrange(4))}
    if depth < 3 and kind < 0.7:
        return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([text, text, rng.randrange(99), True, None])


@pytest.mark.parametrize("chunk", [3, 50_000])
def test_elements_equal_the_json_module(spark, tmp_path, monkeypatch, chunk):
    """Texts full of brackets, quotes and escapes; lists, objects with events, empty ones; blocks of 256 bytes."""
    monkeypatch.setattr(documents, "CHUNK", chunk)
    rng, expected = random.Random(chunk), {}
    for k in range(14):
        own = [_value(rng) for _ in range(rng.choice([0, 1, 2, 40]))]
        indent = rng.choice([None, 1])
        text = json.dumps({"events": own} if k % 2 else own, indent=indent, ensure_ascii=k % 3 == 0) + rng.choice(["", "\n", " \n"])
        (tmp_path / f"{k}.json").write_text(("﻿" if k == 4 else "") + text)
        expected[f"{k}.json"] = own
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        got = documents.elements(spark, str(tmp_path)).select(F.element_at(F.split("source", "/"), -1).alias("name"), "pos", F.to_json("value").alias("json")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    for name, own in expected.items():
        mine = sorted((r["pos"], r["json"]) for r in got if r["name"] == name)
        assert [p for p, _ in mine] == list(range(1, len(own) + 1)), name
        assert [json.loads(j) if j is not None else None for _, j in mine] == own, name


@pytest.mark.parametrize("text", ['{"other": [{}]}', '[{"a": 1}, {"b": 2', '[{"a": 1} {"b": 2}]', '[{"a": 1},]', '[,{"a": 1}]', '[{"a": 1},, {"b": 2}]', '{"events": [{"a": 1}], "more": {}}', "", "7", '[{"a": "x}, {"b": 1}]'])
def test_other_documents_are_errors(spark, tmp_path, text):
    (tmp_path / "d.json").write_text(text)
    if not text:  # an empty file has no lines and so no events
        assert documents.elements(spark, str(tmp_path)).count() == 0
        return
    with pytest.raises(Exception, match="list of events"):
        documents.elements(spark, str(tmp_path)).collect()


def test_large_documents_are_split_over_tasks(spark, tmp_path):
    rows = [{"timestamp": "2025-03-02T21:30:00Z", "severity": "low", "title": f"t{k} }}{{", "note": {"k": [k]}} for k in range(4_000)]
    (tmp_path / "large.json").write_text(json.dumps(rows))
    (tmp_path / "small.json").write_text(json.dumps({"events": rows[:2], "more": 1}))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(32 << 10))
    try:
        assert spark.read.text(f"{tmp_path}/large.json", lineSep="}").rdd.getNumPartitions() >= 4
        got = events.validated(events.load_json(spark, str(tmp_path), split_above=10_000)).select("origin", "reason", "title").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    expected = [(f"large.json[{k + 1}]", None, f"t{k} }}{{") for k in range(4_000)] + [(f"small.json[{k + 1}]", None, f"t{k} }}{{") for k in range(2)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_cleared_folders(spark):
    kept = folders.scratch(spark, "kept")
    with folders.cleared():
        gone = folders.scratch(spark, "gone")
        for path in (kept, gone):
            folders.stored(spark.range(3), path)
    where = lambda p: p.removeprefix("file:")
    assert os.path.isdir(where(kept)) and not os.path.exists(where(gone))


def test_query_writes_each_of_several_documents_whole(spark):
    """Five documents of the larger tables, whose partitions Spark coalesces."""
    rows = functions.load_long_json_events(spark, "/root/testdata/sf0.1")
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.1/events.parquet").count() > 40_000


def test_no_join_of_pieces_or_elements_goes_through_the_driver(spark, tmp_path, monkeypatch):
    """Tables of a row a piece or an element are never broadcast, however small Spark takes them for: a document's numbers are a few bytes as Parquet."""
    rows = [{"title": f"t{k}"} for k in range(50)]
    (tmp_path / "d.json").write_text(json.dumps({"events": rows}))
    plans, real = [], documents.stored

    def planned(df):
        df.collect()  # else the plan isn't the final one
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(documents, "stored", lambda df, path: (planned(df), real(df, path))[1])
    found = documents.elements(spark, str(tmp_path))
    planned(found)
    assert found.count() == 50
    keys = lambda kind: [k for p in plans for k in re.findall(kind + r"Join \[([^\]]*)\]", p)]
    by_row = lambda k: re.search(r"\b(no|segment)#", k)
    assert {re.sub(r"#\d+L?", "", k) for k in keys("SortMerge") if by_row(k)} == {"source, no", "source, segment"}
    assert keys("BroadcastHash") and not [k for k in keys("BroadcastHash") if by_row(k)]
