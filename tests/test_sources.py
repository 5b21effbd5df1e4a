"""Numbered lines, event files, writers and streams on small files."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberlog.operators import counting, search
from emberlog.settings import ParseSettings
from emberlog.sources import events, lines, logins, sinks
from emberlog.streaming import counts


def test_numbered_and_cut_lines(spark, tmp_path):
    (tmp_path / "b.log").write_bytes(b"\xef\xbb\xbffirst\r\nsec\xffond\n" + b"x" * 30 + b"\nlast")
    (tmp_path / "a.log").write_bytes(b"only\n")
    rows = lines.read_lines(spark, f"{tmp_path}/b.log", f"{tmp_path}/a.log").orderBy("file_idx", "line_no").collect()
    assert [(r["file_idx"], r["line_no"], r["text"]) for r in rows] == [(0, 1, "first"), (0, 2, "sec�ond"), (0, 3, "x" * 30), (0, 4, "last"), (1, 1, "only")]
    cut = lines.cut_lines(lines.read_lines(spark, f"{tmp_path}/b.log"), 10)
    assert {r["line_no"]: (r["text"], r["truncated"]) for r in cut.collect()}[3] == ("x" * 10, True)
    found = search.search_stats(cut, search.query(["x"]), most=5).first()
    assert (found["lines_read"], found["matches"], found["truncated"], found["stopped_early"]) == (4, 1, 1, False)


@pytest.mark.parametrize("most", [0, 100])
def test_lines_of_split_files_and_folders(spark, tmp_path, monkeypatch, most):
    """Files in blocks of 64 bytes, alone and as the parts of one source; with the blocks broadcast and not."""
    monkeypatch.setattr(lines, "MOST_BROADCAST", most)
    texts = {f"{folder}/part-{k}": [f"{folder}{k} line {i} {'x' * (i % 7)}" for i in range(5 + 9 * k)] for folder in ("p", "q") for k in range(3)}
    for name, own in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(own) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        alone = lines.read_lines(spark, f"{tmp_path}/p/part-2").collect()
        both = lines.read_lines(spark, f"{tmp_path}/q", f"{tmp_path}/p", folders=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    twins = lines.read_lines(spark, f"{tmp_path}/q/part-0", f"{tmp_path}/p/part-0").select("source", "file_idx").distinct().collect()
    assert sorted((r["file_idx"], r["source"][-8:]) for r in twins) == [(0, "p/part-0"), (1, "q/part-0")]  # equal names go by their folders
    assert [t for _, t in sorted((r["line_no"], r["text"]) for r in alone)] == texts["p/part-2"] and {r["file_idx"] for r in alone} == {0}
    for idx, folder in enumerate("qp"):
        own = sorted((r["line_no"], r["text"]) for r in both if r["file_idx"] == idx)
        assert own == list(enumerate([t for k in range(3) for t in texts[f"{folder}/part-{k}"]], 1))


def test_event_files(spark, tmp_path):
    (tmp_path / "e.json").write_text('[{"timestamp": "2025-03-02T21:30:00", "severity": "Low", "title": 7, "ip": "::ffff:192.0.2.7"}, "text", {"severity": "low", "title": true}]')
    (tmp_path / "e.jsonl").write_text('{"timestamp": "2025-03-02T21:30:00Z", "severity": "grave", "title": "t"}\n\nnot json\n')
    (tmp_path / "e.csv").write_text('timestamp,severity,title,note\n2025-03-02T21:30:00Z,media,"a, b",x,more\n2025-03-02T21:30:00Z,media\n')
    rows = events.load_events(spark, f"{tmp_path}/e.json", f"{tmp_path}/e.jsonl", f"{tmp_path}/e.csv")
    got = {r["origin"]: r for r in events.validated(rows, zone="+01:00").collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "e.json[1]": None, "e.json[2]": "not an object", "e.json[3]": "missing fields: timestamp", "e.jsonl:1": "unknown severity", "e.jsonl:3": "invalid JSON", "e.csv:2": None, "e.csv:3": "fewer columns than the header",
    }
    assert (got["e.json[1]"]["title"], got["e.json[1]"]["ip"], got["e.json[1]"]["ts"]) == ("7", "192.0.2.7", datetime(2025, 3, 2, 20, 30)) and got["e.csv:2"]["title"] == "a, b"
    with pytest.raises(ValueError):
        events.event_format("events.txt")


def test_files_of_several_formats(spark, tmp_path):
    texts = {
        "b.log": "# note\n\n2025-03-02T21:30:00Z LOGIN_SUCCESS user=mira ip=192.0.2.7\nodd\n", "a.auth": "Mar  2 21:31:00 gate sshd[5]: Failed password for teo from 192.0.2.8 port 22 ssh2\n",
        "c.CSV": 'timestamp,user,ip,result\n2025-03-02T21:32:00Z,"kim\nli",192.0.2.9,failure\n', "d.log": "2025-03-02T21:33:00Z LOGIN_FAILURE user=mira ip=192.0.2.7\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    paths = [f"{tmp_path}/{n}" for n in ("b.log", "a.auth", "c.CSV", "d.log")]
    got = sorted((r["file_idx"], r["line_no"], r["fmt"], r["status"], r["user"]) for r in logins.load_files(spark, *paths, settings=ParseSettings(year=2025)).collect())
    assert got == [
        (0, 1, "lab", "ignored", None), (0, 2, "lab", "ignored", None), (0, 3, "lab", "event", "mira"), (0, 4, "lab", "unparsed", None),
        (1, 1, "syslog", "event", "teo"), (2, 3, "csv", "event", "kim\nli"), (3, 1, "lab", "event", "mira"),
    ]
    (tmp_path / "e.log").write_text("nothing\n" * 3 + "x\n" * 60 + "2025-03-02T21:33:00Z LOGIN_FAILURE user=mira ip=192.0.2.7\n")
    with pytest.raises(ValueError, match="unknown format: .*e.log"):
        logins.load_files(spark, str(tmp_path))


def test_writers_keep_what_is_there(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 2)], "cell string, n int")
    sinks.write_csv(rows, f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").first()["cell"] == "'=1+1"
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_csv(rows, f"{tmp_path}/out")
    sinks.write_json(rows, f"{tmp_path}/out", force=True)
    sinks.write_rows(rows, "cell", f"{tmp_path}/rows")
    assert spark.read.json(f"{tmp_path}/out").first()["cell"] == "=1+1" and spark.read.text(f"{tmp_path}/rows").first()[0] == "=1+1"


def test_streams(spark, tmp_path):
    schema = "ts timestamp, user string, ip string, outcome string, n int"
    spark.createDataFrame([(datetime(2025, 3, 2, 21, m), "mira", "192.0.2.7", o, n) for m, o, n in ((1, "failure", 2), (4, "failure", 1), (7, "success", 1))], schema).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for name, df in (("running", counting.counts_by(stream(), "user")), ("sliding", counts.sliding_failures(stream(), "ip", "10 minutes", "5 minutes", "1 hour"))):
        df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
    assert [tuple(r) for r in spark.table("running").collect()] == [("mira", 1, 3, 4)]
    assert sorted((r["start"].minute, r["failures"]) for r in spark.table("sliding").select("start", F.col("failures")).collect()) == [(0, 3), (55, 3)]
