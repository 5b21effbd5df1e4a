"""Queries of the column functions and the event sources, each over texts made from the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions import ip, text, time
from emberlog.functions.columns import settled
from emberlog.plans.inputs import table
from emberlog.scratch import scratch
from emberlog.sources import events as sources
from emberlog.sources.logins import kv_map

#: Offsets of local times, by event_id % 4: how they are written and their minutes; the last one is left out.
OFFSETS = (("Z", 0), ("-06:00", -360), ("+05:30", 330), ("", 0))
DURATION = 7_321
#: Texts that would be read as markup, a formula or a terminal command.
HOSTILE = ("<b>&\"bold\"</b>", "a|b *c* [d](e) #f !g ~h `i` \\ j_k", "\x1b[31m\tred\r\n  and\x07 ring ", "=HYPERLINK(1)", "+1", "-1", "@cmd", "\tTAB", "\rCR", "it's plain")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _pick(values: tuple, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _moment(separator: str = "T") -> Column:
    """The event's time as ISO text in one of OFFSETS; every 19th is a day that doesn't exist."""
    minutes, i = _pick(tuple(m for _, m in OFFSETS), F.col("event_id")).cast("bigint"), F.col("event_id")
    local = F.timestamp_micros(F.unix_micros("ts") + minutes * 60_000_000)
    iso = F.concat(F.date_format(local, f"yyyy-MM-dd'{separator}'HH:mm:ss.SSSSSS"), _pick(tuple(o for o, _ in OFFSETS), i))
    return F.when(i % 19 == 0, F.concat(F.lit(f"2023-02-29{separator}10:00:00"), _pick(tuple(o for o, _ in OFFSETS), i))).otherwise(iso)


def fn_parse_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("x", F.when(F.col("event_id") % 23 == 0, "14/09/2024 10:00").otherwise(F.concat(F.lit(" "), _moment(" "))))
    rows = rows.withColumn("at", time.iso_timestamp(F.col("x")))
    return rows.select("event_id", F.unix_micros("at").alias("us"), time.iso_error(F.col("x"), F.col("at")).alias("error"))


def fn_parse_syslog_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda f: F.date_format("ts", f)
    day = F.when(F.col("event_id") % 19 == 0, "31").otherwise(part("d"))
    month = F.when(F.col("event_id") % 19 == 0, "Feb").when(F.col("event_id") % 23 == 0, "Foo").otherwise(part("MMM"))
    return _events(spark, sf_dir).select("event_id", F.unix_micros(time.syslog_timestamp(month, day, part("HH:mm:ss"), 2024, "-06:00")).alias("us"))


def fn_extract_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    line = F.when(i % 3 == 0, F.concat(F.lit("  "), _moment(), F.lit(" said"))).when(i % 3 == 1, F.concat(F.date_format("ts", "MMM  d HH:mm:ss"), F.lit(" host said"))).otherwise(F.concat(F.lit("said at "), _moment()))
    rows = settled(_events(spark, sf_dir), line=line)
    iso, old = time.leading_texts(F.col("line"))
    return settled(rows, iso=iso, old=old).select("event_id", F.unix_micros(time.leading_instant(F.col("iso"), F.col("old"), 2024)).alias("us"))


def fn_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.unix_micros(time.to_utc(F.col("ts"), "+05:30")).alias("us"))


def fn_format_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", time.format_timestamp(F.col("ts"), "-03:30").alias("shown"))


def fn_format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", time.format_duration(F.col("event_id") * 37 % DURATION).alias("shown"))


def _addresses() -> Column:
    """Ways to write an address, by event_id % 7; the last two aren't valid."""
    k, n = F.col("k").cast("string"), F.col("event_id") % 7
    long = F.concat(F.lit("[2001:0DB8:0000:0000:0000:0000:0000:"), F.lpad(F.hex(F.col("k") + 1), 4, "0"), F.lit("]"))
    ways = (F.concat(F.lit(" 192.0.2."), k, F.lit("\t")), long, F.concat(F.lit("::ffff:192.0.2."), k), F.concat(F.lit("2001:db8::1:"), k), F.concat(F.lit("FE80::"), k), F.concat(F.lit("192.0.02."), k))
    out = F.concat(F.lit("2001:db8:::"), k)
    for j, way in enumerate(ways):
        out = F.when(n == j, way).otherwise(out)
    return out


def fn_normalize_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", ip.normalize_ip(_addresses()).alias("ip"))


def fn_find_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("10:20:30 from "), _addresses(), F.lit(", then 198.51.100."), F.col("k").cast("string"), F.lit(". 1.2.3.4.5 cafe"))
    return _events(spark, sf_dir).select("event_id", F.array_join(ip.find_ips(line), " ").alias("ips"))


def fn_kv_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.concat(F.lit(" User=first  note=a=b word =x IP="), F.col("k").cast("string"), F.lit(" USER=u"), F.col("user_id").cast("string"))
    found = kv_map(fields)
    value = lambda key: F.try_element_at(found, F.lit(key)).alias(f"{key}_value")
    return _events(spark, sf_dir).select("event_id", F.size(found).cast("bigint").alias("fields"), value("user"), value("note"), value("ip"))


def _hostile(spark: SparkSession, sf_dir: str, shown) -> DataFrame:
    x = F.concat(_pick(HOSTILE, F.col("event_id")), F.col("event_type"))
    return _events(spark, sf_dir).select("event_id", shown(x).alias("shown"))


def fn_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hostile(spark, sf_dir, text.clean_text)


def fn_safe_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hostile(spark, sf_dir, text.safe_csv_cell)


def fn_single_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hostile(spark, sf_dir, text.single_line)


def fn_md_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hostile(spark, sf_dir, text.md_escape)


def fn_html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hostile(spark, sf_dir, text.html_escape)


def normalize_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", sources.normalize_severity(_severity()).alias("severity"))


NAMED = (" Critical", "HIGH\t", "Crítica", "med", "Informational ", "grave", "low", "baja", "")


def _severity() -> Column:
    return _pick(NAMED, F.col("event_id"))


def _record() -> Column:
    i = F.col("event_id")
    title = F.when(i % 29 == 0, "").otherwise(F.concat(F.col("event_type"), F.lit(', "quoted"')))
    return F.struct(_moment().alias("timestamp"), _severity().alias("severity"), title.alias("title"), F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("u"), "user_id")).alias("user"))


def _shown(rows: DataFrame) -> DataFrame:
    checked = sources.validated(rows)
    return checked.select("reason", F.when(F.col("reason").isNull(), F.unix_micros("ts")).alias("us"), "severity", "title", F.col("user").alias("account"))


def load_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of JSON documents of at most 1000 events each, written from the table."""
    path = scratch(spark, "json-events")
    texts = _events(spark, sf_dir).select(F.floor(F.col("event_id") / 1000).alias("part"), F.to_json(_record()).alias("x")).groupBy("part").agg(F.array_join(F.collect_list("x"), ",").alias("x"))
    texts.select("part", F.concat(F.lit('{"events":['), "x", F.lit("]}")).alias("value")).repartition("part").write.partitionBy("part").text(path)
    return _shown(sources.load_json(spark, path + "/*"))


def load_long_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of JSON documents of 20,000 events each, which are cut into their elements by several tasks."""
    path, part = scratch(spark, "long-json"), Window.partitionBy("part").orderBy("event_id")
    rows = _events(spark, sf_dir).select(F.floor(F.col("event_id") / 20_000).alias("part"), "event_id", F.to_json(_record()).alias("x"))
    first, last = F.lag("event_id").over(part).isNull(), F.lead("event_id").over(part).isNull()
    value = F.concat(F.when(first, '{"events":[\n').otherwise(","), "x", F.when(last, "\n]}").otherwise(""))
    # a document is one task's and in order behind the window; a union with its ends would lose that when partitions are coalesced
    rows.select("part", "event_id", value.alias("value")).sortWithinPartitions("part", "event_id").drop("event_id").write.partitionBy("part").text(path)
    return _shown(sources.load_json(spark, path + "/*", split_above=100_000))


def load_jsonl_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of JSON lines, every 31st spoilt and every 37th blank."""
    path, i = scratch(spark, "jsonl-events"), F.col("event_id")
    _events(spark, sf_dir).select(F.when(i % 31 == 0, "{bad").when(i % 37 == 0, " ").otherwise(F.to_json(_record())).alias("value")).write.text(path)
    return _shown(sources.load_jsonl(spark, path))


def load_csv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of CSV files of 50,000 events each with a header, every 31st too short and every 37th with a field too many."""
    path, i, quoted = scratch(spark, "csv-events"), F.col("event_id"), lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    r = _record()
    cells = F.concat_ws(",", r["timestamp"], quoted(r["severity"]), quoted(r["title"]), r["user"])
    row = F.when(i % 31 == 0, r["timestamp"]).when(i % 37 == 0, F.concat(cells, F.lit(",more"))).otherwise(cells)
    rows = _events(spark, sf_dir).select(F.floor(i / 50_000).alias("part"), "event_id", row.alias("value"))
    heads = rows.select("part").distinct().select("part", F.lit(-1).cast("bigint").alias("event_id"), F.lit("timestamp,severity,title,user").alias("value"))
    heads.union(rows).repartition("part").sortWithinPartitions("part", "event_id").drop("event_id").write.partitionBy("part").text(path)
    return _shown(sources.load_csv(spark, path + "/*"))


NAMES = (
    "fn_parse_iso fn_parse_syslog_ts fn_extract_ts fn_to_utc fn_format_ts fn_format_duration fn_normalize_ip fn_find_ips fn_kv_map fn_clean_text fn_safe_csv fn_single_line fn_md_escape fn_html_escape "
    "normalize_severity load_json_events load_long_json_events load_jsonl_events load_csv_events"
).split()
QUERIES = {name: globals()[name] for name in NAMES}


def _list(values: tuple) -> str:
    """A SQL list of texts, control characters by their numbers."""
    def one(x: str) -> str:
        out = x.replace("'", "''")
        for c in "\x1b\t\r\n\x07":
            out = out.replace(c, f"' || chr({ord(c)}) || '")
        return f"'{out}'"

    return "[" + ", ".join(map(one, values)) + "]"


_E = """WITH e AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) AS k FROM events)"""
_X = f"{_E}, h AS (SELECT event_id, {_list(HOSTILE)}[CAST(event_id % {len(HOSTILE)} AS INTEGER) + 1] || event_type AS x FROM e)"
_CLEAN = "replace(replace({0}, chr(27), '\\x1b'), chr(7), '\\x07')"
_FLAT = "trim(regexp_replace(" + _CLEAN.format("translate(x, chr(13) || chr(10) || chr(9), '   ')") + ", ' +', ' ', 'g'))"
_ANGLES = f"replace(replace(replace({_FLAT}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_SEVERITY = f"""{_list(("critica", "alta", "critica", "media", "info", "?", "baja", "baja", "?"))}[CAST(event_id % {len(NAMED)} AS INTEGER) + 1]"""
_IP = """CASE event_id % 7 WHEN 0 THEN '192.0.2.' || k WHEN 1 THEN '2001:db8::' || lower(to_hex(k + 1)) WHEN 2 THEN '192.0.2.' || k
  WHEN 3 THEN CASE k WHEN 0 THEN '2001:db8::1:0' ELSE '2001:db8::1:' || k END WHEN 4 THEN 'fe80::' || CASE k WHEN 0 THEN '0' ELSE CAST(k AS VARCHAR) END END"""
_SPAN = "(event_id * 37 % 7321)"
_JUDGED = f"""{_E}, j AS (SELECT *, {_SEVERITY} AS own, CASE WHEN event_id % {{short}} = 0 THEN '{{why}}' WHEN {{missing}} != '' THEN 'missing fields: ' || {{missing}}
  WHEN {_SEVERITY} = '?' THEN 'unknown severity' WHEN event_id % 19 = 0 THEN 'nonexistent date' END AS reason FROM e {{rows}})
SELECT reason, CASE WHEN reason IS NULL THEN us END AS us, CASE WHEN {{gone}} OR own = '?' THEN NULL ELSE own END AS severity,
  CASE WHEN {{gone}} OR event_id % 29 = 0 THEN '' ELSE event_type || ', "quoted"' END AS title, CASE WHEN {{gone}} OR event_id % 7 = 0 THEN '' ELSE 'u' || user_id END AS account FROM j"""
_MISSING = f"concat_ws(', ', CASE WHEN event_id % {len(NAMED)} = {len(NAMED) - 1} THEN 'severity' END, CASE WHEN event_id % 29 = 0 THEN 'title' END)"

SQL = {
    "fn_parse_iso": f"{_E} SELECT event_id, CASE WHEN event_id % 23 != 0 AND event_id % 19 != 0 THEN us END AS us, CASE WHEN event_id % 23 = 0 THEN 'unrecognised timestamp' WHEN event_id % 19 = 0 THEN 'nonexistent date' END AS error FROM e",
    "fn_parse_syslog_ts": f"{_E} SELECT event_id, CASE WHEN event_id % 19 != 0 AND event_id % 23 != 0 THEN us // 1000000 * 1000000 + 21600000000 END AS us FROM e",
    "fn_extract_ts": f"{_E} SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 19 != 0 THEN us WHEN event_id % 3 = 1 THEN us // 1000000 * 1000000 END AS us FROM e",
    "fn_to_utc": f"{_E} SELECT event_id, us - 19800000000 AS us FROM e",
    "fn_format_ts": f"{_E} SELECT event_id, strftime(ts - INTERVAL 210 MINUTE, '%Y-%m-%d %H:%M:%S') || '-03:30' AS shown FROM e",
    "fn_format_duration": f"""{_E} SELECT event_id, CASE WHEN {_SPAN} >= 3600 THEN ({_SPAN} // 3600) || ' h ' ELSE '' END || CASE WHEN {_SPAN} >= 60 THEN ({_SPAN} % 3600 // 60) || ' min ' ELSE '' END || ({_SPAN} % 60) || ' s' AS shown FROM e""",
    "fn_normalize_ip": f"{_E} SELECT event_id, replace({_IP}, 'fe80::0', 'fe80::') AS ip FROM e",
    "fn_find_ips": f"{_E} SELECT event_id, concat_ws(' ', CASE WHEN event_id % 7 != 2 THEN replace({_IP}, 'fe80::0', 'fe80::') END, '198.51.100.' || k) AS ips FROM e",  # a token loses the colons at its ends
    "fn_kv_map": f"{_E} SELECT event_id, CAST(3 AS BIGINT) AS fields, 'u' || user_id AS user_value, 'a=b' AS note_value, CAST(k AS VARCHAR) AS ip_value FROM e",
    "fn_clean_text": f"{_X} SELECT event_id, replace(replace(replace({_CLEAN.format('x')}, chr(9), '\\x09'), chr(13), '\\x0d'), chr(10), '\\x0a') AS shown FROM h",
    "fn_safe_csv": f"{_X} SELECT event_id, CASE WHEN event_id % {len(HOSTILE)} BETWEEN 3 AND 8 THEN '''' ELSE '' END || x AS shown FROM h",
    "fn_single_line": f"{_X} SELECT event_id, {_FLAT} AS shown FROM h",
    "fn_md_escape": rf"{_X} SELECT event_id, regexp_replace({_ANGLES}, '([\\`*_\[\]|!#~])', '\\\1', 'g') AS shown FROM h",
    "fn_html_escape": f"{_X} SELECT event_id, replace(replace({_ANGLES}, chr(34), '&quot;'), '''', '&#x27;') AS shown FROM h",
    "normalize_severity": f"{_E} SELECT event_id, nullif({_SEVERITY}, '?') AS severity FROM e",
    "load_json_events": _JUDGED.format(short="1 != 0 AND 1", why="", missing=_MISSING, gone="false", rows=""),
    "load_long_json_events": _JUDGED.format(short="1 != 0 AND 1", why="", missing=_MISSING, gone="false", rows=""),
    "load_jsonl_events": _JUDGED.format(short=31, why="invalid JSON", missing=_MISSING, gone="event_id % 31 = 0", rows="WHERE event_id % 37 != 0 OR event_id % 31 = 0"),
    "load_csv_events": _JUDGED.format(short=31, why="fewer columns than the header", missing=_MISSING, gone="event_id % 31 = 0", rows=""),
}
