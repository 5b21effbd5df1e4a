"""The given tables as login events, log lines and security events; each with the same in SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.scratch import scratch
from emberlog.settings import BurstSettings, ParseSettings

#: About two attempts of a user a day stand in the table, so bursts need hours.
BURSTS = BurstSettings(threshold=3, window=timedelta(hours=12), success_after=timedelta(hours=12), max_evidence=4)
PARSE = ParseSettings(zone="UTC", year=2024)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "view", "click", "purchase")).select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), "user_id").alias("user"), F.concat(F.lit("192.0.2."), k).alias("ip"),
        F.when(F.col("event_type") == "purchase", "success").otherwise("failure").alias("outcome"), F.concat(F.lit("f"), F.col("event_id") % 3).alias("source"),
        F.col("event_id").alias("line_no"), (F.col("event_id") % 3).cast("int").alias("file_idx"), (F.col("event_type") == "click").alias("invalid_user"), (1 + F.col("event_id") % 3).cast("int").alias("n"),
    )


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attempts(spark, sf_dir)


LOGINS = """logins AS (
  SELECT event_id, ts, epoch_us(ts) AS us, 'u' || user_id AS account, '192.0.2.' || regexp_extract(props, '"k": (\\d+)', 1) AS ip,
    CASE WHEN event_type = 'purchase' THEN 'success' ELSE 'failure' END AS outcome, 'f' || (event_id % 3) AS source, event_id AS line_no,
    event_id % 3 AS file_idx, event_type = 'click' AS invalid_user, 1 + event_id % 3 AS n
  FROM events WHERE event_type IN ('error', 'view', 'click', 'purchase'))"""


def _spoilt(df: DataFrame) -> DataFrame:
    when = lambda m, bad, good: F.when(F.col("event_id") % m == 0, bad).otherwise(good)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return df.withColumns({"iso": when(19, F.lit("2024-02-31T10:00:00Z"), iso), "addr": when(17, F.lit("999.1.1.1"), F.col("ip"))})


def lab_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each attempt as a lab line: ids that 29 divides are comments, 23 unknown events, 19 bad dates, 17 bad addresses."""
    what = F.when(F.col("event_id") % 23 == 0, "LOGIN_OTHER").when(F.col("outcome") == "success", "LOGIN_SUCCESS").otherwise("LOGIN_FAILURE")
    line = F.concat_ws(" ", "iso", what, F.concat(F.lit("user="), "user"), F.concat(F.lit("ip="), "addr"), F.lit("method=password"))
    rows = _spoilt(_attempts(spark, sf_dir))
    return rows.select(F.concat("source", F.lit(".log")).alias("source"), "file_idx", "line_no", F.when(F.col("event_id") % 29 == 0, "# note").otherwise(line).alias("text"))


LAB = LOGINS + """, lab AS (
  SELECT *, source || '.log' AS file, CASE WHEN event_id % 29 = 0 THEN 'ignored' WHEN event_id % 23 = 0 OR event_id % 19 = 0 OR event_id % 17 = 0 THEN 'unparsed' ELSE 'event' END AS status,
    CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 'unknown event' WHEN event_id % 19 = 0 THEN 'nonexistent date' WHEN event_id % 17 = 0 THEN 'invalid address' END AS reason
  FROM logins)"""


#: The text of a lab line.
LAB_TEXT = """CASE WHEN event_id % 29 = 0 THEN '# note' ELSE concat_ws(' ', CASE WHEN event_id % 19 = 0 THEN '2024-02-31T10:00:00Z' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END,
        CASE WHEN event_id % 23 = 0 THEN 'LOGIN_OTHER' WHEN outcome = 'success' THEN 'LOGIN_SUCCESS' ELSE 'LOGIN_FAILURE' END,
        'user=' || account, 'ip=' || CASE WHEN event_id % 17 = 0 THEN '999.1.1.1' ELSE ip END, 'method=password') END"""


def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each attempt as an auth.log line, repeats summed up; 29: another process, 23: incomplete, 19: bad date, 17: bad address."""
    said = F.when(F.col("outcome") == "success", F.concat(F.lit("Accepted password for "), "user")).otherwise(F.concat(F.lit("Failed password for "), F.when(F.col("invalid_user"), "invalid user ").otherwise(""), "user"))
    said = F.when(F.col("event_id") % 23 == 0, said).otherwise(F.concat(said, F.lit(" from "), "addr", F.lit(" port 51877 ssh2")))
    said = F.when(F.col("n") > 1, F.concat(F.lit("message repeated "), "n", F.lit(" times: [ "), said, F.lit("]"))).otherwise(said)
    date = F.when(F.col("event_id") % 19 == 0, "Feb 31 10:00:00").otherwise(F.date_format("ts", "MMM d HH:mm:ss"))
    process = F.when(F.col("event_id") % 29 == 0, "CRON[7]: ").otherwise("sshd[777]: ")
    rows = _spoilt(_attempts(spark, sf_dir))
    return rows.select(F.concat("source", F.lit(".auth")).alias("source"), "file_idx", "line_no", F.concat(date, F.lit(" host "), process, said).alias("text"))


SYSLOG = LOGINS + """, syslog AS (
  SELECT *, source || '.auth' AS file,
    CASE WHEN event_id % 19 = 0 THEN 'unparsed' WHEN event_id % 29 = 0 THEN 'ignored' WHEN event_id % 23 = 0 OR event_id % 17 = 0 THEN 'unparsed' ELSE 'event' END AS status,
    CASE WHEN event_id % 19 = 0 THEN 'nonexistent date' WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 'incomplete login message' WHEN event_id % 17 = 0 THEN 'invalid address' END AS reason
  FROM logins)"""


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each attempt as a line of a CSV file with a header; 23: no user, 19: bad date, 17: bad address."""
    user = F.when(F.col("event_id") % 23 == 0, "").otherwise(F.col("user"))
    rows = _spoilt(_attempts(spark, sf_dir)).select(F.concat("source", F.lit(".csv")).alias("source"), "file_idx", (F.col("line_no") + 2).alias("line_no"), F.concat_ws(",", "iso", user, F.concat(F.lit('"'), "addr", F.lit('"')), F.upper("outcome"), F.lit("x")).alias("text"))
    heads = rows.select("source", "file_idx").distinct().select("source", "file_idx", F.lit(1).cast("bigint").alias("line_no"), F.lit("Timestamp, User ,IP,Result,Note").alias("text"))
    return heads.union(rows)


def csv_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """csv_lines as files, a folder of parts a source; users of ids that 7 divides go over two lines."""
    over = F.regexp_replace("text", r"^([^,]*),u(\d+),", '$1,"u\n$2",')
    lines = csv_lines(spark, sf_dir).withColumn("text", F.when((F.col("line_no") > 1) & ((F.col("line_no") - 2) % 7 == 0), over).otherwise(F.col("text")))
    return folders(spark, lines, "csv-lines")


CSV = LOGINS + """, csv AS (
  SELECT *, source || '.csv' AS file, event_id + 2 AS file_line, CASE WHEN event_id % 23 = 0 OR event_id % 19 = 0 OR event_id % 17 = 0 THEN 'unparsed' ELSE 'event' END AS status,
    CASE WHEN event_id % 23 = 0 THEN 'empty columns: user' WHEN event_id % 19 = 0 THEN 'nonexistent date' WHEN event_id % 17 = 0 THEN 'invalid address' END AS reason
  FROM logins)"""


def folders(spark: SparkSession, lines: DataFrame, label: str) -> list[str]:
    """Writes lines (source, line_no, text) as text, a folder of parts in order for each of a few sources, and returns their paths."""
    path, sources = scratch(spark, label), sorted(r["source"] for r in lines.select("source").distinct().collect())
    lines.repartitionByRange("source", "line_no").sortWithinPartitions("source", "line_no").select("source", "text").write.partitionBy("source").text(path)
    return [f"{path}/source={s}" for s in sources]


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, line_no, text): the lines of each document, its id being the source."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("source"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).select("source", (F.col("pos") + 1).cast("bigint").alias("line_no"), "text")


DOCUMENT_LINES = """lines AS (
  SELECT doc_id AS source, unnest(l) AS text, CAST(generate_subscripts(l, 1) AS BIGINT) AS line_no
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""

def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, row, bad): each row of events as a security event; some are spoilt."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    severity = F.when(F.col("event_type") == "error", "Critical").when(F.col("event_type") == "view", "high").when(F.col("event_type") == "click", "MEDIA").when(F.col("event_type") == "purchase", " low ").otherwise("informational")
    row = F.struct(
        F.when(i % 19 == 0, "2024-02-31T10:00:00Z").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("timestamp"),
        F.when(i % 23 == 0, "grave").otherwise(severity).alias("severity"), F.when(i % 29 != 0, F.col("event_type")).alias("title"), F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("s"), i % 60)).alias("source"),
        F.when(i % 2 == 0, F.concat(F.lit("value <"), F.col("value").cast("string"), F.lit("> | x"))).otherwise("").alias("description"),
        F.when(i % 17 == 0, "999.1.1.1").when(i % 5 == 0, "").otherwise(F.concat(F.lit("192.0.2."), F.get_json_object("props", "$.k"))).alias("ip"), F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("u_"), "user_id")).alias("user"),
    )
    text = F.when(i % 31 == 0, "[1]").when(i % 37 == 0, "{bad").otherwise(F.to_json(row))
    value = F.try_parse_json(text)
    return e.select(F.concat(F.lit("e:"), "event_id").alias("origin"), value.alias("row"), F.when(value.isNull(), "invalid JSON").alias("bad"))


SECURITY = """judged AS (
  SELECT *, 'e:' || event_id AS origin, epoch_us(ts) AS us,
    CASE WHEN event_id % 31 = 0 THEN 'not an object' WHEN event_id % 37 = 0 THEN 'invalid JSON' WHEN event_id % 29 = 0 THEN 'missing fields: title'
      WHEN event_id % 23 = 0 THEN 'unknown severity' WHEN event_id % 19 = 0 THEN 'nonexistent date' WHEN event_id % 17 = 0 THEN 'invalid address' END AS reason,
    CASE event_type WHEN 'error' THEN 'critica' WHEN 'view' THEN 'alta' WHEN 'click' THEN 'media' WHEN 'purchase' THEN 'baja' ELSE 'info' END AS severity,
    CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS rank,
    CASE event_type WHEN 'error' THEN 'Crítica' WHEN 'view' THEN 'Alta' WHEN 'click' THEN 'Media' WHEN 'purchase' THEN 'Baja' ELSE 'Informativa' END AS label,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE 's' || (event_id % 60) END AS source, event_id % 2 = 0 AS described,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE '192.0.2.' || regexp_extract(props, '"k": (\\d+)', 1) END AS ip,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE 'u_' || user_id END AS account
  FROM events),
sec AS (SELECT * FROM judged WHERE reason IS NULL)"""
