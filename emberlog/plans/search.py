"""Queries that search the lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import networks, search
from emberlog.plans.inputs import DOCUMENT_LINES, LAB, LAB_TEXT, document_lines, lab_lines, logins
from emberlog.sources.lines import LONGEST, cut_lines

WORDS = ("the", "und")


def _found(spark: SparkSession, sf_dir: str, **criteria) -> DataFrame:
    return search.matches(document_lines(spark, sf_dir), search.query(**criteria)).select("source", "line_no")


def search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, keywords=WORDS)


def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, keywords=WORDS, match_all=True)


def search_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, keywords=("The",), case_sensitive=True)


def search_cidr(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = search.query(cidrs=("192.0.2.70/26", "198.51.100.0/24", "2001:db8::/32"))
    return search.matches(lab_lines(spark, sf_dir), q).select("source", "line_no")


def search_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = search.query(ips=("192.0.2.1", "192.0.2.20"))
    return search.matches(lab_lines(spark, sf_dir), q).select("source", "line_no")


def search_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = search.query(start="2024-01-05", end="2024-01-07T12:00:00Z", year=2024)
    return search.matches(lab_lines(spark, sf_dir), q).select("source", "line_no")


def search_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = search.query(["login_failure"], cidrs=("192.0.2.0/26",), start="2024-01-05", end="2024-01-15", year=2024)
    return search.matches(lab_lines(spark, sf_dir), q).select("source", "line_no")


_CAPPED = {"keywords": ("an",), "case_sensitive": True}


def search_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.capped(document_lines(spark, sf_dir), search.query(**_CAPPED), 3)[0].select("source", "line_no")


def search_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`ss` in any case: also where a sharp s stands, which folds to it."""
    return _found(spark, sf_dir, keywords=("SS",))


def search_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the lab lines with the longest network of a table: the fours of addresses that users of even number were seen at, the upper half, and a network of the other version."""
    fours = logins(spark, sf_dir).where("cast(substring(user, 2) as bigint) % 2 = 0").select(F.concat("ip", F.lit("/30")).alias("network")).distinct()
    wide = spark.range(2).select(F.when(F.col("id") == 0, "192.0.2.64/25").otherwise("2001:db8::/32").alias("network"))
    high = fours.where("cast(split_part(split_part(network, '/', 1), '.', 4) as int) >= 40")
    return networks.addresses_in_networks(lab_lines(spark, sf_dir), high.union(wide))


def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(document_lines(spark, sf_dir), search.query(**_CAPPED), context=2)
    return found.select("source", "line_no", "is_match", "block")


def search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_stats(cut_lines(document_lines(spark, sf_dir)), search.query(**_CAPPED))


def undated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = search.query(start="2024-01-05", end="2024-01-07", year=2024)
    return search.search_stats(lab_lines(spark, sf_dir).withColumn("truncated", F.lit(False)), q)


def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with three lines before and after (a log holds every third number), and the statistics of each log, as JSON records."""
    lines, q = lab_lines(spark, sf_dir), search.query(["login_failure"], cidrs=("192.0.2.0/28",), start="2024-01-05", end="2024-01-06", year=2024)
    return search.search_json(search.search(lines, q, context=3), search.search_stats(lines, q))


NAMES = "search_any search_all search_case search_cidr search_ip search_dates search_combined search_folded search_networks search_capped search_context search_stats search_json undated_lines".split()
QUERIES = {name: globals()[name] for name in NAMES}

_ANY = "contains(lower(text), 'the')", "contains(lower(text), 'und')"
_LINES = f"WITH {DOCUMENT_LINES}"
_SHOWN = LAB + """, shown AS (
  SELECT file AS source, line_no, event_id, CASE WHEN event_id % 29 != 0 AND event_id % 17 != 0 THEN ip END AS addr, CASE WHEN event_id % 29 != 0 AND event_id % 19 != 0 THEN ts END AS moment,
    event_id % 29 != 0 AND event_id % 23 != 0 AND outcome = 'failure' AS failed FROM lab)"""
_CAP = f"""{_LINES}, hits AS (SELECT source, line_no, row_number() OVER (PARTITION BY source ORDER BY line_no) AS place FROM lines WHERE contains(text, 'an'))"""
_RANGE = lambda a, b: f"moment >= TIMESTAMP '{a}' AND moment <= TIMESTAMP '{b}'"

SQL = {
    "search_any": f"{_LINES} SELECT source, line_no FROM lines WHERE {_ANY[0]} OR {_ANY[1]}",
    "search_all": f"{_LINES} SELECT source, line_no FROM lines WHERE {_ANY[0]} AND {_ANY[1]}",
    "search_case": f"{_LINES} SELECT source, line_no FROM lines WHERE contains(text, 'The')",
    "search_cidr": f"WITH {_SHOWN} SELECT source, line_no FROM shown WHERE CAST(split_part(addr, '.', 4) AS INTEGER) BETWEEN 64 AND 127",
    "search_ip": f"WITH {_SHOWN} SELECT source, line_no FROM shown WHERE addr IN ('192.0.2.1', '192.0.2.20')",
    "search_dates": f"WITH {_SHOWN} SELECT source, line_no FROM shown WHERE {_RANGE('2024-01-05 00:00:00', '2024-01-07 12:00:00')}",
    "search_combined": f"WITH {_SHOWN} SELECT source, line_no FROM shown WHERE failed AND CAST(split_part(addr, '.', 4) AS INTEGER) < 64 AND {_RANGE('2024-01-05 00:00:00', '2024-01-15 23:59:59.999999')}",
    "search_capped": f"{_CAP} SELECT source, line_no FROM hits WHERE place <= 3",
    "search_folded": f"{_LINES} SELECT source, line_no FROM lines WHERE contains(replace(lower(text), 'ß', 'ss'), 'ss')",
    "search_networks": f"""WITH {_SHOWN}, fours AS (
        SELECT number - number % 4 AS low, min(ip || '/30') AS network FROM (SELECT ip, CAST(split_part(ip, '.', 4) AS INTEGER) AS number FROM logins WHERE CAST(substr(account, 2) AS BIGINT) % 2 = 0) WHERE number >= 40 GROUP BY 1)
      SELECT source, line_no, addr AS ip, coalesce(f.network, '192.0.2.64/25') AS network FROM shown LEFT JOIN fours f ON CAST(split_part(addr, '.', 4) AS INTEGER) BETWEEN f.low AND f.low + 3 WHERE addr IS NOT NULL""",
    "search_context": f"""{_CAP}, near AS (SELECT source, unnest(range(line_no - 2, line_no + 3)) AS line_no, line_no AS hit FROM hits),
      kept AS (SELECT n.source, n.line_no, bool_or(n.line_no = n.hit) AS is_match FROM near n JOIN lines l ON l.source = n.source AND l.line_no = n.line_no GROUP BY n.source, n.line_no),
      gaps AS (SELECT *, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY source ORDER BY line_no) = 1 THEN 0 ELSE 1 END AS gap FROM kept)
      SELECT source, line_no, is_match, CAST(sum(gap) OVER (PARTITION BY source ORDER BY line_no) AS BIGINT) AS block FROM gaps""",
    "search_stats": f"""{_LINES} SELECT source, max(line_no) AS lines_read, count(*) FILTER (WHERE contains(left(text, {LONGEST}), 'an')) AS matches, CAST(0 AS BIGINT) AS undated, count(*) FILTER (WHERE length(text) > {LONGEST}) AS truncated,
      false AS stopped_early FROM lines GROUP BY source""",
    "search_json": f"""WITH {_SHOWN}, texts AS (SELECT source, line_no, addr, moment, failed, failed AND CAST(split_part(addr, '.', 4) AS INTEGER) < 16 AS others, {LAB_TEXT} AS text FROM shown JOIN (SELECT event_id, ts, account, outcome, ip FROM lab) USING (event_id)),
      hits AS (SELECT source, line_no FROM texts WHERE others AND {_RANGE('2024-01-05 00:00:00', '2024-01-06 23:59:59.999999')}),
      near AS (SELECT DISTINCT source, unnest(range(line_no - 3, line_no + 4)) AS line_no FROM hits)
      SELECT source, line_no, '{{"source":"' || source || '","line_no":' || line_no || ',"is_match":' || CASE WHEN h.line_no IS NULL THEN 'false' ELSE 'true' END || ',"text":"' || text || '"}}' AS json
      FROM near JOIN texts USING (source, line_no) LEFT JOIN hits h USING (source, line_no)
      UNION ALL SELECT source, 0, '{{"source":"' || source || '","lines_read":' || max(line_no) || ',"matches":' || count(h.line_no) || ',"undated":' || count(*) FILTER (WHERE others AND moment IS NULL) || ',"stopped_early":false}}'
      FROM texts LEFT JOIN hits h USING (source, line_no) GROUP BY source""",
    "undated_lines": f"""WITH {_SHOWN} SELECT source, max(line_no) AS lines_read, count(*) FILTER (WHERE {_RANGE('2024-01-05 00:00:00', '2024-01-07 23:59:59.999999')}) AS matches,
      count(*) FILTER (WHERE moment IS NULL) AS undated, CAST(0 AS BIGINT) AS truncated, false AS stopped_early FROM shown GROUP BY source""",
}
