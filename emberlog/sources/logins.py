"""Login logs in three formats, parsed to one row for each line.

Every parser takes lines (text, source, line_no and any other columns) and returns them with status (`event`,
`ignored` or `unparsed`), reason, and the columns of LOGIN_EVENT; n is the number of equal attempts that the line
stands for. No line is dropped. Of several reasons, the first check that fails gives it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.columns import settled
from emberlog.functions.ip import normalize_ip
from emberlog.functions.text import shortened
from emberlog.functions.time import NONEXISTENT, iso_error, iso_timestamp, month_number, syslog_timestamp
from emberlog.schemas import EMPTY_USER
from emberlog.scratch import scratch, stored
from emberlog.settings import ParseSettings
from emberlog.sources.lines import read_lines
from emberlog.sources.records import csv_records, field_value, fields_of

#: One attempt as sshd reports it: how it ended, whether the account is unknown, the account, the address.
VERB = r"(Accepted|Failed) \S+ for"
ATTEMPT = rf"^{VERB} (invalid user )?(\S*) from (\S+) port \d"
#: What syslog writes in place of equal messages that follow each other.
REPEATED = r"^message repeated (\d+) times: \[(.*)\]$"
SSH_PROCESSES = ("sshd", "sshd-session")
MOST_REPEATS = 10_000
DETECTION_LINES = 50
#: Files whose CSV headers are broadcast, at most.
MOST_BROADCAST = 100_000
CSV_COLUMNS = ("timestamp", "user", "ip", "result")
BLANKS = " \t\n\r\x0b\x0c"

BAD_IP = "invalid address"


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _first_reason(*checks: tuple[Column, Column | str]) -> Column:
    """The reason of the first check that is true, else null. A check that is null doesn't hold."""
    out = F.lit(None).cast("string")
    for fails, reason in reversed(checks):
        out = F.when(fails, reason if isinstance(reason, Column) else F.lit(reason)).otherwise(out)
    return out


def _finish(lines: DataFrame, own: list[str], ignored: Column, reason: Column, **event: Column) -> DataFrame:
    """lines with status and reason, and event's columns where there is an event."""
    status = F.when(ignored, "ignored").when(reason.isNotNull(), "unparsed").otherwise("event")
    out = lines.withColumn("status", status).withColumn("reason", F.when(F.col("status") == "unparsed", reason))
    is_event = F.col("status") == "event"
    return out.select(*own, "status", "reason", *[F.when(is_event, c).alias(k) for k, c in event.items()])


def kv_value(tokens: Column, key: str) -> Column:
    """The value of the last of the key=value tokens with this key, in any case; empty if there is none."""
    own = F.filter(tokens, lambda t: F.lower(F.substring_index(t, "=", 1)) == key)
    return F.coalesce(F.substring(F.try_element_at(own, F.lit(-1)), len(key) + 2, 1 << 30), F.lit(""))


def kv_map(fields: Column) -> Column:
    """All key=value tokens as a map with lower-case keys; of equal keys the last counts."""
    tokens = F.filter(F.split(_stripped(fields), r"\s+"), lambda t: t.rlike("^[^=]+="))
    keys, values = F.transform(tokens, lambda t: F.lower(F.substring_index(t, "=", 1))), F.transform(tokens, lambda t: F.regexp_replace(t, r"^[^=]*=", ""))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v"), F.transform(keys, lambda _, i: i).alias("i")), lambda e: e["i"] == F.size(keys) - F.array_position(F.reverse(keys), e["k"]).cast("int"))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def _is_lab(words: Column) -> Column:
    return F.coalesce(F.get(words, F.lit(1)).rlike("^LOGIN_[A-Z_]+$"), F.lit(False))


def _header(text: Column) -> tuple[Column, Column, Column, Column]:
    """Of a syslog line: its words if the header is traditional (month, day, time, host, rest) and if it's ISO (moment, host, rest), and whether it is."""
    old, iso = F.split(text, r"\s+", 5), F.split(text, r"\s+", 3)
    is_iso = (F.size(iso) == 3) & F.get(iso, F.lit(0)).rlike(r"^\d{4}-\d\d-\d\dT.")
    shapes = ("^[A-Z][a-z]{2}$", r"^\d{1,2}$", r"^\d\d:\d\d:\d\d$")
    is_old = F.size(old) == 5
    for k, shape in enumerate(shapes):
        is_old &= F.get(old, F.lit(k)).rlike(shape)
    return old, iso, is_old, is_iso


def parse_lab(lines: DataFrame, settings: ParseSettings = ParseSettings()) -> DataFrame:
    """`<ISO timestamp> LOGIN_SUCCESS|LOGIN_FAILURE user=<u> ip=<ip> [key=value ...]`; blank lines and # are ignored."""
    own, t = lines.columns, F.col("_t")
    rows = settled(lines, _t=_stripped(F.col("text")))
    rows = settled(rows, _words=F.split("_t", r"\s+"))
    rows = settled(rows, _when=F.get("_words", F.lit(0)), _what=F.when(_is_lab(F.col("_words")), F.get("_words", F.lit(1))).otherwise(""), _fields=F.slice("_words", 3, 1 << 20))
    rows = settled(rows, _user=kv_value(F.col("_fields"), "user"), _raw=kv_value(F.col("_fields"), "ip"), _ts=iso_timestamp(F.col("_when"), settings.zone)).withColumn("_ip", normalize_ip(F.col("_raw")))
    no_user, no_ip = F.col("_user") == "", F.col("_raw") == ""
    reason = _first_reason(
        (F.col("_what") == "", "not a lab line"),
        (~F.col("_what").isin("LOGIN_SUCCESS", "LOGIN_FAILURE"), "unknown event"),
        (F.exists("_fields", lambda f: F.instr(f, "=") < 2), "field without key=value"),
        (no_user | no_ip, F.concat(F.lit("missing "), F.concat_ws(", ", F.when(no_user, F.lit("user=")), F.when(no_ip, F.lit("ip="))))),
        (F.col("_ts").isNull(), iso_error(F.col("_when"), F.col("_ts"))),
        (F.col("_ip").isNull(), BAD_IP),
    )
    outcome = F.when(F.col("_what") == "LOGIN_SUCCESS", "success").otherwise("failure")
    return _finish(rows, own, (t == "") | t.startswith("#"), reason, ts=F.col("_ts"), user=F.col("_user"), ip=F.col("_ip"), outcome=outcome, invalid_user=F.lit(False), n=F.lit(1))


def parse_syslog(lines: DataFrame, settings: ParseSettings = ParseSettings()) -> DataFrame:
    """OpenSSH's auth.log with ISO or traditional headers. Only outcomes of login attempts are events.

    Header errors come before the choice of the process, and a repeat count out of range before the test for a login.
    """
    own, t, get = lines.columns, F.col("_t"), lambda words, k: F.get(words, F.lit(k))
    rows = settled(lines, _t=_stripped(F.col("text")))
    old, iso, is_old, is_iso = _header(t)
    rows = settled(rows, _iso=F.when(is_iso, get(iso, 0)), _old=F.when(is_old & ~is_iso, old), _rest=F.when(is_iso, get(iso, 2)).when(is_old, get(old, 4)))
    is_iso, old = F.col("_iso").isNotNull(), F.col("_old")
    at = F.when(is_iso, iso_timestamp(F.col("_iso"), settings.zone)).otherwise(syslog_timestamp(get(old, 0), get(old, 1), get(old, 2), settings.year, settings.zone))
    tag = F.substring_index("_rest", ":", 1)  # the program, perhaps with its number in brackets
    rows = settled(rows, _ts=at, _process=F.when(F.contains("_rest", F.lit(":")), F.regexp_replace(tag, r"\[\d+\]$", "")).otherwise(""), _said=_stripped(F.expr("substring(_rest, instr(_rest, ':') + 1)")))
    rows = settled(rows, _times=F.regexp_extract("_said", REPEATED, 1))
    is_repeat = F.col("_times") != ""
    rows = settled(rows, _said=F.when(is_repeat, _stripped(F.regexp_extract("_said", REPEATED, 2))).otherwise(F.col("_said")), _n=F.when(is_repeat, F.col("_times").try_cast("int")).otherwise(1))
    said, part = F.col("_said"), lambda k: F.regexp_extract("_said", ATTEMPT, k)
    rows = settled(rows, _verb=part(1), _unknown=part(2) != "", _account=part(3), _raw=part(4))
    accepted = (F.col("_verb") == "Accepted") & ~F.col("_unknown") & (F.col("_account") != "")
    rows = settled(rows, _ok=accepted, _failed=F.col("_verb") == "Failed").withColumn("_ip", normalize_ip(F.when(F.col("_verb") != "", F.col("_raw"))))
    user = F.when(F.col("_account") == "", EMPTY_USER).otherwise(F.col("_account"))
    no_header = ~is_iso & old.isNull()
    bad_header = no_header | F.col("_ts").isNull()
    other = ~F.col("_process").isin(*SSH_PROCESSES)
    bad_repeat = F.coalesce(~F.col("_n").between(1, MOST_REPEATS), F.lit(True))
    reason = _first_reason(
        (no_header, "no syslog header"),
        (is_iso & F.col("_ts").isNull(), iso_error(F.col("_iso"), F.col("_ts"))),
        (~is_iso & month_number(get(old, 0)).isNull(), "unknown month"),
        (F.col("_ts").isNull(), NONEXISTENT),
        (bad_repeat, "repeat count out of range"),
        (~F.col("_ok") & ~F.col("_failed"), "incomplete login message"),
        (F.col("_ip").isNull(), BAD_IP),
    )
    ignored = (t == "") | (~bad_header & (other | (~bad_repeat & ~said.rlike(rf"^{VERB}\b"))))
    invalid = F.col("_failed") & F.col("_unknown")
    return _finish(rows, own, ignored, reason, ts=F.col("_ts"), user=user, ip=F.col("_ip"), outcome=F.when(F.col("_ok"), "success").otherwise("failure"), invalid_user=invalid, n=F.col("_n"))


def parse_csv_row(rows: DataFrame, settings: ParseSettings = ParseSettings(), unclosed: Column | None = None) -> DataFrame:
    """Rows with the text columns of CSV_COLUMNS (null or blank: empty), parsed like lines; those that are `unclosed` are unparsed."""
    own = [c for c in rows.columns if c not in CSV_COLUMNS]
    value = {c: F.coalesce(_stripped(F.col(c)), F.lit("")) for c in CSV_COLUMNS}
    rows = settled(rows, **{f"_{c}": x for c, x in value.items()})
    rows = settled(rows, _ts=iso_timestamp(F.col("_timestamp"), settings.zone)).withColumn("_address", normalize_ip(F.col("_ip")))
    empty = [F.when(F.col(f"_{c}") == "", F.lit(c)) for c in CSV_COLUMNS]
    outcome = F.lower("_result")
    reason = _first_reason(
        (F.lit(False) if unclosed is None else unclosed, "quoted field without an end"),
        (F.concat_ws(", ", *empty) != "", F.concat(F.lit("empty columns: "), F.concat_ws(", ", *empty))),
        (~outcome.isin("success", "failure"), "unknown result"),
        (F.col("_ts").isNull(), iso_error(F.col("_timestamp"), F.col("_ts"))),
        (F.col("_address").isNull(), BAD_IP),
    )
    return _finish(rows, own, F.lit(False), reason, ts=F.col("_ts"), user=F.col("_user"), ip=F.col("_address"), outcome=outcome, invalid_user=F.lit(False), n=F.lit(1))


def parse_csv(lines: DataFrame, settings: ParseSettings = ParseSettings()) -> DataFrame:
    """CSV records, which may span lines (see csv_records). The first record of each source is its header, whose names count in any case and without blanks.

    Of equal names the last counts; further columns are ignored; fields that a record lacks are empty. line_no is the
    record's last line. Empty lines and the header aren't rows. A record that is never closed, or of too many lines, is
    unparsed. A source without the needed columns raises ValueError.

    A source's header says at which places its columns stand: a row a source, joined to its records, so all sources are
    read in one pass, whatever their headers.
    """
    own = lines.columns
    records = csv_records(lines)
    head = F.transform(fields_of(F.regexp_replace("text", "^\ufeff", "")), lambda f: F.lower(_stripped(field_value(f))))
    heads = lines.where("line_no = 1").select(F.col("source").alias("_file"), head.alias("_names"))
    last = lambda c: F.size("_names") + 1 - F.array_position(F.reverse("_names"), c)  # noqa: E731  size + 1 if it is missing
    heads = stored(heads.select("_file", *[last(c).cast("int").alias(f"_at_{c}") for c in CSV_COLUMNS], F.size("_names").alias("_width")), f"{scratch(lines.sparkSession, 'headers')}/found")
    missing = F.array_compact(F.array(*[F.when(F.col(f"_at_{c}") > F.col("_width"), F.lit(c)) for c in CSV_COLUMNS]))
    if bad := heads.select("_file", missing.alias("missing")).where(F.size("missing") > 0).first():
        raise ValueError(f"{bad['_file']}: columns missing in the header: {', '.join(bad['missing'])}")
    count = heads.count()
    if not count:
        raise ValueError("the file is empty or has no header")
    side = F.broadcast(heads) if count <= MOST_BROADCAST else heads  # a row a file
    rows = records.where((F.col("first_line") > 1) & (F.col("text") != "")).join(side, F.col("source") == F.col("_file"))
    rows = settled(rows, _fields=fields_of(F.col("text")))
    rows = rows.select(*own, F.col("open").alias("_open"), *[field_value(F.get("_fields", F.col(f"_at_{c}") - 1)).alias(c) for c in CSV_COLUMNS])
    return parse_csv_row(rows, settings, unclosed=F.col("_open")).drop("_open")


Parser = Callable[[DataFrame, ParseSettings], DataFrame]
PARSERS: dict[str, Parser] = {"lab": parse_lab, "syslog": parse_syslog, "csv": parse_csv}


def _looks(stripped: Column) -> Column:
    """lab or syslog if a line looks like it, null for others, blank lines and comments."""
    usable = (stripped != "") & ~stripped.startswith("#")
    _, _, is_old, is_iso = _header(stripped)
    return F.when(usable & _is_lab(F.split(stripped, r"\s+")), "lab").when(usable & (is_iso | is_old), "syslog")


def detect_formats(lines: DataFrame) -> DataFrame:
    """(source, fmt): csv by the file's name, else by the first of the first lines that looks like lab or syslog, else null."""
    head = lines.where((F.col("line_no") <= DETECTION_LINES)).withColumn("_t", _stripped(F.col("text")))
    seen = head.withColumn("_f", _looks(F.col("_t"))).groupBy("source").agg(F.min_by("_f", F.when(F.col("_f").isNotNull(), F.col("line_no"))).alias("_f"))
    return seen.select("source", F.when(F.lower("source").endswith(".csv"), "csv").otherwise(F.col("_f")).alias("fmt"))


def load_events(lines: DataFrame, formats: DataFrame | None = None, settings: ParseSettings = ParseSettings(), more: dict[str, Parser] | None = None) -> DataFrame:
    """Lines of sources in any format, each parsed by its own; adds fmt. A source that no format fits raises ValueError.

    formats: (source, fmt), found by detect_formats if it isn't given. more: parsers of formats of one's own, by their
    names in formats; each takes lines and settings and returns them with the columns that the other parsers return.
    """
    parsers = PARSERS | (more or {})
    if formats is None:
        formats = stored(detect_formats(lines), f"{scratch(lines.sparkSession, 'formats')}/found")  # a row a source, read for each format
    if unknown := [r["source"] for r in formats.where("fmt is null").limit(10).collect()]:
        raise ValueError(f"unknown format: {', '.join(unknown)}")
    kinds = sorted(r["fmt"] for r in formats.select("fmt").distinct().limit(len(parsers) + 1).collect())
    if odd := [k for k in kinds if k not in parsers]:
        raise ValueError(f"no parser of the format: {', '.join(odd)}")
    tagged = lines.join(formats, "source")
    out = None
    for kind in kinds:
        parsed = parsers[kind](tagged.where(F.col("fmt") == kind), settings)
        out = parsed if out is None else out.unionByName(parsed)
    if out is None:
        raise ValueError("there are no lines")
    return out


def load_files(spark: SparkSession, *paths: str, settings: ParseSettings = ParseSettings()) -> DataFrame:
    """load_events of files: their formats are found in one look at the beginnings of files, and each file is numbered and parsed with those of its format only.

    Of a file's first DETECTION_LINES lines only those in its first block count. file_idx is the place of the path that
    the file was found by, then of its name, among all files. The formats, a row a file, are collected.
    """
    file, text = F.col("_metadata.file_path"), F.make_valid_utf8("value")
    first = spark.read.text(list(paths)).where(F.col("_metadata.file_block_start") == 0).select(file.alias("source"), _stripped(text).alias("_t"), F.monotonically_increasing_id().alias("order"))
    looks = _looks(F.col("_t"))
    seen = first.groupBy("source").agg(F.min("order").alias("begin"), F.min(F.when(looks.isNotNull(), F.struct("order", looks.alias("fmt")))).alias("found"))
    fmt = F.when(F.lower("source").endswith(".csv"), "csv").when(F.col("found.order") < F.col("begin") + DETECTION_LINES, F.col("found.fmt"))
    formats = [(r["source"], r["fmt"]) for r in seen.select("source", fmt.alias("fmt")).collect()]
    if unknown := sorted(source for source, kind in formats if kind is None)[:10]:
        raise ValueError(f"unknown format: {', '.join(unknown)}")
    place = {p.rstrip("/").rsplit("/", 1)[-1]: k for k, p in reversed(list(enumerate(paths)))}
    order = sorted(source for source, _ in formats)
    order = {source: k for k, source in enumerate(sorted(order, key=lambda x: (place.get(x.rsplit("/", 1)[-1], 0), x)))}
    out = None
    for kind, parse in PARSERS.items():
        own = sorted((source for source, k in formats if k == kind), key=order.__getitem__)
        if own:
            numbers = spark.createDataFrame([(source, order[source]) for source in own], "source string, file_idx int")
            lines = read_lines(spark, *own).drop("file_idx").join(F.broadcast(numbers), "source").withColumn("fmt", F.lit(kind))
            parsed = parse(lines, settings)
            out = parsed if out is None else out.unionByName(parsed)
    if out is None:
        raise ValueError("there are no lines")
    return out


def login_events(parsed: DataFrame) -> DataFrame:
    """The events of parsed lines, with the line's columns."""
    return parsed.where("status = 'event'").drop("status", "reason", "text")


def expand_repeats(events: DataFrame) -> DataFrame:
    """n rows for an event of n equal attempts; repeat counts from 1."""
    return events.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("n", F.lit(1))


def unparsed_lines(parsed: DataFrame) -> DataFrame:
    """(source, line_no, reason, text) of the lines that couldn't be parsed; long texts are shortened."""
    return parsed.where("status = 'unparsed'").select("source", "line_no", "reason", shortened(F.col("text")).alias("text"))
