"""Security events from JSON documents, JSON lines and CSV, validated row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.columns import settled
from emberlog.functions.ip import normalize_ip
from emberlog.functions.time import iso_error, iso_timestamp
from emberlog.schemas import SEVERITIES, SEVERITY_ALIASES
from emberlog.scratch import scratch, stored
from emberlog.settings import BurstSettings
from emberlog.sources.documents import elements
from emberlog.sources.lines import read_lines
from emberlog.sources.records import csv_records, field_value, fields_of

LIMITS = {"title": 200, "source": 100, "description": 2000, "user": 100}
REQUIRED = ("timestamp", "severity", "title")
FIELDS = (*REQUIRED, "source", "description", "ip", "user")
FORMATS = {".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv"}
BLANKS = " \t\n\r\x0b\x0c"
#: Bytes of a JSON document from which on it is cut into its elements.
SPLIT_ABOVE = 32 << 20
#: Files whose headers are broadcast, at most.
MOST_BROADCAST = 100_000


def event_format(path: str) -> str:
    """json, jsonl or csv by the file's suffix; others raise ValueError."""
    suffix = "." + path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unknown event format: {path}")
    return FORMATS[suffix]


def _name(source: Column) -> Column:
    return F.element_at(F.split(source, "/"), -1)


def load_jsonl(spark: SparkSession, *paths: str) -> DataFrame:
    """(origin, row variant, bad): a row for each line that isn't blank; bad says why there is no row."""
    lines = read_lines(spark, *paths).where(F.trim("text") != "")
    row = F.try_parse_json("text")
    return lines.select(F.concat(_name(F.col("source")), F.lit(":"), "line_no").alias("origin"), row.alias("row"), F.when(row.isNull(), "invalid JSON").alias("bad"))


def load_alerts(spark: SparkSession, *paths: str, settings: BurstSettings = BurstSettings()) -> DataFrame:
    """Rows of alerts in JSON lines, as bursts.alerts_json gives them, as events of that severity at the burst's first failure.

    settings: tells by which rules a key is an address. The description is the explanation up to the length that events
    may have, which may end with a blank (see `exact` of validated). A line that is no JSON is bad, and so is one without
    a rule, a key and a time.
    """
    lines = load_jsonl(spark, *paths)
    text = lambda c: F.try_variant_get("row", f"$.{c}", "string")
    told = F.array_join(F.try_variant_get("row", "$.explanation", "array<string>"), " ")
    by_ip = [r.name for r in settings.all_rules() if r.key == "ip"]
    of_ip = text("rule").isin(*by_ip) if by_ip else F.lit(False)
    title = F.concat(F.lit("Failed logins in a burst, rule "), text("rule"), F.lit(": "), text("failures"))
    event = F.struct(
        text("first_seen").alias("timestamp"), text("severity").alias("severity"), title.alias("title"), F.lit("logins").alias("source"), F.left(told, F.lit(LIMITS["description"])).alias("description"),
        F.when(of_ip, text("key")).alias("ip"), F.when(~of_ip, text("key")).alias("user"),
    )
    no_alert = text("rule").isNull() | text("key").isNull() | text("first_seen").isNull()
    return lines.select("origin", F.parse_json(F.to_json(event)).alias("row"), F.coalesce("bad", F.when(no_alert, "not an alert")).alias("bad"))


def load_json(spark: SparkSession, *paths: str, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Rows of JSON documents: a list, or an object with a list under `events`. Another document raises an error when it is read.

    A document of up to split_above bytes is one task's. A larger one is cut into its elements by many tasks (see
    elements); it must be a list, or an object with `events` alone.
    """
    small = spark.read.text(list(paths), wholetext=True).where(F.col("_metadata.file_size") <= split_above)
    text = small.select(_name(F.col("_metadata.file_path")).alias("name"), F.try_parse_json(F.regexp_replace("value", "^\ufeff", "")).alias("doc"))
    kind = lambda c: F.substring(F.schema_of_variant(c), 1, 5)
    inner = F.try_variant_get("doc", "$.events", "variant")
    rows = F.when(kind(inner) == "ARRAY", inner).when(kind(F.col("doc")) == "ARRAY", F.col("doc"))
    checked = text.withColumn("list", F.when(rows.isNull(), F.raise_error(F.concat("name", F.lit(" holds no list of events")))).otherwise(rows))
    each = spark.sql("select name, pos + 1 as pos, value from {documents}, lateral variant_explode(list)", documents=checked)
    if not spark.read.text(list(paths), lineSep="}").where(F.col("_metadata.file_size") > split_above).isEmpty():
        each = each.union(elements(spark, *paths, larger_than=split_above).select(_name(F.col("source")), "pos", "value"))
    return each.select(F.concat("name", F.lit("["), F.col("pos").cast("string"), F.lit("]")).alias("origin"), F.col("value").alias("row"), F.lit(None).cast("string").alias("bad"))


def load_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of CSV files with a header, whose records may span lines (see csv_records); a file without the needed columns raises ValueError.

    origin has the record's last line; the lines of a field are joined without a break. Short rows, and records that are
    never closed, are bad; surplus fields are ignored; of equal names in the header the last counts. Empty lines are no
    rows. Each file goes by its own header, a row a file that is joined to its records.
    """
    lines = read_lines(spark, *paths)
    head = F.transform(fields_of(F.regexp_replace("text", "^\ufeff", "")), field_value)
    heads = lines.where("line_no = 1").select(F.col("source").alias("_file"), head.alias("_names"))
    last = lambda c: F.size("_names") + 1 - F.array_position(F.reverse("_names"), c)  # noqa: E731  size + 1 if it is missing
    heads = stored(heads.select("_file", *[last(c).cast("int").alias(f"_at_{c}") for c in FIELDS], F.size("_names").alias("_width")), f"{scratch(spark, 'headers')}/found")
    missing = F.array_compact(F.array(*[F.when(F.col(f"_at_{c}") > F.col("_width"), F.lit(c)) for c in REQUIRED]))
    if bad := heads.select("_file", missing.alias("missing")).where(F.size("missing") > 0).first():
        raise ValueError(f"columns missing in {bad['_file']}: {', '.join(bad['missing'])}")
    records = csv_records(lines, joined_by="").where((F.col("first_line") > 1) & (F.col("text") != ""))
    side = F.broadcast(heads) if heads.count() <= MOST_BROADCAST else heads
    rows = settled(records.join(side, F.col("source") == F.col("_file")), _fields=fields_of(F.col("text")))
    short = F.size("_fields") < F.col("_width")
    wanted = [F.when(F.col(f"_at_{c}") <= F.col("_width"), field_value(F.get("_fields", F.col(f"_at_{c}") - 1))).alias(c) for c in FIELDS]
    bad = F.when(F.col("open"), "quoted field without an end").when(short, "fewer columns than the header")
    return rows.select(F.concat(_name(F.col("source")), F.lit(":"), "line_no").alias("origin"), F.when(bad.isNull(), F.parse_json(F.to_json(F.struct(*wanted)))).alias("row"), bad.alias("bad"))


def load_events(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of files in any of the formats, by their suffixes."""
    out = None
    for path in paths:
        rows = {"json": load_json, "jsonl": load_jsonl, "csv": load_csv}[event_format(path)](spark, path)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no file is given")
    return out


def normalize_severity(text: Column) -> Column:
    """The severity that a name stands for, null if it stands for none."""
    name = F.lower(F.btrim(text, F.lit(BLANKS)))
    alias = F.try_element_at(F.create_map(*[F.lit(x) for pair in SEVERITY_ALIASES.items() for x in pair]), name)
    own = F.coalesce(alias, name)
    return F.when(own.isin(*SEVERITIES), own)


def validated(rows: DataFrame, zone: str = "UTC", exact: tuple[str, ...] = ()) -> DataFrame:
    """rows (origin, row variant, bad) with the columns of SECURITY_EVENT and reason: null if the row is valid.

    zone: of timestamps without an offset. exact: text fields that keep the blanks at their ends, which the others lose.
    A number as text is as Spark writes it (a title 1.0 is `1`).

    The first check that fails gives the reason: an object, required fields, each text field's type and length, the
    title, the severity, the timestamp, the address.
    """
    kind = {c: F.regexp_extract(F.schema_of_variant(F.try_variant_get("row", f"$.{c}", "variant")), r"^\w+", 0) for c in FIELDS}
    text = {c: F.try_variant_get("row", f"$.{c}", "string") for c in FIELDS}
    out = settled(rows, **{f"k_{c}": F.coalesce(k, F.lit("VOID")) for c, k in kind.items()}, **{f"v_{c}": F.coalesce(t, F.lit("")) for c, t in text.items()}, k_row=F.regexp_extract(F.schema_of_variant("row"), r"^\w+", 0))
    strip = lambda c: F.btrim(F.col(f"v_{c}"), F.lit(BLANKS))
    own = lambda c: F.col(f"v_{c}") if c in exact else strip(c)
    is_kind = lambda c, *kinds: F.col(f"k_{c}").isin(*kinds)
    absent = lambda c: is_kind(c, "VOID") | (is_kind(c, "STRING") & (F.col(f"v_{c}") == ""))
    numbers = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "TINYINT", "SMALLINT")
    out = settled(out, ts=iso_timestamp(F.col("v_timestamp"), zone), severity=normalize_severity(F.col("v_severity"))).withColumn("address", normalize_ip(F.col("v_ip"), brackets=False))
    checks = [(F.col("bad").isNotNull(), F.col("bad")), (F.coalesce(F.col("k_row"), F.lit("")) != "OBJECT", F.lit("not an object"))]
    names = F.concat_ws(", ", *[F.when(absent(c), F.lit(c)) for c in REQUIRED])
    checks.append((names != "", F.concat(F.lit("missing fields: "), names)))
    for c in ("title", "source", "description", "user"):
        checks.append((~is_kind(c, "VOID", "STRING", *numbers), F.lit(f"{c} isn't text")))
        checks.append((F.char_length(own(c)) > LIMITS[c], F.lit(f"{c} is longer than {LIMITS[c]} characters")))
    checks += [
        (strip("title") == "", F.lit("blank title")),
        (~is_kind("severity", "STRING"), F.lit("severity isn't text")),
        (F.col("severity").isNull(), F.lit("unknown severity")),
        (~is_kind("timestamp", "STRING"), F.lit("timestamp isn't text")),
        (F.col("ts").isNull(), iso_error(F.col("v_timestamp"), F.col("ts"))),
        (~absent("ip") & F.col("address").isNull(), F.lit("invalid address")),
    ]
    reason = F.lit(None).cast("string")
    for fails, why in reversed(checks):
        reason = F.when(fails, why).otherwise(reason)
    return out.select("origin", reason.alias("reason"), "ts", "severity", own("title").alias("title"), own("source").alias("source"), own("description").alias("description"), F.coalesce("address", F.lit("")).alias("ip"), own("user").alias("user"))


def valid_events(checked: DataFrame) -> DataFrame:
    return checked.where("reason is null").drop("reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where("reason is not null").select("origin", "reason")


def load_stats(checked: DataFrame) -> DataFrame:
    """One row: rows read, valid and rejected."""
    return checked.agg(F.count("*").alias("rows_read"), F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
