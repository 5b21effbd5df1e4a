"""Lines of CSV files joined to records, of which some span lines, and records taken apart into fields.

Whether a line begins inside a quoted field depends on all lines before it. But a line does one of four things to that
state: it leaves the field open or closed whatever it began with, turns the state round, or leaves it as it is. These
compose like running parities, so the lines of a chunk are worked through for themselves, the chunks before it (a row a
chunk) give the state in which it begins, and no task needs all lines of a file. Only lines with a quote matter, and of
them only what they do is moved, not their text.

A quote opens a field only at its start; inside, two quotes stand for one; what follows the closing quote up to the
comma belongs to the field as it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.scratch import scratch, stored

#: Lines that one task works through in order.
CHUNK = 100_000
#: Lines of a record whose text is kept; a longer one, and one that is never closed, counts as open.
MOST_LINES = 1_000
#: Lines of records that span lines that are broadcast, at most.
MOST_BROADCAST = 500_000

_INSIDE, _REST = r'(?:[^"]++|"")*+"', r"[^,]*+"
_FIELD = rf'(?:"{_INSIDE}{_REST}|[^",]{_REST})?+'
#: A line that ends outside of a quoted field if it begins outside, and if it begins inside of one.
CLOSED_FROM_OUTSIDE, CLOSED_FROM_INSIDE = rf"(?s)\A{_FIELD}(?:,{_FIELD})*+\z", rf"(?s)\A{_INSIDE}{_REST}(?:,{_FIELD})*+\z"
#: A field behind a comma; one that isn't closed takes all that follows.
FIELD = rf'(?s),("{_INSIDE}{_REST}|".*|[^",]{_REST}|)'


def fields_of(record: Column) -> Column:
    """The fields of a record as they are written, with their quotes."""
    return F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(FIELD), F.lit(1))


def field_value(field: Column) -> Column:
    """A field's value, without the quotes around it."""
    inner = F.regexp_extract(field, r'(?s)\A"((?:[^"]++|"")*+)', 1)
    rest = F.substring(field, F.char_length(inner) + 3, F.char_length(field))
    return F.when(F.startswith(field, F.lit('"')), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)).otherwise(field)


def _events(marks: DataFrame) -> DataFrame:
    """(source, chunk, line_no, opens, closes) of marks (source, chunk, line_no, after_out, after_in): where fields that go on are opened and closed.

    after_out, after_in: whether a field is open after the line if none, or one, is open before it.
    """
    order = Window.partitionBy("source", "chunk").orderBy("line_no")
    before, turns = order.rowsBetween(Window.unboundedPreceding, -1), F.col("after_out") & ~F.col("after_in")
    fixes = F.col("after_out") == F.col("after_in")
    rows = marks.withColumn("turns", turns.cast("int")).withColumn("fixes", fixes)
    rows = rows.withColumn("turned", F.coalesce(F.sum("turns").over(before), F.lit(0)))
    fixed = F.when(F.col("fixes"), F.struct(F.col("after_out").alias("open"), F.col("turned").alias("turned")))
    rows = rows.withColumn("fixed_here", fixed).withColumn("fixed", F.last("fixed_here", ignorenulls=True).over(before))
    odd = lambda n: F.pmod(n, F.lit(2)) == 1
    # the same again over the chunks of a source
    chunks = rows.groupBy("source", "chunk").agg(F.sum("turns").alias("turns"), F.max(F.when(F.col("fixes"), F.struct("line_no", "fixed_here")))["fixed_here"].alias("last"))
    chunks = chunks.withColumn("ends", F.when(F.col("last").isNotNull(), F.col("last.open") != odd(F.col("turns") - F.col("last.turned"))))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("total", F.coalesce(F.sum("turns").over(earlier), F.lit(0)))
    known = F.when(F.col("ends").isNotNull(), F.struct(F.col("ends").alias("open"), (F.col("total") + F.col("turns")).alias("total")))
    chunks = chunks.withColumn("known_here", known).withColumn("known", F.last("known_here", ignorenulls=True).over(earlier))
    begins = F.when(F.col("known").isNotNull(), F.col("known.open") != odd(F.col("total") - F.col("known.total"))).otherwise(odd(F.col("total")))
    rows = rows.join(chunks.select("source", "chunk", begins.alias("begins")), ["source", "chunk"])
    is_open = F.when(F.col("fixed").isNotNull(), F.col("fixed.open") != odd(F.col("turned") - F.col("fixed.turned"))).otherwise(F.col("begins") != odd(F.col("turned")))
    rows = rows.withColumn("open", is_open)
    return rows.select("source", "chunk", "line_no", (~F.col("open") & F.col("after_out")).alias("opens"), (F.col("open") & ~F.col("after_in")).alias("closes")).where("opens or closes")


def _spans(lines: DataFrame, path: str) -> DataFrame | None:
    """(source, first, last) of the records that span lines, last being null if the record is never closed; None if there are none. Stored."""
    text = F.col("text")
    marks = lines.where(F.contains(text, F.lit('"'))).select("source", "line_no", F.floor(F.col("line_no") / CHUNK).alias("chunk"), (~text.rlike(CLOSED_FROM_OUTSIDE)).alias("after_out"), (~text.rlike(CLOSED_FROM_INSIDE)).alias("after_in"))
    marks = stored(marks.where("after_out or not after_in"), f"{path}/marks")  # the others leave the state as it is
    if marks.where("after_out").isEmpty():  # no line opens a field that goes on
        return None
    events = stored(_events(marks), f"{path}/events")
    later = Window.partitionBy("source", "chunk").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = events.groupBy("source", "chunk").agg(F.min(F.when(F.col("closes"), F.col("line_no"))).alias("closed"))
    ahead = Window.partitionBy("source").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("source", "chunk", F.last("closed", ignorenulls=True).over(ahead).alias("beyond"))
    here = F.last(F.when(F.col("closes"), F.col("line_no")), ignorenulls=True).over(later)
    found = events.withColumn("here", here).where("opens").join(firsts, ["source", "chunk"])
    return stored(found.select("source", F.col("line_no").alias("first"), F.coalesce("here", "beyond").alias("last")), f"{path}/spans")


def csv_records(lines: DataFrame, joined_by: str = "\n", most_lines: int = MOST_LINES) -> DataFrame:
    """The records of numbered lines (source, line_no, text, others) of CSV files: text is the whole record, line_no its last line.

    More columns: first_line, and open: the record is never closed, or longer than most_lines lines. Of such a record
    the first most_lines lines are kept, and no further one is a record of its own; line_no is that of the last line
    kept. The other columns are those of the record's first line. Blank lines are records too. A source whose lines hold
    no quotes costs one look at each line.

    lines is read again for the records that span lines, whose lines alone are moved; store it if it is dear to make.
    """
    path = scratch(lines.sparkSession, "records")
    spans = _spans(lines, path)
    plain = lines.select("*", F.col("line_no").alias("first_line"), F.lit(False).alias("open"))
    if spans is None:
        return plain
    end = F.coalesce("last", F.col("first") + most_lines - 1)
    covered = spans.select("source", F.col("first").alias("of"), "last", F.explode(F.sequence("first", end)).alias("line_no"))
    covered = stored(covered, f"{path}/covered")
    count = covered.count()
    side = lambda df: F.broadcast(df) if count <= MOST_BROADCAST else df  # noqa: E731  there are fewer spans than lines of them
    keys = ["source", "line_no"]
    endless = spans.where("last is null").select("source", F.col("first").alias("endless_from"))  # the last record of its source
    alone = plain.join(side(covered.select(*keys)), keys, "left_anti").join(side(endless), "source", "left").where("endless_from is null or line_no < endless_from").drop("endless_from")
    others = [c for c in lines.columns if c not in ("source", "line_no", "text")]
    rows = lines.join(side(covered), keys).where(F.col("line_no") < F.col("of") + most_lines)
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    whole = rows.groupBy("source", "of").agg(
        parts.alias("parts"), F.max("last").alias("last"), F.max("line_no").alias("kept"), *[F.min_by(F.struct(F.col(f"`{c}`").alias("v")), "line_no")["v"].alias(c) for c in others]
    )
    is_open = F.col("last").isNull() | (F.col("last") > F.col("kept"))
    spanning = whole.select("source", F.col("kept").alias("line_no"), F.array_join(F.transform("parts", lambda p: p["text"]), joined_by).alias("text"), *others, F.col("of").alias("first_line"), is_open.alias("open"))
    return alone.unionByName(spanning)
