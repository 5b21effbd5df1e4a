"""JSON documents that hold one long list, cut into its elements by many tasks.

A document is read in pieces, each up to the next closing brace, so that Spark can split it anywhere. Whether a piece
begins inside a string is the parity of the quotes before it, and how deep it lies the sum of brackets outside strings;
both are running sums, made inside chunks of pieces and over the chunks (a row a chunk). Where a brace closes at the
depth of the list, an element ends; what stands between two such ends is an element, with the numbers, texts and lists
before it, and is parsed on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.scratch import scratch, stored
from emberlog.sources.lines import read_lines

#: Pieces that one task works through in order.
CHUNK = 50_000
_HEADS = {"list": r"(?s)\A﻿?\s*\[", "events": r'(?s)\A﻿?\s*\{\s*"events"\s*:\s*\['}
_TAILS = {"list": r"(?s)\]\s*\z", "events": r"(?s)\]\s*(\}\s*)?\z"}


def _running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows (source, chunk, no) with `name`: the sum of value over the rows of the source before each."""
    order = Window.partitionBy("source", "chunk").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_v", value)
    chunks = rows.groupBy("source", "chunk").agg(F.sum("_v").alias("_all"))
    chunks = chunks.select("source", "chunk", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    here = F.coalesce(F.sum("_v").over(order), F.lit(0))
    return rows.withColumn("_here", here).join(chunks, ["source", "chunk"]).withColumn(name, F.col("_before") + F.col("_here")).drop("_v", "_here", "_before")


def _depth(text: Column) -> Column:
    """Brackets that open less those that close in text without strings."""
    count = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    return count("{[") - count("]}")


def elements(spark: SparkSession, *paths: str, larger_than: int = 0) -> DataFrame:
    """(source, pos from 1, value variant): the elements of the documents (only files of more than `larger_than` bytes), each a list or an object whose one member is a list `events`.

    A document of another shape, or that isn't JSON, raises an error when it is read. The
    text is moved twice, to meet its numbers and to join an element's pieces; no task gets a whole document.
    """
    path = scratch(spark, "json")
    pieces = read_lines(spark, *paths, separator="}", larger_than=larger_than).select("source", F.col("line_no").alias("no"), "text")
    plain = F.regexp_replace("text", r"(?s)\\.", "")  # no escape goes over a brace
    quotes = F.char_length(plain) - F.char_length(F.replace(plain, F.lit('"')))
    outside = F.regexp_replace(plain, r'(?s)"[^"]*+("|\z)', "")
    inside = F.regexp_replace(F.regexp_replace(plain, r'(?s)\A[^"]*+("|\z)', ""), r'(?s)"[^"]*+("|\z)', "")
    marks = pieces.select("source", F.floor(F.col("no") / CHUNK).alias("chunk"), "no", quotes.alias("quotes"), _depth(outside).alias("if_outside"), _depth(inside).alias("if_inside"), *[F.col("text").rlike(h).alias(k) for k, h in _HEADS.items()])
    marks = stored(marks, f"{path}/marks")
    kinds = marks.where("no = 1").select("source", F.when(F.col("list"), "list").when(F.col("events"), "events").otherwise(F.raise_error(F.concat("source", F.lit(" holds no list of events")))).alias("kind"))
    kinds = stored(kinds, f"{path}/kinds")  # a row a file
    odd = lambda n: F.pmod(n, F.lit(2)) == 1
    rows = _running(marks.select("source", "chunk", "no", "quotes", "if_outside", "if_inside"), F.col("quotes"), "before")
    closes = ~odd(F.col("before") + F.col("quotes"))  # the brace behind the piece is none of a string
    rows = rows.withColumn("closes", closes).withColumn("change", F.when(odd(F.col("before")), F.col("if_inside")).otherwise(F.col("if_outside")) - closes.cast("int"))
    rows = stored(_running(rows.select("source", "chunk", "no", "closes", "change"), F.col("change"), "depth"), f"{path}/depths")
    base = F.when(F.col("kind") == "list", 1).otherwise(2)
    rows = rows.join(kinds, "source").withColumn("ends", (F.col("closes") & (F.col("depth") + F.col("change") == base)).cast("int"))
    rows = stored(_running(rows.select("source", "chunk", "no", "kind", "ends"), F.col("ends"), "segment"), f"{path}/segments")
    if cut := rows.groupBy("source").agg(F.max(F.struct("no", "ends")).alias("last")).where("last.ends = 1").first():  # nothing behind its last element
        raise ValueError(f"{cut['source']} is no JSON list of events")
    # merged, as the elements below: Spark may take a row a piece or an element for so small that it would send all of them through the driver
    joined = pieces.join(rows.select("source", "no", "kind", "ends", "segment").hint("merge"), ["source", "no"])
    parts = F.array_sort(F.collect_list(F.struct("no", "text")))
    texts = joined.groupBy("source", "segment").agg(F.first("kind").alias("kind"), F.max("ends").alias("whole"), F.array_join(F.transform(parts, lambda p: p["text"]), "}").alias("text"))
    # the last segment ends with the document, all others with an element's brace
    whole, kind = F.col("whole") == 1, F.col("kind")
    pick = lambda shapes, how: F.when(kind == "list", how(shapes["list"])).otherwise(how(shapes["events"]))
    bad_end = ~whole & ~pick(_TAILS, lambda t: F.col("text").rlike(t))
    text = F.when(whole, F.concat("text", F.lit("}"))).otherwise(pick(_TAILS, lambda t: F.regexp_replace("text", t, "")))
    first = F.col("segment") == 0
    text = F.when(first, pick(_HEADS, lambda h: F.regexp_replace(text, h, ""))).otherwise(text)
    texts = texts.withColumn("first", first).withColumn("bad", bad_end).withColumn("text", text)
    comma, rest = F.col("text").rlike(r"\A\s*,"), F.trim(F.regexp_replace("text", r"\A\s*,", ""))
    # behind the first segment a comma stands before each element, and an element behind each comma
    odd_comma = F.when(F.col("first"), comma).otherwise(comma == (F.regexp_replace(rest, r"\s+", "") == ""))
    parsed = F.try_parse_json(F.concat(F.lit("["), F.when(F.col("first"), F.col("text")).otherwise(rest), F.lit("]")))
    wrong = F.raise_error(F.concat("source", F.lit(" is no JSON list of events"))).cast("variant")
    texts = texts.select("source", "segment", F.when(F.col("bad") | odd_comma | parsed.isNull(), wrong).otherwise(parsed).alias("list"))
    texts = stored(texts, f"{path}/elements")
    each = spark.sql("select source, segment, pos, value from {texts}, lateral variant_explode(list)", texts=texts)
    counts = each.groupBy("source", "segment").agg(F.count("*").alias("n")).withColumn("chunk", F.floor(F.col("segment") / CHUNK)).withColumnRenamed("segment", "no")
    starts = _running(counts, F.col("n"), "start").select("source", F.col("no").alias("segment"), "start")
    return each.join(starts.hint("merge"), ["source", "segment"]).select("source", (F.col("start") + F.col("pos") + 1).alias("pos"), "value")
