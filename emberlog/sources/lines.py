"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.scratch import scratch, stored

LONGEST = 10_000
#: Blocks whose first line numbers are broadcast, at most (three numbers each); with more, lines and blocks are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: How Spark splits files into blocks depends on this; where it is unset, also on the executors that are there just then.
SPLITS = "spark.sql.files.minPartitionNum"


def _pinned(spark: SparkSession) -> None:
    """Gives SPLITS the value that it has by default now, so that executors that come or go change no block."""
    if spark.conf.get(SPLITS, None) is None:
        spark.conf.set(SPLITS, str(spark.sparkContext.defaultParallelism))


def read_lines(spark: SparkSession, *paths: str, folders: bool = False, separator: str | None = None, larger_than: int = -1) -> DataFrame:
    """(source, file_idx, line_no from 1, text) of text files; invalid UTF-8 bytes become U+FFFD.

    Spark splits files into blocks. A first pass counts the lines of each block and keeps a few numbers a block; the
    lines of the blocks before it give a block its first number. The second pass reads the files again and numbers them,
    so no text is written or moved, unless there are more than MOST_BROADCAST blocks. The splits are pinned (see
    SPLITS). If files or settings change between the passes, so that a line isn't where its block was counted, reading
    fails with an error and gives no wrong number.

    file_idx is the place of the file in the order of paths, then of names.

    folders: each path is a folder, and its files in the order of their names are the parts of one source. separator:
    what ends a line, if not a line break. larger_than: only files of more bytes are read.
    """
    _pinned(spark)
    file = F.col("_metadata.file_path")
    source = F.regexp_replace(file, "/[^/]*$", "") if folders else file
    block = [file, F.col("_metadata.file_block_start"), F.col("_metadata.file_size"), F.col("_metadata.file_modification_time")]
    # a block goes by two hashes: two of a million blocks share both with a chance below 10^-16, and then a line is out of range
    files = spark.read.text(list(paths), **({"lineSep": separator} if separator else {})).where(F.col("_metadata.file_size") > larger_than)
    read = files.select(
        F.make_valid_utf8("value").alias("text"), source.alias("source"), file.alias("file"), block[1].alias("block"), F.xxhash64(*block).alias("key"), F.hash(*block).alias("key2"), F.monotonically_increasing_id().alias("order")
    )
    counts = read.groupBy("source", "file", "block", "key", "key2").agg(F.count("*").alias("n"), F.min("order").alias("first"))
    counts = stored(counts, f"{scratch(spark, 'lines')}/blocks")
    before = Window.partitionBy("source").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    place = {p.rstrip("/").rsplit("/", 1)[-1]: k for k, p in reversed(list(enumerate(paths)))}  # equal names in several folders share a place
    given = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    rank = F.dense_rank().over(Window.orderBy(F.coalesce(F.try_element_at(given, F.element_at(F.split("source", "/"), -1)), F.lit(0)), "source")) - 1
    places = counts.select("source").distinct().withColumn("file_idx", rank)  # one row a file
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).join(places, "source").select("key", "key2", "file_idx", "start", "first", "n")
    if counts.count() <= MOST_BROADCAST:
        starts = F.broadcast(starts)
    inside = (F.col("order") >= F.col("first")) & (F.col("order") < F.col("first") + F.col("n"))
    moved = F.raise_error(F.concat(F.lit("the files or how they are split have changed since their lines were counted: "), "source")).cast("bigint")
    number = F.when(F.coalesce(inside, F.lit(False)), F.col("start") + F.col("order") - F.col("first")).otherwise(moved)
    return read.join(starts, ["key", "key2"], "left").select("source", "file_idx", number.alias("line_no"), "text")


def cut_lines(lines: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lines with text cut at `longest` characters and `truncated` saying whether it was."""
    return lines.withColumn("truncated", F.char_length("text") > longest).withColumn("text", F.left("text", F.lit(longest)))
