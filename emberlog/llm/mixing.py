"""Mixing sources to target weights along a curriculum, with DataFrame operations only.

Targets: `share` of all words is split over the sources by weight; a target stops at `most` times its source's size
and the excess is reshared by weight. With sources ordered by the level at which they fill up (most * size / weight),
the first k of them are full, and the others get weight * (budget - what the full ones take) / (their weights).

Taking: the documents of a source stand in a fixed random order (MD5 of the id). The source is read from the start,
and again from the start, until its target is reached, so each document is taken whole, twice, or not at all, and one
document of each source is cut at the target.

Curriculum: a source's weight changes linearly over the training time t from 0 to 1, from `rise[0]` to `rise[1]` times
its mean. Integrated, that is the part of its target that is due by t; inverted, it gives a word's place in the
source's demand its training position. Rows are sorted by ranges of that position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.shared import WORD, document_columns, scratch, stored

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: Start and end of a source's schedule, in the same order: falling, level, rising. Each has mean 1.
RISES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def _cycle(rank: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def training_time(part: Column, rise: Column) -> Column:
    """The time by which `part` (0 to 1) of a source's target is due: the inverse of its integrated schedule.

    With weight a + (b - a) t and mean m = (a + b) / 2, part = (a t + (b - a) t^2 / 2) / m; this form of the root of
    the square equation also holds for a = b.
    """
    a, b = rise[0], rise[1]
    mean = (a + b) / 2
    return 2 * part * mean / (a + F.sqrt(F.greatest(a * a + 2 * (b - a) * part * mean, F.lit(0.0))))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(skey, source_size, weight, rank, target) of each source of sized (skey, size): a few rows, one a source."""
    sources = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy("skey"))).withColumn("weight", _cycle(F.col("rank"), weights).cast("bigint"))
    full = Window.orderBy(F.col("level"), F.col("skey")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("level"), F.col("skey")).rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("level", F.col("source_size").cast("double") * most / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("source_size").over(full), F.lit(0)) * F.lit(float(most)))
        .withColumn("weight_left", F.sum("weight").over(rest))
        # the water level if all sources before this one are full; the first that doesn't fill up at it sets it
        .withColumn("water", F.col("left") / F.col("weight_left"))
    )
    level = F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "skey", "water"))).over(every)["water"]
    capped = F.col("source_size").cast("double") * most
    return filled.withColumn("water", level).select("skey", "source_size", "weight", "rank", F.when(F.col("water").isNull(), capped).otherwise(F.least(F.col("weight") * F.col("water"), capped)).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, rises: tuple = RISES, share: float = 1.5, most: int = 2) -> DataFrame:
    """docs (doc_id, text, source) with size, source_size, target, taken, copies, positions, position and text_hash.

    size: words of the text (null text: 0). taken: words that the mix takes of the document, repeats counted, never
    over `most` times size. copies: passes through the document, the one that the target cuts included. positions:
    the training times of the first word in each; position: the first of them, null if nothing is taken. Sums of taken
    reach each target to the word. A null source is a source; null ids and repeated rows are documents of their own;
    further columns are ignored; an empty table gives no row.

    A source's running sums are made in 4096 buckets of the random order, so a source with most of the rows is dealt
    out like any other.
    """
    own = document_columns(docs, "doc_id", "text", "source")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = own.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), order.alias("key"))
    # '1' before a name and '2' for null: code point order with null last, and no null in a join's key
    sized = sized.withColumn("skey", F.when(F.col("source").isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), "source"))).withColumn("bucket", F.substring("key", 1, 3))
    sized = stored(sized, f"{scratch(docs.sparkSession, 'mixing')}/sized")  # read three times below, without the texts
    buckets = sized.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_start"))
    targets = source_targets(buckets.select("skey", F.col("bucket_size").alias("size")), weights, share, most)
    plan = starts.join(targets, "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(plan, ["skey", "bucket"])
    start, goal = F.col("bucket_start") + F.col("before"), F.floor(F.col("target") + F.lit(0.5))
    part = lambda p: F.greatest(F.least(goal - start - p * F.col("source_size"), F.col("size")), F.lit(0))
    passes = [part(p) for p in range(most)]
    taken, copies = sum(passes[1:], passes[0]), sum([(x > 0).cast("int") for x in passes[1:]], (passes[0] > 0).cast("int"))
    # the same source_size and rank hold for all copies, only the place in the source's demand differs
    rise = _cycle(F.col("rank"), tuple(F.array(*[F.lit(float(x)) for x in r]) for r in rises))
    places = [F.when(x > 0, training_time((start + p * F.col("source_size")) / F.col("target"), rise)) for p, x in enumerate(passes)]
    mixed = placed.withColumn("taken", taken.cast("bigint")).withColumn("copies", copies).withColumn("positions", F.filter(F.array(*places), lambda x: x.isNotNull())).withColumn("position", places[0])
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "positions", "position", "text_hash")


def training_order(mixed: DataFrame) -> DataFrame:
    """The rows sorted by ranges of their training position; those without one, last."""
    first = F.col("position").asc_nulls_last()
    return mixed.repartitionByRange(first, F.xxhash64("doc_id")).sortWithinPartitions(first, "doc_id")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them, in training order.

    A pass that the target cuts counts if at least half of the document is taken. Null and empty texts have no words
    and aren't taken. Rows of one id with different texts or sources are documents of their own; of rows that are the
    same in all three, the first as JSON stands for all, as often as they are taken together. A null source is a source. All columns
    come back, whatever their names. An empty table gives no row.
    """
    spark, key = docs.sparkSession, ["doc_id", "source", "text_hash"]
    whole = F.floor((F.col("taken") + F.col("size") / 2) / F.col("size"))
    chosen = stored(mix(docs).where("taken > 0").select(*key, F.slice("positions", 1, whole.cast("int")).alias("positions")), f"{scratch(spark, 'mixed')}/chosen")
    repeated = stored(chosen.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1").select(*key), f"{scratch(spark, 'mixed')}/repeated")
    rows = docs.select(F.struct("*").alias("row"), *[F.col(c).alias(f"own_{c}") for c in key[:2]], F.xxhash64("text").alias("own_text_hash"))
    own = [f"own_{c}" for c in key]
    same = [F.col(o).eqNullSafe(F.col(c)) for o, c in zip(own, key, strict=True)]
    if not repeated.isEmpty():
        one = rows.join(repeated, same, "left_semi").groupBy(*own).agg(F.min_by("row", F.to_json("row")).alias("row")).select("row", *own)
        rows = rows.join(repeated, same, "left_anti").select("row", *own).union(one)
    taken = rows.join(chosen, same).select("row", "own_doc_id", F.explode("positions").alias("position"))
    ordered = taken.repartitionByRange("position", F.xxhash64("own_doc_id")).sortWithinPartitions("position", "own_doc_id")
    return ordered.select(*[F.col("row")[c].alias(c) for c in docs.columns])
