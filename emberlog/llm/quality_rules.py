"""Quality rules with adaptive thresholds for each language and source.

Each metric of a document is an integer. Its distribution in a group is kept as a quantile sketch of log-linear
buckets (values below 128 exactly, larger ones by their 7 leading bits, so within 1/64): counts of buckets. Sketches
merge by adding counts, so those of a language and of all documents come from those of the language's sources.

A group's fences are its quartiles, moved out by REACH times their distance (at least the metric's slack). Groups with
fewer than MIN_GROUP documents use their language's fences, and languages with fewer use those of all documents.
Fences rest on quartiles, so a group tolerates a quarter of junk; clean documents of an odd source set their own norm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.shared import scratch, stored
from emberlog.llm.textstats import with_counts

REACH = 3
MIN_GROUP = 200
#: Groups whose fences are broadcast, at most; tasks that share a group's rows if there are more groups.
MOST_BROADCAST, SALTS = 50_000, 64
#: Metric, its integer expression, its least quartile distance, and whether low values also count as odd.
METRICS = (
    ("word_length", "1000 * word_chars div greatest(n_words, 1)", 500, True),
    ("symbols", "1000000 * n_symbols div greatest(word_chars, 1)", 20_000, False),
    ("dup_lines", "1000000 * n_dup_lines div greatest(n_lines, 1)", 150_000, False),
    ("repeats", "1000000 * n_repeat_words div greatest(n_words, 1)", 150_000, False),
)
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def bucket(value: Column) -> Column:
    """The sketch's bucket of a non-negative integer."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return shift * 64 + F.floor(value / F.pow(F.lit(2), shift)).cast("bigint")


def bucket_value(b: Column) -> Column:
    """The smallest value of a bucket."""
    shift = F.greatest(F.floor(b / 64) - 1, F.lit(0))
    return ((b - shift * 64) * F.pow(F.lit(2), shift)).cast("bigint")


def fences(sketch: DataFrame, *group: str) -> DataFrame:
    """group, n and the fences low_<metric>, high_<metric> of sketch (group, metric, bucket, n), which is merged first."""
    merged = sketch.groupBy(*group, "metric", "bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*group, "metric").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*group, "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(every))
    value = bucket_value(F.col("bucket"))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), value))
    q = ranked.groupBy(*group, "metric").agg(F.max("total").alias("total"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    columns = [F.max("total").alias("n")]
    for k, (name, _, slack, _) in enumerate(METRICS):
        reach = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(slack))
        columns += [F.max(F.when(F.col("metric") == k, F.col("q1") - reach)).alias(f"low_{name}"), F.max(F.when(F.col("metric") == k, F.col("q3") + reach)).alias(f"high_{name}")]
    return q.groupBy(*group).agg(*columns)


def effective_fences(sketch: DataFrame) -> DataFrame:
    """(language, origin) with the fences that hold for the group: its own, its language's or all documents'."""
    sketch = sketch.withColumn("every", F.lit(0))
    own, by_language, all_docs = fences(sketch, "language", "origin"), fences(sketch, "language"), fences(sketch, "every")
    names = [f"{side}_{m[0]}" for m in METRICS for side in ("low", "high")]
    up = lambda df, level, key: df.select(key, *[F.col(c).alias(f"{level}_{c}") for c in ["n", *names]])
    joined = own.withColumn("every", F.lit(0)).join(up(by_language, "lang", "language"), "language").join(up(all_docs, "all", "every"), "every")
    pick = lambda c: F.when(F.col("n") >= MIN_GROUP, F.col(c)).when(F.col("lang_n") >= MIN_GROUP, F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}")).alias(c)
    return joined.select("language", "origin", *[pick(c) for c in names])


def with_limits(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows with the fences of their group (language, origin); rows of a group without any keep nulls.

    The fences are one row a group: broadcast if they are MOST_BROADCAST or fewer, else dealt to SALTS tasks a group.
    """
    if limits.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(limits), ["language", "origin"], "left")
    copies = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["language", "origin", "salt"], "left").drop("salt")


def apply_quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang, source): counts, base_failed, the metrics, their fences and kept.

    base_failed: the fixed rules (fewer than 50 words, or over half of them in repeated three-word windows). kept: not
    base_failed, and every metric within the fences of the document's language and source. Null text counts as empty;
    null language or source is a group of its own; further columns are ignored; an empty table gives no row.
    """
    counted = with_counts(docs, "doc_id", "lang", "source")
    keyed = counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("language"), F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("origin"),
        F.expr(BASE_FAILED).alias("base_failed"), *[F.expr(e).alias(name) for name, e, _, _ in METRICS],
    )
    rows = stored(keyed, f"{scratch(docs.sparkSession, 'quality-rules')}/counts")
    values = F.posexplode(F.array(*[F.col(m[0]) for m in METRICS])).alias("metric", "value")
    sketch = rows.where("not base_failed").select("language", "origin", values).groupBy("language", "origin", "metric", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))
    limits = effective_fences(stored(sketch, f"{scratch(docs.sparkSession, 'quality-rules')}/sketch"))
    within = F.lit(True)
    for name, _, _, both in METRICS:
        within &= (F.col(name) <= F.col(f"high_{name}")) & ((F.col(name) >= F.col(f"low_{name}")) if both else F.lit(True))
    joined = with_limits(rows, stored(limits, f"{scratch(docs.sparkSession, 'quality-rules')}/fences"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True))).drop("language", "origin")
