"""Failures over streams of events. Running counts are counting.counts_by on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_failures(events: DataFrame, key: str, window: str, slide: str, late: str) -> DataFrame:
    """(start, end, key, failures) of each sliding window; events later than `late` behind the newest are left out."""
    failures = events.where("outcome = 'failure'").withWatermark("ts", late)
    counted = failures.groupBy(F.window("ts", window, slide).alias("w"), F.col(key).alias("key")).agg(F.sum("n").alias("failures"))
    return counted.select("w.start", "w.end", "key", "failures")
