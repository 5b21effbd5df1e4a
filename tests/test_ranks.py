"""Exact numbers over ranges of rows, against sorting in plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import ranks


@pytest.mark.parametrize("most", [0, 100])
def test_numbers_in_groups_and_over_all(spark, monkeypatch, most):
    """Half of the rows in one group, nulls, rows that are equal; the counts by broadcast and by a shuffle."""
    monkeypatch.setattr(ranks, "MOST_BROADCAST", most)
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "b", None]), rng.randrange(40), k) for k in range(600)]
    rows = spark.createDataFrame(data, "kind string, size int, id int").repartition(5)
    found = ranks.numbered(rows, F.col("size").desc(), F.col("id"), groups=("kind",), name="place", total="of").collect()
    for kind in ("a", "b", None):
        own = sorted((-size, i) for k, size, i in data if k == kind)
        assert [(r["size"], r["id"], r["of"]) for r in sorted((r for r in found if r["kind"] == kind), key=lambda r: r["place"])] == [(-s, i, len(own)) for s, i in own]
    every = ranks.numbered(rows, F.col("size")).collect()
    assert sorted(r["rank"] for r in every) == list(range(1, 601)) and [r["size"] for r in sorted(every, key=lambda r: r["rank"])] == sorted(s for _, s, _ in data)


def test_equal_rows_and_no_rows(spark):
    rows = spark.range(1000).select(F.lit(1).alias("x"))
    assert sorted(r["rank"] for r in ranks.numbered(rows, F.col("x")).collect()) == list(range(1, 1001))
    assert ranks.numbered(rows.where("x = 2"), F.col("x"), total="n").collect() == []
