"""Case folding against Python, and the size of the code that Spark generates for parsers."""

from __future__ import annotations

import re
import sys

import pytest
from pyspark.sql import functions as F

from emberlog.functions.text import casefold
from emberlog.operators import search
from emberlog.plans import registry


def test_casefold_of_every_character(spark):
    own = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(own[k : k + 64]) for k in range(0, len(own), 64)] + ["Straße ΣΑΣ ς İI ﬁN", "", "plain ASCII"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", casefold(F.col("t")).alias("f"))
    assert all(r["f"] == texts[r["k"]].casefold() for r in rows.collect())


def test_search_folds_sharp_s_and_sigma(spark):
    lines = spark.createDataFrame([("a", 1, "die STRASSE"), ("a", 2, "die Straße"), ("a", 3, "ΟΔΟΣ"), ("a", 4, "οδος"), ("a", 5, "strase")], "source string, line_no bigint, text string")
    hit = lambda w, **more: [r["line_no"] for r in search.matches(lines, search.query([w], **more)).orderBy("line_no").collect()]
    assert hit("straße") == hit("Strasse") == [1, 2] and hit("Οδός".replace("ό", "ο")) == [3, 4] and hit("Straße", case_sensitive=True) == [2]


@pytest.mark.parametrize("name", ["parse_lab", "parse_syslog", "parse_csv_logins", "validate_events", "fn_parse_iso", "search_dates", "search_ip", "search_cidr"])
def test_generated_code_is_compiled_and_without_python(spark, name):
    """HotSpot compiles no method above 8,000 bytes."""
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shown = df.select("*")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
    assert sizes and max(sizes) < 8_000 and "EvalPython" not in shown
