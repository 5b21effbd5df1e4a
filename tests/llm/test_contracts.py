"""All operators on one table with long texts and columns of clashing names; held-out accuracy on the given tables."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from emberlog.llm import ann_tree, chat, dac, langid, line_dedup, merkle, mixing, near_dup, packing, quality_rules, rule_ensemble, spelling, token_cache
from emberlog.llm.queries import queries

BPE, TABLES = "byte_bpe_50k.json", "/root/testdata/sf0.01"
CLASHES = "key bigint, n bigint, cid string, value string, size string, row string, place string, word string, lines string, words string, kept string, score string, member string"


@pytest.fixture(scope="module")
def tables(spark):
    """The same documents without and with further columns; one text has 60,000 words."""
    rng = random.Random(6)
    stock = {"en": "the of and with cat house", "de": "der die und mit katze haus", "fr": "le la et avec chat maison"}
    text = lambda lang, n: " ".join(rng.choice(stock[lang].split()) + rng.choice(["", "s", "en", "es"]) for _ in range(n))
    rows = [(k, text(lang, rng.randrange(5, 160)), lang, rng.choice(["a", "b", None]), k) for k in range(90) for lang in (rng.choice(list(stock)),)]
    rows += [(90, text("en", 60_000), "en", "a", 1), (91, None, None, None, None), (92, "", "de", "b", 0), (93, rows[3][1], "en", "a", 5), (94, rows[3][1] + " more", "en", "a", 5)]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    more = spark.createDataFrame([(*r, 7, 7, *["clash"] * 11) for r in rows], plain.schema.simpleString()[7:-1].replace(":", " ") + ", " + CLASHES)
    return plain, more, rows


OPERATORS = {
    "op1": lambda d: quality_rules.apply_quality_rules(d).select("doc_id", "n_words", "word_chars", "n_repeat_words", "kept"),
    "op2": lambda d: line_dedup.dedup_lines(d).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256)),
    "op3": lambda d: langid.identify(d, langid.learn(d, folds=5)).select("doc_id", "lang_pred"),
    "op4": lambda d: token_cache.count_tokens(d, BPE).select("doc_id", "n_bytes", "n_tokens"),
    "op6": lambda d: near_dup.near_duplicates(d),
    "op7": lambda d: dac.token_files(d, BPE, 2),
    "op8": lambda d: mixing.mix(d).select("doc_id", "size", "source_size", "target", "taken"),
    "op9": lambda d: rule_ensemble.score_quality(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality"))).select("doc_id", "held_out", "predicted"),
    "op10": lambda d: packing.pack_documents(d, BPE, 2, limit=128).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "op11": lambda d: chat.digests(chat.format_turns(d.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("source").alias("role"), "*"))),
    "op12": lambda d: spelling.spelling_variants(d),
    "op13": lambda d: merkle.manifest(d).select("doc_id", "leaf", "subroot", "root"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_further_columns_and_long_texts(tables, name):
    plain, more, rows = tables
    show = lambda df: sorted(str(tuple(r)) for r in df.collect())
    found = show(OPERATORS[name](plain))
    assert show(OPERATORS[name](more)) == found and found
    if name == "op1":
        assert any(r.startswith("(90, 60000, ") for r in found)
    if name in ("op1", "op2", "op3", "op4", "op6", "op7", "op8", "op9", "op13"):
        assert len(found) == len(rows)


def test_vectors_with_further_columns(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)], "clash", k, [1.0]) for k in range(200)]
    more = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, query_id string, cid bigint, vector array<double>")
    show = lambda df: sorted(map(tuple, ann_tree.nearest(df, "vec_id % 50 = 0").collect()))
    assert show(more) == show(more.select("vec_id", "embedding"))


def test_held_out_languages_and_labels(spark):
    """Of rows that nothing was learned from, nearly all are told rightly."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.where("text rlike '[a-zA-Z]'").select("doc_id", "lang").collect()}
    got = [(r["lang_pred"], truth[r["doc_id"]]) for r in queries()["op3_language_id"](spark, TABLES).collect() if r["held_out"] and truth.get(r["doc_id"])]
    assert len(got) > 100 and sum(a == b for a, b in got) >= 0.97 * len(got)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    rows = queries()["op9_quality_classifier"](spark, TABLES).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    got = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(got) > 50 and sum(a == b for a, b in got) >= 0.95 * len(got)
