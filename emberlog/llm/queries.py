"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import ann_tree, chat, dac, langid, line_dedup, merkle, mixing, near_dup, packing, quality_rules, rule_ensemble, spelling, token_cache
from emberlog.llm.oracles import OP11_SQL, OP12_SQL, OP13_SQL
from emberlog.llm.shared import learning_fold

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality_rules.apply_quality_rules(_table(spark, sf_dir, "documents"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs, folds=5))
    return found.select("doc_id", (learning_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_cache.count_tokens(_table(spark, sf_dir, "documents"), BYTE_BPE)
    return counts.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 512 as over_limit")


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", most=5)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), threshold=85)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_files(_table(spark, sf_dir, "documents"), BYTE_BPE, END_ID)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.training_order(mixing.mix(_table(spark, sf_dir, "documents"))).selectExpr("doc_id", "size", "source_size", "target", "taken", "cast(floor(position * 1000000) as bigint) as position_ppm")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), BYTE_BPE, END_ID, limit=1024)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_turns(chat.with_hostile(_table(spark, sf_dir, "conversations"))))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the untampered table, against which the leaves of one with changed n_chars are held."""
    changed = F.when(learning_fold(F.col("doc_id"), 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(_table(spark, sf_dir, "documents"), {"claimed": merkle.leaf_digest(n_chars=changed)})
    found = found.withColumn("folded_root", merkle.folded(F.col("claimed"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP1_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT row_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT row_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts)),
triples AS (
  SELECT row_id, pos, word, lead(word, 1) OVER p AS second, lead(word, 2) OVER p AS third FROM words WINDOW p AS (PARTITION BY row_id ORDER BY pos)),
found AS (
  SELECT row_id, pos, third IS NOT NULL AND count(*) OVER (PARTITION BY row_id, word, second, third) > 1 AS twice FROM triples),
covered AS (
  SELECT row_id, count(*) AS n_words, count(*) FILTER (WHERE hit) AS n_repeat_words FROM (
    SELECT row_id, twice OR coalesce(lag(twice, 1) OVER p, false) OR coalesce(lag(twice, 2) OVER p, false) AS hit
    FROM found WINDOW p AS (PARTITION BY row_id ORDER BY pos)) GROUP BY row_id),
lines AS (
  SELECT row_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id),
counted AS (
  SELECT t.row_id, doc_id, coalesce('1' || lang, '0') AS language, coalesce('1' || source, '0') AS origin,
    coalesce(n_words, 0) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM texts t LEFT JOIN covered USING (row_id) LEFT JOIN lines USING (row_id)),
measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    1000 * word_chars // greatest(n_words, 1) AS m0, 1000000 * n_symbols // greatest(word_chars, 1) AS m1,
    1000000 * n_dup_lines // greatest(n_lines, 1) AS m2, 1000000 * n_repeat_words // greatest(n_words, 1) AS m3
  FROM counted),
long_form AS (
  SELECT language, origin, metric, CASE metric WHEN 0 THEN m0 WHEN 1 THEN m1 WHEN 2 THEN m2 ELSE m3 END AS value
  FROM measured, (SELECT unnest([0, 1, 2, 3]) AS metric) WHERE NOT base_failed),
bucketed AS (
  SELECT language, origin, metric, shift * 64 + (value >> shift) AS bucket FROM (
    SELECT *, CAST(CASE WHEN value < 128 THEN 0 ELSE length(ltrim(bin(CAST(value AS BIGINT)), '0')) - 7 END AS BIGINT) AS shift FROM long_form)),
levels AS (
  SELECT language, origin, metric, bucket, 0 AS level FROM bucketed UNION ALL
  SELECT language, '', metric, bucket, 1 FROM bucketed UNION ALL
  SELECT '', '', metric, bucket, 2 FROM bucketed),
sketch AS (SELECT level, language, origin, metric, bucket, count(*) AS n FROM levels GROUP BY ALL),
ranked AS (
  SELECT *, CASE WHEN bucket < 128 THEN bucket ELSE (bucket - (bucket // 64 - 1) * 64) << CAST(bucket // 64 - 1 AS INTEGER) END AS value,
    sum(n) OVER (PARTITION BY level, language, origin, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, language, origin, metric) AS total
  FROM sketch),
quartiles AS (
  SELECT level, language, origin, metric, max(total) AS n, min(value) FILTER (WHERE 4 * upto >= total) AS q1, min(value) FILTER (WHERE 4 * upto >= 3 * total) AS q3
  FROM ranked GROUP BY ALL),
fences AS (
  SELECT level, language, origin, metric, n, q1 - reach AS low, q3 + reach AS high FROM (
    SELECT *, 3 * greatest(q3 - q1, CASE metric WHEN 0 THEN 500 WHEN 1 THEN 20000 ELSE 150000 END) AS reach FROM quartiles)),
held AS (
  SELECT o.language, o.origin, o.metric,
    CASE WHEN o.n >= 200 THEN o.low WHEN l.n >= 200 THEN l.low ELSE a.low END AS low,
    CASE WHEN o.n >= 200 THEN o.high WHEN l.n >= 200 THEN l.high ELSE a.high END AS high
  FROM fences o JOIN fences l ON l.level = 1 AND l.language = o.language AND l.metric = o.metric JOIN fences a ON a.level = 2 AND a.metric = o.metric
  WHERE o.level = 0),
odd AS (
  SELECT DISTINCT row_id FROM measured m JOIN held h USING (language, origin)
  WHERE CASE metric WHEN 0 THEN m0 NOT BETWEEN low AND high WHEN 1 THEN m1 > high WHEN 2 THEN m2 > high ELSE m3 > high END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND o.row_id IS NULL AS kept
FROM measured m LEFT JOIN odd o USING (row_id)
"""

OP2_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(doc_id, 9223372036854775807) AS own_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT row_id, own_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM texts),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, min(own_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(own_id) < max(own_id)),
judged AS (SELECT k.row_id, k.pos, k.line, s.key IS NOT NULL AND k.own_id != s.owner AS gone FROM keyed k LEFT JOIN shared s ON s.key = k.key),
joined AS (
  SELECT row_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM judged GROUP BY row_id)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM texts JOIN joined USING (row_id)
"""

OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS skey
  FROM documents),
sources AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY skey) AS rank FROM sized GROUP BY skey),
weighed AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sources),
levels AS (
  SELECT *, CAST(source_size AS DOUBLE) * 2 / weight AS level FROM weighed),
waters AS (
  SELECT *,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
     - CAST(coalesce(sum(source_size) OVER (ORDER BY level, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) * 2.0)
    / CAST(sum(weight) OVER (ORDER BY level, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS water
  FROM levels),
water AS (SELECT arg_min(water, (level, skey)) FILTER (WHERE water <= level) AS water FROM waters),
targets AS (
  SELECT skey, source_size, rank,
    CASE WHEN w.water IS NULL THEN CAST(source_size AS DOUBLE) * 2 ELSE least(weight * w.water, CAST(source_size AS DOUBLE) * 2) END AS target
  FROM weighed, water w),
placed AS (
  SELECT s.*, t.source_size, t.rank, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
    CAST(coalesce(sum(size) OVER (PARTITION BY s.skey ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.skey = t.skey),
taking AS (
  SELECT *, greatest(least(goal - start, size), 0) + greatest(least(goal - start - source_size, size), 0) AS taken,
    CASE (rank - 1) % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS a,
    CASE (rank - 1) % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS b
  FROM placed)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CAST(floor(
    2 * (CAST(start AS DOUBLE) / target) * ((a + b) / 2)
    / (a + sqrt(greatest(a * a + 2 * (b - a) * (CAST(start AS DOUBLE) / target) * ((a + b) / 2), 0.0))) * 1000000) AS BIGINT) END AS position_ppm
FROM taking
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_line_dedup": op2_line_dedup,
        "op3_language_id": op3_language_id,
        "op4_token_counts": op4_token_counts,
        "op5_nearest_vectors": op5_nearest_vectors,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_token_files": op7_token_files,
        "op8_mix_sources": op8_mix_sources,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_pack_sequences": op10_pack_sequences,
        "op11_chat_format": op11_chat_format,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op2_line_dedup": OP2_SQL, "op8_mix_sources": OP8_SQL, "op11_chat_format": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
