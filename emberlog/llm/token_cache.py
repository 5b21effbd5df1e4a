"""Token counts through a digest cache.

A text's digest (SHA-256 of its normalised content) and the digest of the tokenizer's file together key a stored
count. Counting joins the documents' digests to the cache, encodes each distinct text that the cache lacks once, and
appends its count, so that a corpus which grows or repeats pays only for what is new.

Only a null text is normalised here, to the empty one: any other change of a text could change its count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.shared import document_columns, hot_join, releasing, scratch, stored
from emberlog.llm.tokens import encoder, version_digest

CACHE_SCHEMA = "version string, digest binary, n_bytes bigint, n_tokens bigint"


class TokenCountCache:
    """A Parquet table of counts at `path` (a folder that all executors share), one folder for each tokenizer version."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: str):
        self.spark, self.path, self.tokenizer, self.version = spark, path.rstrip("/"), tokenizer, version_digest(tokenizer)

    def _exists(self) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def counts(self) -> DataFrame:
        """(digest, n_bytes, n_tokens) of this version; a digest that two runs appended at once counts once."""
        return self._rows().dropDuplicates(["digest"])

    def _rows(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], CACHE_SCHEMA).drop("version")
        return self.spark.read.schema(CACHE_SCHEMA).parquet(self.path).where(F.col("version") == self.version).drop("version")

    def _held(self, texts: DataFrame) -> DataFrame:
        """The stored counts of these digests, each once."""
        return self._rows().join(texts.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])

    def count(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_bytes, n_tokens), one row for each row of docs (doc_id, text; further columns are ignored).

        Null text counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows are kept. An empty table gives none.
        """
        text = F.coalesce(F.col("text"), F.lit(""))
        keyed = document_columns(docs, "doc_id", "text").select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
        work = scratch(self.spark, "token-counts")
        ids = stored(keyed.select("doc_id", "digest"), f"{work}/ids")
        # each text once, with how many rows hold it, and one holder: the smallest id, and how many of the rows are that id's
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "same")).alias("first")
        texts = ids.groupBy("digest", "doc_id").agg(F.count("*").alias("same")).groupBy("digest").agg(F.sum("same").alias("rows"), first)
        texts = stored(texts.select("digest", "rows", F.col("first.doc_id").alias("owner"), F.col("first.same").alias("same")), f"{work}/texts")
        missing = stored(texts.join(self._held(texts), "digest", "left_anti").select(F.col("digest").alias("missing_digest"), "owner", "same"), f"{work}/missing")
        # by the holder's id, which no group of copies shares, so that no task gets all of one
        holder = F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("digest") == F.col("missing_digest"))
        fetched = keyed.join(missing.where("same = 1"), holder, "left_semi").select("digest", "text")
        if not missing.where("same > 1").isEmpty():
            fetched = fetched.union(keyed.join(missing.where("same > 1"), holder, "left_semi").select("digest", "text").dropDuplicates(["digest"]))
        self._encoded(fetched).write.mode("append").partitionBy("version").parquet(self.path)
        found = stored(texts.select("digest", "rows").join(self._held(texts), "digest"), f"{work}/counts")
        return hot_join(ids, found, "digest", "rows", found.agg(F.sum("rows")).first()[0] or 0).select("doc_id", "n_bytes", "n_tokens")

    def _encoded(self, texts: DataFrame) -> DataFrame:
        name = self.tokenizer

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enc = encoder(name)
            for b in batches:
                n_bytes = pc.binary_length(b.column("text")).cast(pa.int64())
                n_tokens = pa.array([len(ids) // 4 for ids in enc.encode_column(b.column("text"))], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("digest"), n_bytes, n_tokens], ["digest", "n_bytes", "n_tokens"])

        counted = texts.mapInArrow(releasing(encode), "digest binary, n_bytes bigint, n_tokens bigint")
        return counted.select(F.lit(self.version).alias("version"), "digest", "n_bytes", "n_tokens")


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str | None = None) -> DataFrame:
    """Counts through the cache at cache_path; without one, through a new cache in the shared scratch folder."""
    spark = docs.sparkSession
    return TokenCountCache(spark, cache_path or scratch(spark, "token-cache"), tokenizer).count(docs)
