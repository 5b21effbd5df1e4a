"""Reversible line deduplication: sharded cuckoo filters in front of exact reference counts.

A line's key is its text without ASCII white space at both ends, A-Z in lower case; keys shorter than SHORTEST code
points take no part. An index lives in a folder that all executors share. Each change appends one generation of four
tables and then a commit, and rewrites nothing:

* ids: (doc_id, held): documents that came or went,
* postings: (key, doc_id, part): each key of each row of the new documents,
* counts: (key, refs, owner, last): of each key that changed, how many rows hold it now, the smallest and largest id,
* filters: (shard, filter): the cuckoo filter of each shard that changed, with min(refs, 2) copies of each key.

Of several generations of a key, document or shard, the newest holds. A change whose commit is missing never happened,
so a batch whose run was lost is simply inserted again; documents that the index already holds are left alone.
`compact` writes one generation of all that holds.

A batch is inserted or deleted by its own keys: a key that its shard's filter doesn't hold is new and needs no look at
the counts; only the others are joined to them. A line is dropped if at least two documents hold its key and its own
isn't the smallest. Very common keys, no more than MOST_HOT, are decided by broadcast and never meet in one task; of
the others the filters settle most, and the exact counts the rest.

Keys are MD5 digests. Null ids are one document that stands behind all others; rows that share an id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.cuckoo import CuckooFilter, FilterFull
from emberlog.llm.shared import HOT, MOST_HOT, document_columns, releasing, scratch, stored

SHORTEST = 10
KEYS_A_SHARD = 50_000
NO_ID = (1 << 63) - 1
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TABLES = {
    "ids": "doc_id bigint, held boolean",
    "postings": "key binary, doc_id bigint, part bigint",
    "counts": "key binary, refs bigint, owner bigint, last bigint",
    "filters": "shard int, filter binary",
}
COMMIT = "generation int, oldest int, oldest_filters int, shards int, deleted boolean"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The digest of a line's key; null if the key is too short.

    Most lines have no blanks but spaces at their ends and only ASCII: for them Spark's plain trim and lower do.
    """
    plain, odd = F.trim(line), F.lit(False)
    for blank in BLANKS[1:]:
        odd |= plain.startswith(blank) | plain.endswith(blank)
    own = F.when(odd, F.btrim(plain, F.lit(BLANKS))).otherwise(plain)
    low = F.when(F.octet_length(own) == F.char_length(own), F.lower(own)).otherwise(F.translate(own, UPPER, LOWER))
    return F.when(F.char_length(own) >= SHORTEST, F.unhex(F.md5(low.cast("binary"))))


def own_id(doc_id: str | Column) -> Column:
    return F.coalesce(doc_id, F.lit(NO_ID))


def own_part(doc_id: Column, text: Column) -> Column:
    """Rows without an id are told apart by their text, so that they aren't one task's."""
    return F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("bigint"))


def line_keys(docs: DataFrame) -> DataFrame:
    """(key, doc_id, part): each key of each row of docs once."""
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), line_key))
    own = document_columns(docs, "doc_id", "text").select(F.explode(keys).alias("key"), own_id("doc_id").alias("doc_id"), own_part(F.col("doc_id"), F.col("text")).alias("part"))
    return own.where("key is not null")


def summed(postings: DataFrame) -> DataFrame:
    """(key, refs, owner, last) of postings; a line of a third of all documents is summed up before it is dealt out."""
    return postings.groupBy("key").agg(F.count("*").alias("refs"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))


def _hashes(keys: pa.Array) -> np.ndarray:
    """The first 8 bytes of each digest."""
    return np.frombuffer(b"".join(k[:8] for k in keys.to_pylist()), "<u8")


class LineIndex:
    """A line index in a shared folder, new or reopened. One driver changes it at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.generation, self.oldest, self.oldest_filters, self.shards, self.deleted = 0, 1, 1, 1, False
        commits = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if commits.getFileSystem(spark._jsc.hadoopConfiguration()).exists(commits):
            last = spark.read.schema(COMMIT).parquet(f"{self.path}/commits").orderBy(F.desc("generation")).first()
            if last:
                self.generation, self.oldest, self.oldest_filters, self.shards, self.deleted = last

    def _folder(self, name: str, generation: int) -> str:
        return f"{self.path}/{name}/{generation}"

    def _write(self, name: str, rows: DataFrame) -> None:
        """A part of the next generation; what a lost run left there is replaced."""
        rows.write.mode("overwrite").parquet(self._folder(name, self.generation + 1))

    def _next(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(self._folder(name, self.generation + 1))

    def _newest(self, name: str, *key: str, among: DataFrame | None = None) -> DataFrame:
        """The rows of a table that hold, with their generation, of all keys or only those in `among`."""
        first = self.oldest_filters if name == "filters" else self.oldest
        out = None
        for g in range(first, self.generation + 1):
            rows = self.spark.read.schema(TABLES[name]).parquet(self._folder(name, g)).withColumn("generation", F.lit(g))
            out = rows if out is None else out.union(rows)
        if out is None:
            out = self.spark.createDataFrame([], TABLES[name] + ", generation int")
        if among is not None:
            out = out.join(among, list(key), "left_semi")
        if not key or self.generation <= first:
            return out
        rest = [c for c in out.columns if c not in key]
        return out.groupBy(*key).agg(F.max(F.struct("generation", *[c for c in rest if c != "generation"])).alias("x")).select(*key, "x.*")

    def _ids(self) -> DataFrame:
        return self._newest("ids", "doc_id").where("held").select("doc_id", "generation")

    def _postings(self) -> DataFrame:
        """(key, doc_id, part) of the documents that are held."""
        rows = self._newest("postings")
        return (rows.join(self._ids(), ["doc_id", "generation"], "left_semi") if self.deleted else rows).select("key", "doc_id", "part")

    def _counts(self, among: DataFrame | None = None) -> DataFrame:
        return self._newest("counts", "key", among=among).where("refs > 0").select("key", "refs", "owner", "last")

    def counts(self) -> DataFrame:
        """(key, refs, owner, last) of all keys that are held."""
        return self._counts()

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def _commit(self, change: DataFrame | None, deleted: bool = False) -> None:
        """Ends a change: new filters from change (key, old, new: copies before and after), or all anew if None or a filter is full."""
        after = self.generation + 1
        if change is not None:
            self._write("filters", self._filters(self._newest("filters", "shard"), change.where("old != new")))
        if change is None or not self._next("filters").where("filter is null").isEmpty():
            self.generation = after
            keys = self._counts().select("key", F.lit(0).alias("old"), F.least("refs", F.lit(2)).alias("new"))
            self.shards, self.oldest_filters = max(1, -(-keys.count() // KEYS_A_SHARD)), after
            self.generation = after - 1
            self._write("filters", self._filters(None, keys))
        self.generation, self.deleted = after, self.deleted or deleted
        row = [(self.generation, self.oldest, self.oldest_filters, self.shards, self.deleted)]
        self.spark.createDataFrame(row, COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _filters(self, filters: DataFrame | None, copies: DataFrame) -> DataFrame:
        """(shard, filter) of the shards with keys in copies (key, old, new), after each key went from old to new copies.

        A task holds one shard's keys. A filter without room for them comes back as null.
        """

        def change(before: pa.Table, keys: pa.Table) -> pa.Table:
            if not len(keys):
                return pa.table({"shard": pa.array([], pa.int32()), "filter": pa.array([], pa.binary())})
            h = _hashes(keys["key"])
            old, new = (np.array(keys[c].to_pylist(), dtype=np.int64) for c in ("old", "new"))
            add, drop = np.repeat(h, np.maximum(new - old, 0)), np.repeat(h, np.maximum(old - new, 0))
            held = CuckooFilter.load(before["filter"][0].as_py()) if len(before) else CuckooFilter.for_items(max(len(add), KEYS_A_SHARD))
            try:
                held.delete(drop)
                held.insert(add)
                data = held.dump()
            except FilterFull:
                data = None
            return pa.table({"shard": keys["shard"].slice(0, 1).cast(pa.int32()), "filter": pa.array([data], pa.binary())})

        none = self.spark.createDataFrame([], TABLES["filters"])
        left = (filters.select("shard", "filter") if filters is not None else none).groupBy("shard")
        right = copies.select(self._shard().alias("shard"), "key", F.col("old").cast("int"), F.col("new").cast("int")).groupBy("shard")
        return left.cogroup(right).applyInArrow(change, TABLES["filters"])

    def probe(self, keys: DataFrame, least: int) -> DataFrame:
        """The rows of keys (key, doc_id, part) whose filter holds at least `least` copies: all that should be, and few others.

        A shard's filter and its keys meet in one task; hot keys are no part of this.
        """
        no = lambda kind: F.lit(None).cast(kind)
        filters = self._newest("filters", "shard").select("shard", "filter", no("binary").alias("key"), no("bigint").alias("doc_id"), no("bigint").alias("part"))
        asked = keys.select(self._shard().alias("shard"), no("binary").alias("filter"), "key", "doc_id", "part")
        dealt = filters.union(asked).repartition("shard").sortWithinPartitions("shard", F.col("key").asc_nulls_first())

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, of = None, None
            for b in batches:
                shards = b.column("shard").to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    if s == e:
                        continue
                    part = b.slice(s, e - s)
                    if part.column("filter")[0].is_valid:
                        held, of = CuckooFilter.load(part.column("filter")[0].as_py()), shards[s]
                        part = part.slice(1)
                    if len(part) and of == shards[s]:  # a shard without a filter holds none of the keys
                        yield part.select(["key", "doc_id", "part"]).filter(pa.array(held.copies(_hashes(part.column("key"))) >= least))

        return dealt.mapInArrow(releasing(hits), TABLES["postings"])

    def insert(self, docs: DataFrame) -> None:
        """Adds the documents (doc_id, text) that the index doesn't hold; those that it holds stay as they are."""
        work = scratch(self.spark, "line-batch")
        ids = docs.select(own_id("doc_id").alias("doc_id")).distinct()
        rows = line_keys(docs)
        if self.generation:
            ids = stored(ids.join(self._ids(), "doc_id", "left_anti"), f"{work}/ids")
            if ids.isEmpty():
                return
            rows = rows.join(ids, "doc_id", "left_semi").select("key", "doc_id", "part")
        self._write("ids", ids.select("doc_id", F.lit(True).alias("held")))
        self._write("postings", rows)
        fresh = summed(self._next("postings"))
        if not self.generation:
            self._write("counts", fresh)
            return self._commit(None)
        fresh = stored(fresh, f"{work}/counts")
        known = self.probe(fresh.select("key", F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("part")), 1).select("key")
        old = stored(self._counts(among=known), f"{work}/old")
        merged = fresh.union(old).groupBy("key").agg(F.sum("refs").alias("refs"), F.min("owner").alias("owner"), F.max("last").alias("last"))
        self._write("counts", merged)
        self._commit(self._copies(old, self._next("counts")))

    def delete(self, ids: DataFrame) -> None:
        """Takes out all documents of ids (doc_id); ids that the index doesn't hold change nothing."""
        if not self.generation:
            return
        work = scratch(self.spark, "line-batch")
        gone = stored(ids.select(own_id("doc_id").alias("doc_id")).distinct().join(self._ids(), "doc_id", "left_semi"), f"{work}/ids")
        if gone.isEmpty():
            return
        held = self._postings()
        keys = stored(held.join(gone, "doc_id", "left_semi").select("key").distinct(), f"{work}/keys")
        left = summed(held.join(gone, "doc_id", "left_anti").join(keys, "key", "left_semi"))
        old = stored(self._counts(among=keys), f"{work}/old")
        self._write("ids", gone.select("doc_id", F.lit(False).alias("held")))
        self._write("postings", self.spark.createDataFrame([], TABLES["postings"]))
        self._write("counts", keys.join(left, "key", "left").select("key", F.coalesce("refs", F.lit(0)).cast("bigint").alias("refs"), "owner", "last"))
        self._commit(self._copies(old, self._next("counts")), deleted=True)

    @staticmethod
    def _copies(old: DataFrame, new: DataFrame) -> DataFrame:
        """(key, old, new): the filter's copies of each key of new before and after."""
        before = old.select("key", F.col("refs").alias("was"))
        return new.join(before, "key", "left").select("key", F.least(F.coalesce("was", F.lit(0)), F.lit(2)).alias("old"), F.least("refs", F.lit(2)).alias("new"))

    def compact(self) -> None:
        """Writes all that holds as one generation, which later reads start from."""
        if self.generation <= self.oldest:
            return
        ids, postings, counts = self._ids(), self._postings(), self._counts()
        self._write("ids", ids.select("doc_id", F.lit(True).alias("held")))
        self._write("postings", postings)
        self._write("counts", counts)
        self.oldest, self.deleted = self.generation + 1, False
        self._commit(None)

    def dropped_keys(self, docs: DataFrame | None = None) -> DataFrame:
        """(doc_id, part, dropped): the keys of the lines to drop from each row of docs, or of all documents that are held."""
        work = scratch(self.spark, "line-drops")
        own = self._postings()
        if docs is not None:
            own = own.join(docs.select(own_id("doc_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        counts = self._counts() if self.generation == self.oldest else stored(self._counts(), f"{work}/counts")
        total = counts.agg(F.sum("refs")).first()[0] or 0
        hot_from = max(HOT, -(-total // MOST_HOT))
        several = counts.where("owner != last").select("key", "owner", "refs")
        hot = F.broadcast(several.where(F.col("refs") >= hot_from))  # MOST_HOT keys at most: each stands for total / MOST_HOT rows
        decided = own.join(hot, "key").where("doc_id != owner").select("doc_id", "part", "key")
        hits = self.probe(own.join(hot, "key", "left_anti"), 2)
        rest = hits.join(several.where(F.col("refs") < hot_from), "key").where("doc_id != owner").select("doc_id", "part", "key")
        return decided.union(rest).groupBy("doc_id", "part").agg(F.collect_set("key").alias("dropped"))

    def kept_lines(self, docs: DataFrame, everything: bool = False) -> DataFrame:
        """(row, n_lines, n_dropped, kept_text) of each row of docs, which the index must hold; row holds its columns.

        everything: docs are all that the index holds.
        """
        own = docs.select(F.struct("*").alias("row"), own_id(F.col("doc_id")).alias("doc_id"), own_part(F.col("doc_id"), F.col("text")).alias("part"))
        joined = own.join(self.dropped_keys(None if everything else docs), ["doc_id", "part"], "left").withColumn("lines", lines_of(F.col("row.text")))
        # a look-up in a few small sets instead of one large one, for documents with very many lines
        sets = F.ceil(F.sqrt(F.size("dropped"))).cast("int")
        joined = joined.withColumn("sets", F.when(F.col("dropped").isNotNull(), F.transform(F.sequence(F.lit(0), sets - 1), lambda k: F.filter("dropped", lambda x: F.pmod(F.hash(x), sets) == k))))
        joined = joined.withColumn("keys", F.when(F.col("dropped").isNotNull(), F.transform("lines", line_key)))
        key = lambda i: F.get("keys", i)
        stays = lambda x, i: ~F.coalesce(F.array_contains(F.get("sets", F.pmod(F.hash(key(i)), F.size("sets"))), key(i)), F.lit(False))
        kept = joined.withColumn("kept", F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)))
        return kept.select("row", F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))

    def dedup(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept_text) of each row of docs, which the index must hold."""
        return self.kept_lines(document_columns(docs, "doc_id", "text")).select("row.doc_id", "n_lines", "n_dropped", "kept_text")


def _self_index(docs: DataFrame) -> LineIndex:
    index = LineIndex(docs.sparkSession, scratch(docs.sparkSession, "line-index"))
    index.insert(docs)
    return index


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text): docs (doc_id, text) against themselves, through a new index in the shared scratch folder.

    Null and empty texts have one empty line. Null ids are one document behind all others, rows that share an id are
    one document, and every row gives a row. An empty table gives no row; further columns are ignored.
    """
    own = document_columns(docs, "doc_id", "text")
    return _self_index(docs).kept_lines(own, everything=True).select("row.doc_id", "n_lines", "n_dropped", "kept_text")


def documents_without_repeated_lines(docs: DataFrame) -> DataFrame:
    """Every row of docs with the dropped lines taken out of text and n_chars, if there is one, counted anew.

    A null text stays null, an empty one empty. Null ids are one document behind all others; rows that share an id are
    one document and keep their lines from one another. All other columns come back as they were, whatever their
    names. An empty table gives no row.
    """
    out = _self_index(docs).kept_lines(docs, everything=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    new = {"text": text, "n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
