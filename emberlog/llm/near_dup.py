"""Near-duplicate documents: bottom-k sketches of one hash function, overlaps from inverted lists, exact Jaccard.

A document's set holds the 64-bit hashes of its distinct shingles of five words. Documents with the same set are one
class; all further work is on classes. A class's id begins with the smallest doc_id in it, so that the smallest class
of a component names the component.

* Sketch: the SKETCH smallest hashes of the set, the whole set if it isn't larger.
* Lists: of the INDEXED smallest hashes, ordered by how many classes hold them (rare first), the first ones go into
  inverted lists: so many that two sets of Jaccard similarity `threshold` share one of them. For sets up to
  INDEXED * threshold hashes this is certain (prefix filter); for larger ones the smallest hashes are a random sample
  of the union, of which fewer than least_common of INDEXED are common in two pairs of 10^9 at the threshold itself.
  Common passages are ordered last, and a list of one class is no list.
* Candidates: each list first pairs its members with its smallest one.
* Filter: the SKETCH smallest hashes of the union of two sketches estimate the similarity.
* Verification: the full sets of what is left, exactly.
* Rest: lists whose members aren't all connected by now are compared in blocks inside tasks. First by sketches: a task
  names the members that may be similar to another one, not the pairs; a pair of several lists is looked at in the one
  of the smallest value. Then only these bring their full sets, in blocks bounded by shingles, and a task emits a
  spanning forest of its links. The members of a list's largest component meet only those outside of it. So a group of
  n near copies gives about n rows of a list, not n * n.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.components import components
from emberlog.llm.shared import document_columns, releasing, scratch, shingle_hashes, stored, texts_of, whole_runs, word_hashes

WIDTH = 5
#: Similarity in percent from which documents are near duplicates: as in op6_near_duplicates, and in corpora (distinct_documents).
THRESHOLD, USUAL = 85, 80
SKETCH, INDEXED = 64, 32
#: The most classes of one block of a list, and about the most shingles of their full sets.
BLOCK, SHINGLES_A_BLOCK = 1_024, 500_000
#: The most rows that a list of wanted documents is broadcast with.
MOST_BROADCAST = 100_000
SIGN = np.uint64(1 << 63)


@cache
def least_common(smallest: int, threshold: int) -> int:
    """Of so many smallest hashes of a union, fewer common ones than this happen with a chance below 2 * 10^-9 at the threshold: the binomial distribution's lower end."""
    t, chance = threshold / 100, 0.0
    for n in range(smallest + 1):
        chance += math.comb(smallest, n) * t**n * (1 - t) ** (smallest - n)
        if chance >= 2e-9:
            return n
    return smallest


def shingles(text: str | None, seen: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text, A-Z in lower case."""
    return shingle_hashes(word_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), seen), WIDTH)


def set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _longs(arrays: Sequence[np.ndarray]) -> pa.Array:
    """Lists of signed numbers in the order of the unsigned hashes: the highest bit is turned."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *[(a ^ SIGN).view(np.int64) for a in arrays]])))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): text_hash tells rows of one id apart."""
    return document_columns(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, sketch) of each row of docs; set_key is null for an empty set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in batches:
            rows = [(len(s), set_key(s) if len(s) else None, s[:SKETCH].copy()) for s in (shingles(t, seen) for t in texts_of(b.column("text")))]
            n, keys, firsts = zip(*rows, strict=True) if rows else ([], [], [])
            columns = [b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), _longs(firsts)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_key", "sketch"])

    return _keyed(docs).mapInArrow(releasing(sketch), "doc_id bigint, text_hash bigint, n_shingles bigint, set_key binary, sketch array<bigint>")


def class_id(owner: Column, key: Column) -> Column:
    """A class's id in bytes, ordered by owner (null last), then by key: a null mark, the owner with its highest bit turned, the key."""
    number = F.lpad(F.hex(F.coalesce(owner, F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.unhex(F.concat(F.when(owner.isNull(), "01").otherwise("00"), number)), key)


def owner_of(cid: Column) -> Column:
    """The owner that a class's id begins with."""
    half = lambda at: F.conv(F.hex(F.substring(cid, at, 4)), 16, 10).cast("bigint")
    number = F.shiftleft(half(2) - (1 << 31), 32) + half(6)
    return F.when(F.hex(F.substring(cid, 1, 1)) == "00", number)


def set_classes(rows: DataFrame) -> DataFrame:
    """(cid, set_key, owner, owner_hash, n, sketch): each distinct set of rows, and one row that has it: of the smallest id, nulls last."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    found = rows.where("set_key is not null").groupBy("set_key").agg(first, F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    return found.select(class_id(F.col("first.doc_id"), F.col("set_key")).alias("cid"), "set_key", F.col("first.doc_id").alias("owner"), F.col("first.text_hash").alias("owner_hash"), "n", "sketch")


def index_length(n: Column, threshold: int) -> Column:
    """How many of its rarest INDEXED hashes a set of n indexes: two sets at the threshold then share an indexed one."""
    exact = n - F.ceil(n * threshold / 100) + 1
    return F.when(n <= INDEXED * threshold // 100, exact).otherwise(F.least(n, F.lit(INDEXED)) - least_common(INDEXED, threshold) + 1)


def inverted_lists(classes: DataFrame, threshold: int, path: str) -> DataFrame:
    """(value, cid, members, leader) of the indexed hashes that more than one class indexes."""
    held = classes.select("cid", "n", F.explode(F.slice("sketch", 1, INDEXED)).alias("value"))
    shared = stored(held.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), f"{path}/shared")
    # hashes of one class only come first in the order and need no list: they only use up places
    found = held.join(shared, "value").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("shared"))
    places = index_length(F.col("n"), threshold) - (F.least("n", F.lit(INDEXED)) - F.size("shared"))
    rows = found.withColumn("places", places).where("places > 0").select("cid", F.explode(F.slice("shared", 1, F.col("places").cast("int"))).alias("x")).select("x.value", "cid")
    rows = stored(rows, f"{path}/indexed")
    several = stored(rows.groupBy("value").agg(F.count("*").alias("members"), F.min("cid").alias("leader")).where("members > 1"), f"{path}/several")
    return stored(rows.join(several, "value"), f"{path}/lists")


def estimated(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that may be similar by their sizes and the union of their sketches."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold)
    both = both.withColumn("union", F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)).withColumn("common", F.size(F.array_intersect("union", F.array_intersect("sketch_a", "sketch_b"))))
    whole = F.greatest("n_a", "n_b") <= SKETCH  # the sketches are the sets
    union = F.col("n_a") + F.col("n_b") - F.size(F.array_intersect("sketch_a", "sketch_b"))
    may = F.when(whole, F.size(F.array_intersect("sketch_a", "sketch_b")) * 100 >= union * threshold).otherwise(F.col("common") >= least_common(SKETCH, threshold))
    return both.where(may).select("a", "b", "n_a", "n_b")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose full sets reach the threshold."""
    side = lambda x: sets.select(F.col("cid").alias(x), F.col("hashes").alias(f"set_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(100 * F.col("common") >= threshold * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def common_counts(columns: list[np.ndarray], at_once: int = 4_096) -> np.ndarray:
    """How many numbers each two arrays of distinct numbers have in common; so many numbers are looked at at once."""
    _, inverse, counts = np.unique(np.concatenate(columns), return_inverse=True, return_counts=True)
    place = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[inverse]
    row = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    several = int((counts > 1).sum())
    out = np.zeros((len(columns), len(columns)), np.float32)
    for first in range(0, several, at_once):
        own = (place >= first) & (place < first + at_once)
        held = np.zeros((len(columns), min(at_once, several - first)), np.float32)
        held[row[own], place[own] - first] = 1
        out += held @ held.T
    return out


def may_be_similar(sketched: list[np.ndarray], sizes: np.ndarray, component: list[bytes], side: np.ndarray, threshold: int, earlier: list[np.ndarray] | None = None) -> np.ndarray:
    """Which members i < j (of different components, and of different sides if there are two) may reach the threshold by their sketches and sizes.

    earlier: of each member the lists that come before this one; a pair that shares one of them is left to it.
    """
    number: dict[bytes, int] = {}
    group = np.array([number.setdefault(c, len(number)) for c in component])
    may = group[:, None] != group[None, :]
    may &= 100 * np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :])
    if side.min() != side.max():
        may &= side[:, None] != side[None, :]
    may = np.triu(may, 1)
    if not may.any():
        return may
    common = common_counts(sketched)
    if earlier is not None:
        may &= common_counts(earlier) == 0
    small = sizes <= SKETCH
    return may & np.where(small[:, None] & small[None, :], 100 * common >= threshold * (sizes[:, None] + sizes[None, :] - common), common >= least_common(SKETCH, threshold))


def links_in_block(sets: list[np.ndarray], component: list[bytes], side: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Exact links of one block, or across its two sides, between different components: as many as connect what they connect."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    may = may_be_similar([x[:SKETCH] for x in sets], sizes, component, side, threshold)
    if not may.any():
        return []
    number: dict[bytes, int] = {}
    group = [number.setdefault(c, len(number)) for c in component]
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark, root, out = np.zeros(int(ids.max()) + 1, bool), list(range(len(number))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in np.flatnonzero(may.any(axis=1)):
        others = [j for j in np.flatnonzero(may[i]) if find(group[i]) != find(group[j])]
        if not others:
            continue
        own = ids[starts[i] : starts[i + 1]]
        mark[own] = True
        shared = np.array([int(mark[ids[starts[j] : starts[j + 1]]].sum()) for j in others])
        mark[own] = False
        for j in np.array(others)[100 * shared >= threshold * (sizes[i] + sizes[others] - shared)]:
            x, y = find(group[i]), find(group[j])
            if x != y:
                root[x] = y
                out.append((int(i), int(j)))
    return out


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as arrays."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [flat[s:e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)]


def _sides(members: DataFrame, weight: Column) -> DataFrame:
    """(value, big, rest_blocks, big_blocks) of lists of members (value, component): the component with most members, and how many blocks it and the rest take.

    A list that fits into one block has no big component.
    """
    each = members.groupBy("value", "component").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    lists = each.groupBy("value").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "component")).alias("big"))
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / SHINGLES_A_BLOCK), F.lit(1))
    n, w, big = F.col("n"), F.col("w"), F.col("big")
    one = blocks(n, w) == 1
    return lists.select("value", F.when(~one, big["component"]).alias("big"), F.when(one, 1).otherwise(blocks(n - big["n"], w - big["w"])).cast("bigint").alias("rest_blocks"), F.when(one, 0).otherwise(blocks(big["n"], big["w"])).cast("bigint").alias("big_blocks"))


def _dealt(members: DataFrame, *columns: str) -> DataFrame:
    """members (value, cid, component, big, rest_blocks, big_blocks, columns) once for each block that its own must meet, as (value, low, high).

    Members of the big component are linked with each other already, so its blocks meet those of the rest only, and a
    list in which few are left over is dealt in proportion to its length. Blocks of the rest meet each other.
    """
    inside, hashed = F.coalesce(F.col("component") == F.col("big"), F.lit(False)), F.xxhash64("cid")
    block = F.when(inside, F.col("rest_blocks") + F.pmod(hashed, F.greatest("big_blocks", F.lit(1)))).otherwise(F.pmod(hashed, F.col("rest_blocks")))
    last = F.col("rest_blocks") + F.when(inside, 0).otherwise(F.col("big_blocks")) - 1
    own = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return own.select("value", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cid", *columns)


def _meeting(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("value", "low", "high").sortWithinPartitions("value", "low", "high", "cid")


def open_members(lists: DataFrame, classes: DataFrame, links: DataFrame, threshold: int, path: str) -> DataFrame:
    """(value, cid, component): members of lists that `links` doesn't connect yet and whose sketches let them be similar to another component's."""
    member = lists.select("value", "cid", "members").join(components(links).withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    member = stored(member, f"{path}/members")
    split = stored(member.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("value"), f"{path}/split")
    open_ = stored(member.join(split, "value"), f"{path}/split-members")
    long = stored(_sides(open_.where(F.col("members") > BLOCK), F.lit(0)), f"{path}/long")
    one = {"rest_blocks": 1, "big_blocks": 0}
    sided = open_.drop("members").join(long, "value", "left").fillna(one)
    held = open_.groupBy("cid").agg(F.array_sort(F.collect_list("value")).alias("lists"))  # INDEXED values at most
    dealt = _dealt(sided, "component").join(classes.select("cid", "n", "sketch").join(held, "cid"), "cid")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in whole_runs(batches, "value", "low", "high"):
            sketched, held, sizes, side, component, value = _arrays(rows["sketch"]), _arrays(rows["lists"]), rows["n"].to_numpy(), rows["block"].to_numpy(), rows["component"].to_pylist(), rows["value"].to_numpy()
            found = []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if e - s > 1:
                    earlier = [x[: np.searchsorted(x, value[s])] for x in held[s:e]]
                    may = may_be_similar(sketched[s:e], sizes[s:e], component[s:e], side[s:e], threshold, earlier)
                    found += (s + np.flatnonzero(may.any(axis=0) | may.any(axis=1))).tolist()
            yield from rows.select(["value", "cid", "component"]).take(pa.array(found, pa.int64())).combine_chunks().to_batches()

    named = _meeting(dealt).mapInArrow(releasing(search), "value bigint, cid binary, component binary")
    return stored(named.distinct(), f"{path}/open")


def links_of_members(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b): the links between members (value, cid, component) of each list, by their full sets."""
    sides = _sides(members.join(sets.select("cid", F.size("hashes").alias("n")), "cid"), F.col("n"))
    dealt = _dealt(members.join(sides, "value"), "component").join(sets.select("cid", "hashes"), "cid")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in whole_runs(batches, "value", "low", "high"):
            full, side, component, keys = _arrays(rows["hashes"]), rows["block"].to_numpy(), rows["component"].to_pylist(), rows["cid"].to_pylist()
            pairs = [(keys[s + i], keys[s + j]) for s, e in zip(edges[:-1], edges[1:], strict=True) if e - s > 1 for i, j in links_in_block(full[s:e], component[s:e], side[s:e], threshold)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

    return _meeting(dealt).mapInArrow(releasing(search), "a binary, b binary").distinct()


def full_sets(docs: DataFrame, needed: DataFrame, repeated: bool, path: str) -> DataFrame:
    """(cid, hashes): the full set of each needed class (cid, owner, owner_hash), from the text of the row that it names.

    repeated: docs has equal rows of one id, which would give a class's set more than once.
    """
    needed = stored(needed, f"{path}-needed")
    side = F.broadcast(needed) if needed.count() <= MOST_BROADCAST else needed
    texts = _keyed(docs).join(side, F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("text_hash") == F.col("owner_hash"))).select("cid", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("cid"), _longs([shingles(t, seen) for t in texts_of(b.column("text"))])], ["cid", "hashes"])

    sets = texts.mapInArrow(releasing(full), "cid binary, hashes array<bigint>")
    return stored(sets.dropDuplicates(["cid"]) if repeated else sets, path)


def _classes_and_links(docs: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, text_hash, n_shingles, set_key) and reached (set_key, cid, component): the class of each set, and the smallest class that links reach."""
    path = scratch(docs.sparkSession, "near-dup")
    rows = stored(sketches(docs), f"{path}/sketches")
    classes = stored(set_classes(rows), f"{path}/classes")
    lists = inverted_lists(classes, threshold, path)
    owners = classes.select("cid", "owner", "owner_hash")
    repeated = not rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()
    star = lists.where("cid != leader").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct()
    star = stored(estimated(star, classes, threshold), f"{path}/estimated")
    sets = full_sets(docs, owners.join(star.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid", "left_semi"), repeated, f"{path}/sets")
    star = stored(verified(star, sets, threshold), f"{path}/star")
    members = open_members(lists, classes, star, threshold, path)
    more = full_sets(docs, owners.join(members.select("cid").distinct(), "cid", "left_semi").join(sets.select("cid"), "cid", "left_anti"), repeated, f"{path}/more-sets")
    links = star.union(stored(links_of_members(members, sets.union(more), threshold), f"{path}/rest"))
    reached = classes.select("cid", "set_key").join(components(links).withColumnRenamed("node", "cid"), "cid", "left").select("set_key", "cid", F.coalesce("component", "cid").alias("component"))
    return rows.drop("sketch"), stored(reached, f"{path}/reached")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    component_id: the smallest doc_id that links of similarity threshold / 100 or more reach, its own included. kept:
    doc_id is component_id. Texts without words are linked with nothing. Rows of one id with the same set are in one
    component; a null id is never the smallest if another is there, and a null-id row is kept if none is. Further
    columns are ignored. An empty table gives no row.
    """
    rows, reached = _classes_and_links(docs, threshold)
    own = reached.select("set_key", owner_of(F.col("component")).alias("component_id"))
    linked = rows.where("set_key is not null").join(own, "set_key").select("doc_id", "n_shingles", "component_id")
    out = linked.union(rows.where("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct_documents(docs: DataFrame, threshold: int = USUAL) -> DataFrame:
    """One row of docs from each group of near duplicates, and all rows whose text has no word.

    Of a group stays the row of its smallest id, null ids last; of several rows of that id the one whose set has the
    smallest key, and of rows of that id with the same text the first as JSON. Other rows of the id that are no near duplicates
    are groups of their own. All columns come back, whatever their names. An empty table gives no row.
    """
    rows, reached = _classes_and_links(docs, threshold)
    # rows of the smallest class of a group have the smallest id; (id, text) tells which of the class's rows it is
    first = rows.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"))
    winners = reached.where("cid = component").select("set_key").join(first, "set_key").select("set_key", F.col("first.doc_id").alias("won_id"), F.col("first.text_hash").alias("won_hash"))
    stays = F.col("doc_id").eqNullSafe(F.col("won_id")) & F.coalesce(F.col("text_hash") == F.col("won_hash"), F.lit(False))
    judged = rows.where("set_key is not null").join(winners, "set_key", "left").select("doc_id", "text_hash", stays.alias("stays"))
    path = scratch(docs.sparkSession, "near-dup-rows")
    # the (id, text) that go, and those of several rows of which one stays
    by_row = stored(judged.groupBy("doc_id", "text_hash").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1"), f"{path}/judged")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash"))
    back = lambda df: df.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    out = back(packed.join(by_row, same, "left_anti"))
    repeated = by_row.where("stays")
    if not repeated.isEmpty():
        one = packed.join(repeated.select("doc_id", "text_hash"), same, "left_semi").groupBy("own_id", "own_hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.union(back(one))
    return out
