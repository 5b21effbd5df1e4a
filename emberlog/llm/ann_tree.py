"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

Rows with the same vector are one class, of which the few smallest ids are kept: all that a result can name. The tree
is fitted on the driver on a sample of at most SAMPLE_VALUES numbers; every class is then put into a leaf. A query
goes through the tree with a priority queue, always on to the nearest node seen so far, and visits leaves in that
order. How many is calibrated: for at most CALIBRATION queries the true neighbours are found by brute force over all
classes, and the visits are widened until by a lower bound TARGET of all queries' neighbours lie in visited leaves.

Search is a grouped job over (bin, chunk): a bin is leaves that follow each other in the tree, up to about CHUNK classes,
so a query gives one short list for a bin and not one for each leaf. In a bin, a query is held against the classes of
the leaves that it visits and no others. Larger bins are split into chunks, so no task holds more than about CHUNK.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.shared import document_columns, scratch, stored

SAMPLE_VALUES = 2_000_000
BRANCHES = 8
#: Classes that a leaf should hold, and the most leaves of a tree.
LEAF, MOST_LEAVES = 256, 4_096
#: Queries that the number of visited leaves is calibrated on, and the recall that its lower bound must reach: the mean less
#: MARGIN standard errors of it.
CALIBRATION = 400
TARGET, MARGIN = 0.92, 3.0
CHUNK = 4_096
QUERIES_A_TASK = 20_000


@dataclass
class Node:
    centre: np.ndarray
    leaf: int = -1
    children: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """The cluster of each row of unit vectors x, by spherical k-means from far-apart starting rows."""
    centres = x[[int(rng.integers(len(x)))]]
    near = x @ centres[0]
    while len(centres) < k:
        weight = np.maximum(1 - near, 0) ** 2
        if weight.sum() <= 0:
            break
        centres = np.vstack([centres, x[int(rng.choice(len(x), p=weight / weight.sum()))]])
        near = np.maximum(near, x @ centres[-1])
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        filled = np.bincount(own, minlength=len(centres)) > 0
        centres = _unit(sums[filled])
    return np.argmax(x @ centres.T, axis=1)


class Tree:
    """Nodes down to leaves of about leaf_rows sample rows."""

    def __init__(self, sample: np.ndarray, leaf_rows: float):
        self.leaves, self.rng = 0, np.random.default_rng(7)
        self.root = self._grow(_unit(sample), leaf_rows)

    def _grow(self, x: np.ndarray, leaf_rows: float) -> Node:
        node = Node(_unit(x.mean(axis=0, keepdims=True))[0])
        own = k_means(x, BRANCHES, self.rng) if len(x) > max(leaf_rows, 1) else np.zeros(len(x), int)
        if len(groups := np.unique(own)) > 1:
            node.children = [self._grow(x[own == g], leaf_rows) for g in groups]
            node.centres = np.stack([c.centre for c in node.children])
        else:
            node.leaf, self.leaves = self.leaves, self.leaves + 1
        return node

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each unit vector falls into, always by the nearest child."""
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node.children:
                own = np.argmax(x[rows] @ node.centres.T, axis=1)
                todo += [(c, rows[own == k]) for k, c in enumerate(node.children) if (own == k).any()]
            else:
                out[rows] = node.leaf
        return out

    def visit(self, x: np.ndarray, visits: int) -> list[int]:
        """The first leaves that a best-bin-first search for a unit vector comes to."""
        out, queue, pushed = [], [(0.0, 0, self.root)], 0
        while queue and len(out) < visits:
            _, _, node = heapq.heappop(queue)
            if node.children:
                for near, child in zip(node.centres @ x, node.children, strict=True):
                    pushed += 1
                    heapq.heappush(queue, (-float(near), pushed, child))
            else:
                out.append(node.leaf)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with the same row of b; the same for the same two rows in any block."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def best_classes(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, most: int, parts: list[tuple[slice, np.ndarray]] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its `most` nearest rows (place, cosine), ties to the smaller id.

    parts: runs of rows, each with which queries are held against it; None holds all against all.
    """
    unit = _unit(rows).T
    for start in range(0, len(queries), 256):
        asked = _unit(queries[start : start + 256])
        if parts is None:
            near = asked @ unit
        else:
            near = np.full((len(asked), len(rows)), -np.inf)
            for run, visitors in parts:
                own = np.flatnonzero(visitors[start : start + 256])
                near[own, run] = asked[own] @ unit[:, run]
        least = np.partition(near, max(0, near.shape[1] - most), axis=1)[:, max(0, near.shape[1] - most)] - 1e-9
        for k in range(len(near)):
            short = np.flatnonzero((near[k] >= least[k]) & (near[k] > -np.inf))
            exact = cosines(np.broadcast_to(queries[start + k], (len(short), rows.shape[1])), rows[short])
            order = np.lexsort((ids[short], -exact))[:most]
            yield start + k, short[order], exact[order]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, a vector of the table's usual length, finite, not zero."""
    own = document_columns(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = own.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    lengths = own.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return own.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def vector_classes(rows: DataFrame, most: int) -> DataFrame:
    """(cid, first_id, ids, v): each distinct vector, a number of its own, its smallest id, and its `most` smallest ids. Store it: cid is made anew each time."""
    place = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("place", F.dense_rank().over(place)).where(F.col("place") <= most)  # limited before the shuffle, too
    return few.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("cid"), F.element_at("ids", 1).alias("first_id"), "ids", "v")


def fit_tree(classes: DataFrame, n: int) -> Tree:
    width = len(classes.select("v").first()["v"])
    some = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(max(1, SAMPLE_VALUES // width)).toArrow()
    sample = _matrix(some["v"].combine_chunks())
    leaves = min(MOST_LEAVES, max(1, n // LEAF))
    return Tree(sample, 1.5 * len(sample) / leaves)


def nearest(vectors: DataFrame, query_ids: str, most: int = 5, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `most` nearest rows of vectors (vec_id, embedding) that were found.

    query_ids: an SQL condition on vec_id. Vectors that are null, zero or hold null or non-finite numbers, vectors of
    another than the most frequent length, and rows without an id take no part. A row isn't its own neighbour; rows
    of one id with the same vector count once, those with different vectors are rows of their own, of which the nearest
    names the id. Further columns are ignored. An empty table gives no row.
    """
    spark, path = vectors.sparkSession, scratch(vectors.sparkSession, "ann-tree")
    rows = stored(usable(vectors), f"{path}/rows")
    classes = stored(vector_classes(rows, most + 1), f"{path}/classes")
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not (n := classes.count()):
        return empty
    tree = spark.sparkContext.broadcast(fit_tree(classes, n))  # at most MOST_LEAVES leaves

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                leaf = pa.array(tree.value.leaf_of(_unit(_matrix(b.column("v")))))
                yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("first_id"), b.column("v"), leaf], ["cid", "first_id", "v", "leaf"])

    placed = stored(classes.select("cid", "first_id", "v").mapInArrow(assign, "cid bigint, first_id bigint, v array<double>, leaf int"), f"{path}/leaves")
    asked = rows.where(query_ids).select("vec_id", "v").join(classes.select("cid", F.col("v").alias("class_v")), F.col("v") == F.col("class_v")).select("vec_id", "cid")
    asked = stored(asked, f"{path}/asked")
    queries = stored(asked.select("cid").distinct().join(placed, "cid").select(F.col("cid").alias("qid"), F.col("v").alias("q")), f"{path}/queries")
    visits = calibrated_visits(tree.value, queries, placed, most + 1, target)
    found = _search(tree, visits, queries, placed, most + 1)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "first_id")
    few = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most + 1).select("qid", "cid", "score")
    named = few.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    named = named.groupBy("qid", "vec_id").agg(F.max("score").alias("score"))  # an id with several vectors
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    few = named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most + 1)
    lists = few.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid")).distinct().join(lists, "qid")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, most)
    # an id with several vectors asks with all of them
    asked_for = own.select("query_id", F.explode(others).alias("x")).groupBy("query_id", "x.vec_id").agg(F.max("x.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return asked_for.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= most)


def brute_force(queries: list[tuple[int, list[float]]], placed: DataFrame, most: int) -> list[tuple[int, int]]:
    """(query's place, leaf) of the `most` nearest classes of each of a few queries, over all classes in blocks."""
    asked = placed.sparkSession.sparkContext.broadcast(np.array([q for _, q in queries], dtype=np.float64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                ids, leaf = b.column("first_id").to_numpy(), b.column("leaf").to_numpy()
                out = [(k, int(ids[p]), int(leaf[p]), float(s)) for k, places, scores in best_classes(asked.value, _matrix(b.column("v")), ids, most) for p, s in zip(places, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.float64()), strict=True)], ["k", "first_id", "leaf", "score"])

    near = placed.select("first_id", "v", "leaf").mapInArrow(scan, "k int, first_id bigint, leaf int, score double")
    place = Window.partitionBy("k").orderBy(F.desc("score"), "first_id")
    return [(r["k"], r["leaf"]) for r in near.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).select("k", "leaf").collect()]


def calibrated_visits(tree: Tree, queries: DataFrame, placed: DataFrame, most: int, target: float) -> int:
    """The fewest leaves to visit with which a sample of queries finds so many of its true neighbours that recall over all queries is `target` or more, but for a chance of about one in a thousand."""
    some = [(r["qid"], r["q"]) for r in queries.orderBy(F.xxhash64("qid"), "qid").limit(CALIBRATION).collect()]
    if not some:
        return 1
    order = [{leaf: k + 1 for k, leaf in enumerate(tree.visit(_unit(np.array([q], dtype=np.float64))[0], tree.leaves))} for _, q in some]
    found = brute_force(some, placed, most)
    if not found:
        return 1
    asked, needed = np.array([k for k, _ in found]), np.array([order[k][leaf] for k, leaf in found])
    each, visits = np.bincount(asked, minlength=len(some)), 1
    while True:  # ends: all neighbours lie in some leaf
        recall = np.bincount(asked, needed <= visits, minlength=len(some))[each > 0] / each[each > 0]
        if recall.mean() - MARGIN * recall.std() / math.sqrt(len(recall)) >= target:
            return visits
        visits += 1


def _search(tree, visits: int, queries: DataFrame, placed: DataFrame, most: int) -> DataFrame:
    """(qid, cid, first_id, score): each query's best classes of its visited leaves, from each chunk of each bin."""
    bin_of, held = {}, {}
    before = 0
    for leaf, n in sorted(placed.groupBy("leaf").count().collect()):  # one row a leaf, bounded by the fitted sample
        bin_of[leaf] = before // CHUNK
        held[bin_of[leaf]] = held.get(bin_of[leaf], 0) + n
        before += n

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                rows, bins, leaves = [], [], []
                for k, x in enumerate(_unit(_matrix(b.column("q")))):
                    ways: dict[int, list[int]] = {}
                    for leaf in tree.value.visit(x, visits):
                        if leaf in bin_of:
                            ways.setdefault(bin_of[leaf], []).append(leaf)
                    rows, bins, leaves = rows + [k] * len(ways), bins + list(ways), leaves + list(ways.values())
                own = b.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([own.column("qid"), own.column("q"), pa.array(bins, pa.int64()), pa.array(leaves, pa.list_(pa.int32()))], ["qid", "q", "bin", "leaves"])

    spark = placed.sparkSession
    sizes = spark.createDataFrame([(leaf, b, -(-held[b] // CHUNK)) for leaf, b in bin_of.items()], "leaf int, bin bigint, chunks bigint")
    turns = max(1, -(-queries.count() * min(visits, len(held)) // (len(held) * QUERIES_A_TASK)))  # more tasks share a bin if very many queries visit it
    routed = queries.mapInArrow(route, "qid bigint, q array<double>, bin bigint, leaves array<int>")
    left = placed.join(F.broadcast(sizes), "leaf").withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks"))).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    right = routed.join(F.broadcast(sizes.select("bin", "chunks").distinct()), "bin").withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))).withColumn("turn", F.pmod(F.xxhash64("qid"), F.lit(turns)).cast("int"))
    keys = ["bin", "chunk", "turn"]

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(asked):
            rows = rows.sort_by([("leaf", "ascending"), ("first_id", "ascending")])
            cid, first, qid, leaf, visited = rows["cid"].to_numpy(), rows["first_id"].to_numpy(), asked["qid"].to_numpy(), rows["leaf"].to_numpy(), asked["leaves"].to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
            parts = [(slice(s, e), np.array([leaf[s] in own for own in visited])) for s, e in zip(edges[:-1], edges[1:], strict=True)]
            pairs = best_classes(_matrix(asked["q"].combine_chunks()), _matrix(rows["v"].combine_chunks()), first, most, parts)
            out = [(int(qid[k]), int(cid[p]), int(first[p]), float(s)) for k, places, scores in pairs for p, s in zip(places, scores, strict=True)]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["qid", "cid", "first_id", "score"])

    right = right.select(*keys, "qid", "q", "leaves").groupBy(*keys)
    return left.select(*keys, "cid", "first_id", "leaf", "v").groupBy(*keys).cogroup(right).applyInArrow(search, "qid bigint, cid bigint, first_id bigint, score double")
