"""Merkle manifest of a dataset by time-forward processing.

Leaves are digests of documents, in order of id inside each language; every two neighbours become the digest of both, a
last one without a neighbour the digest of itself alone, until one node is left: the language's subroot. Subroots, in
order of language, become the root in the same way.

Upwards, nodes are worked through in the order of their labels (level, place), and a digest is a message to the label of
the parent, waiting in a priority queue until its turn. The queue is external: a task takes a block of 2^BITS leaves
that follow each other, whose messages fit into a heap; what goes to labels above the block waits in a table, which the
next round deals out and sorts by label. So the work of 2^(2 BITS) leaves takes two rounds, and no task or driver sees
more than a block. Downwards, labels are worked through in reverse: each node gives its children the siblings on its own
way to the root, behind the child's sibling, so that a leaf gets its proof; between rounds these wait in the same table.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import document_columns, releasing, scratch, stored, whole_runs
from emberlog.operators.ranks import numbered

#: A block has 2^BITS leaves.
BITS = 12
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a proof: the sibling's digest (null: the node has none) and whether it stands to the left.
STEP = pa.struct([("digest", pa.string()), ("left", pa.bool_())])
PROOF = "array<struct<digest:string,left:boolean>>"

Step = tuple[str | None, bool]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field_code(value: Column) -> Column:
    """`-` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row's FIELDS; a field that is named takes the value given."""
    return F.sha2(F.concat(*[field_code(changed.get(f, F.col(f))) for f in FIELDS]).cast("binary"), 256)


def climb(leaves: list[str], height: int) -> list[list[str]]:
    """The digests of a block's nodes by level, its leaves first, up to `height` levels above them."""
    levels, queue = [leaves] + [[] for _ in range(height)], []
    for place, d in enumerate(leaves if height else []):
        heapq.heappush(queue, (1, place >> 1, place, d))
    while queue:
        level, place, _, first = heapq.heappop(queue)
        parts = [first]
        while queue and queue[0][:2] == (level, place):  # all messages to this label have come
            parts.append(heapq.heappop(queue)[3])
        levels[level].append(digest(*parts))
        if level < height:
            heapq.heappush(queue, (level + 1, place >> 1, place, levels[level][-1]))
    return levels


def descend(levels: list[list[str]], above: list[Step]) -> list[list[Step]]:
    """The proof of each leaf of a block: siblings from the leaf up, with `above`, those of the block's top, at the end."""
    ways: list[tuple] = [()]  # of the level's nodes: (step, way of the parent), shared by all below
    for nodes in reversed(levels[:-1]):
        ways = [((nodes[k ^ 1] if k ^ 1 < len(nodes) else None, bool(k & 1)), ways[k >> 1]) for k in range(len(nodes))]
    out = []
    for way in ways:
        steps = []
        while way:
            steps.append(way[0])
            way = way[1]
        out.append(steps + above)
    return out


def _height(total: int, bits: int) -> int:
    """Levels that the blocks of a group of `total` nodes climb: `bits` if there are more blocks, else up to one node."""
    return bits if total > 1 << bits else max(total - 1, 0).bit_length()


def _dealt(nodes: DataFrame, bits: int, *first: str) -> DataFrame:
    """nodes (group, place, total, ...) dealt out by block, in order in each; rows with a column of `first` that is true come first."""
    return nodes.withColumn("block", F.shiftright("place", bits)).repartition("group", "block").sortWithinPartitions("group", "block", *[F.desc(c) for c in first], "place")


def _tops(nodes: DataFrame, bits: int) -> DataFrame:
    """(group, place, total, digest): the top of each block, a node of the next round."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in whole_runs(batches, "group", "block"):
            runs = list(zip(edges[:-1], edges[1:], strict=True))
            groups, places, totals, tops = [], [], [], []
            for a, b in runs:
                total = rows["total"][a].as_py()
                groups.append(rows["group"][a].as_py())
                places.append(rows["block"][a].as_py())
                totals.append(-(-total // (1 << bits)))
                tops.append(climb(rows["digest"].slice(a, b - a).to_pylist(), _height(total, bits))[-1][0])
            yield pa.RecordBatch.from_pydict({"group": groups, "place": pa.array(places, pa.int64()), "total": pa.array(totals, pa.int64()), "digest": tops})

    dealt = _dealt(nodes.select("group", "place", "total", "digest"), bits)
    return dealt.mapInArrow(releasing(work), "group string, place bigint, total bigint, digest string")


def _delivered(nodes: DataFrame, messages: DataFrame, bits: int) -> DataFrame:
    """nodes (group, place, total, digest, tag) with proof: messages (group, place, proof) are those of their blocks' tops."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in whole_runs(batches, "group", "block"):
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                above = [(s["digest"], s["left"]) for s in rows["proof"][a].as_py()]
                own = rows.slice(a + 1, b - a - 1)
                total = own["total"][0].as_py()
                proofs = descend(climb(own["digest"].to_pylist(), _height(total, bits)), above)
                offsets, flat = [0], [s for p in proofs for s in p]
                for p in proofs:
                    offsets.append(offsets[-1] + len(p))
                steps = pa.StructArray.from_arrays([pa.array([d for d, _ in flat], pa.string()), pa.array([x for _, x in flat], pa.bool_())], fields=list(STEP))
                table = pa.table({c: own[c] for c in ("group", "place", "digest", "tag")} | {"proof": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)})
                yield from table.to_batches(max_chunksize=1024)

    rows = nodes.select("group", "place", "total", "digest", "tag", F.lit(None).cast(PROOF).alias("proof"), F.lit(False).alias("message"))
    sent = messages.select("group", F.shiftleft("place", bits).alias("place"), F.lit(None).cast("bigint").alias("total"), F.lit("").alias("digest"), F.lit(None).cast(nodes.schema["tag"].dataType).alias("tag"), "proof", F.lit(True).alias("message"))
    dealt = _dealt(rows.unionByName(sent), bits, "message")
    tag = nodes.schema["tag"].dataType.simpleString()
    return dealt.mapInArrow(releasing(work), f"group string, place bigint, digest string, tag {tag}, proof {PROOF}")


def _rounds(nodes: DataFrame, path: str, bits: int) -> list[DataFrame]:
    """nodes, and the tops of each round, down to one a group; all stored."""
    levels, most = [nodes], nodes.agg(F.max("total").alias("most")).first()["most"] or 1
    while True:
        levels.append(stored(_tops(levels[-1], bits), f"{path}/{len(levels)}"))
        most = -(-most // (1 << bits))
        if most <= 1:
            return levels


def _proofs(levels: list[DataFrame], messages: DataFrame, path: str, bits: int) -> DataFrame:
    """The nodes of the first round with their proofs; messages: the proofs of the last round's nodes."""
    for k in range(len(levels) - 2, 0, -1):
        below = _delivered(levels[k].withColumn("tag", F.lit(0).cast("bigint")), messages, bits)
        messages = stored(below.select("group", "place", "proof"), f"{path}/down{k}")
    return _delivered(levels[0], messages, bits)


def manifest(docs: DataFrame, carried: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, and the names of carried): a row for each of docs (the columns FIELDS).

    proof: the steps from the leaf to the root, (digest of the sibling or null, whether it is the left one). carried:
    text columns made of the documents' rows, which come along with their leaves.

    Nulls are coded as such; a null language is the first, a null id the first of its language. Rows of one id are
    ordered by their leaves, and equal rows are leaves of their own. Further columns are ignored. A table of one row has
    its leaf as root and an empty proof; an empty table gives no row.
    """
    spark, carried = docs.sparkSession, carried or {}
    path = scratch(spark, "merkle")
    own = document_columns(docs, *FIELDS)
    group = F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "lang"))
    leaves = own.select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), *[c.alias(k) for k, c in carried.items()]).alias("tag"), group.alias("group"), leaf_digest().alias("digest"))
    leaves = stored(leaves, f"{path}/leaves")
    placed = numbered(leaves, F.col("tag.doc_id").asc_nulls_first(), F.col("digest"), groups=("group",), name="place", total="total")
    nodes = stored(placed.withColumn("place", F.col("place") - 1), f"{path}/nodes")
    levels = _rounds(nodes, f"{path}/langs", bits)
    # a row a language: numbered like leaves, then trees and proofs of their own
    langs = numbered(levels[-1].select("group", "digest"), F.col("group"), name="place", total="total")
    langs = stored(langs.select(F.lit("").alias("group"), (F.col("place") - 1).alias("place"), "total", "digest", F.col("group").alias("tag")), f"{path}/subroots")
    tree = _rounds(langs, f"{path}/top", bits)
    empty = F.array().cast(PROOF)
    tops = stored(_proofs(tree, tree[-1].select("group", "place", empty.alias("proof")), f"{path}/top", bits), f"{path}/tops")
    ends = tops.select("group", F.col("tag").alias("own"), F.col("digest").alias("subroot")).join(tree[-1].select("group", F.col("digest").alias("root")), "group").drop("group")
    ends = stored(ends, f"{path}/ends")
    proven = _proofs(levels, tops.select(F.col("tag").alias("group"), F.lit(0).cast("bigint").alias("place"), "proof"), f"{path}/langs", bits)
    joined = proven.join(ends, F.col("group") == F.col("own"))
    return joined.select("tag.doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof", *[F.col("tag")[k].alias(k) for k in carried])


def proof_digest(proof: Column) -> Column:
    """The digest of a proof's siblings, those that there are."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["digest"]), "").cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""

    def step(below: Column, s: Column) -> Column:
        sibling = F.coalesce(s["digest"], F.lit(""))
        return F.sha2(F.when(s["left"], F.concat(sibling, below)).otherwise(F.concat(below, sibling)).cast("binary"), 256)

    return F.aggregate(proof, leaf, step)
