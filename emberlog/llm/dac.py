"""Token ids in files of directly addressable codes.

Ids are split into chunks of 8 bits, low chunk first. Level 0 holds the first chunk of every id, level k the k-th
chunk of the ids that are long enough; a bitmap on each level says which ids go on, and a rank directory (ones before
each 512 bits) turns a place on one level into the place on the next. Any id, or any run of ids, is read by a few
look-ups, without decoding what stands before it.

A corpus becomes a Parquet table of segments in ascending doc_id order. A segment holds the codes of whole documents,
at most `segment_tokens` ids or one document.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.shared import document_columns, releasing, scratch
from emberlog.llm.tokens import Encoder, encoder

MAGIC = b"DAC1"
#: Bits that one entry of a rank directory covers.
BLOCK = 512
SEGMENT_TOKENS = 1 << 20
#: Places that one task looks up, about, and how far two of them may lie apart to be read together.
POSITIONS, NEIGHBOURS = 200_000, 256
SEGMENT_SCHEMA = "part int, segment int, part_start bigint, doc_ids array<bigint>, lengths array<bigint>, codes binary"


def encode_codes(ids: np.ndarray) -> bytes:
    """The codes of unsigned 32-bit ids: header, then for each level its count, chunks, bitmap and rank directory."""
    levels, rest = [], ids.astype(np.uint32)
    while len(levels) == 0 or len(rest):
        more = rest > 0xFF
        bits = np.packbits(np.pad(more, (0, -len(more) % BLOCK)), bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.empty(0, np.uint64)
        directory = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else ones
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + directory.astype("<u4").tobytes())
        rest = rest[more] >> 8
    return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class DirectCodes:
    """Random access to the ids in a buffer that encode_codes made."""

    def __init__(self, buffer: bytes):
        if buffer[:4] != MAGIC:
            raise ValueError("not a buffer of directly addressable codes")
        (n_levels,), at = struct.unpack_from("<I", buffer, 4), 8
        self.levels = []
        for _ in range(n_levels):
            (n,), at = struct.unpack_from("<Q", buffer, at), at + 8
            blocks = -(-n // BLOCK)
            chunks, at = np.frombuffer(buffer, np.uint8, n, at), at + n
            bits, at = np.frombuffer(buffer, np.uint8, blocks * BLOCK // 8, at), at + blocks * BLOCK // 8
            directory, at = np.frombuffer(buffer, "<u4", blocks, at), at + 4 * blocks
            self.levels.append((chunks, bits, directory))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Ones before place i: one entry of the directory and the bits of at most one block."""
        block, first = i // BLOCK, i // BLOCK * (BLOCK // 8)
        return (int(directory[block]) if block < len(directory) else int(directory[-1]) + int(np.unpackbits(bits[-(BLOCK // 8) :]).sum()) if len(directory) else 0) + int(np.unpackbits(bits[first : i // 8 + 1], bitorder="little")[: i - first * 8].sum())

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1 as unsigned 32-bit integers."""
        if not 0 <= a <= b <= len(self):
            raise IndexError(f"{a}:{b} of {len(self)} ids")
        out, places, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for chunks, bits, directory in self.levels:
            out[places] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            places = places[more]
            if not len(places):
                break
            a = self._rank(bits, directory, a)
            b, shift = a + len(places), shift + 8
        return out


def _segments(batches: Iterator[pa.RecordBatch], enc: Encoder, part: int, tail: bytes, segment_tokens: int) -> Iterator[pa.RecordBatch]:
    """The segments of a task's batches (doc_id, text), whose texts are encoded a column at a time."""
    segment, start, held = 0, 0, 0
    doc_ids: list[int | None] = []
    ids: list[bytes] = []

    def flush() -> pa.RecordBatch:
        rows = [[part], [segment], [start], [doc_ids], [[len(x) // 4 for x in ids]], [encode_codes(np.frombuffer(b"".join(ids), "<u4"))]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], ["part", "segment", "part_start", "doc_ids", "lengths", "codes"])

    for b in batches:
        for doc_id, own in zip(b.column("doc_id").to_pylist(), enc.encode_column(b.column("text")), strict=True):
            own += tail
            if doc_ids and held + len(own) // 4 > segment_tokens:
                yield flush()
                segment, start, doc_ids, ids, held = segment + 1, start + held, [], [], 0
            doc_ids.append(doc_id)
            ids.append(own)
            held += len(own) // 4
    if doc_ids:
        yield flush()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encodes whole texts (null: empty), appends end_id to each document, and writes segments in ascending doc_id order.

    Rows are dealt by ranges of doc_id (null ids first) and sorted in each; rows of one id, or of none, are ordered and
    dealt by a hash of the text, so that reruns write the same files. An empty table gives an empty set of segments.
    """
    own = document_columns(docs, "doc_id", "text").withColumn("hash", F.xxhash64("text"))
    ranged = own.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _segments(batches, encoder(tokenizer), TaskContext.get().partitionId(), tail, segment_tokens)

    ranged.mapInArrow(releasing(segments), SEGMENT_SCHEMA).write.option("compression", "zstd").parquet(path)


def _with_starts(spark: SparkSession, path: str) -> DataFrame:
    """Segments with `start`, the ids of all segments before. Broadcast: one row for each partition that wrote files."""
    table = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    size = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    totals = table.groupBy("part").agg(F.sum(size).alias("total"))
    before = totals.selectExpr("part", "coalesce(sum(total) over (order by part rows between unbounded preceding and 1 preceding), 0) as before")
    return table.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("part_start")).drop("before")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, and its ids if asked for."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                r = b.slice(k, 1).to_pylist()[0]
                codes, lengths = DirectCodes(r["codes"]), np.array(r["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                whole = codes.slice(0, len(codes)).astype("<u4")  # all documents are read, so the segment is taken apart at once
                raw, spans = memoryview(whole).cast("B"), list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["start"] + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(raw[4 * a : 4 * e]) for a, e in spans], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([whole[a:e].astype(np.int64) for a, e in spans], pa.list_(pa.int64()))] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return _with_starts(spark, path).select("start", "doc_ids", "lengths", "codes").mapInArrow(releasing(decode), schema)


def read_tokens(positions: DataFrame, path: str) -> DataFrame:
    """positions (position) with token_id: the id at each global place of the files, null outside of them.

    Places meet the segments of their range of SEGMENT_TOKENS places, POSITIONS of them or fewer in one task, so a range
    that is asked for very often is dealt to several. A task takes each segment's codes apart once and reads its
    places in order, neighbours together. A null place has a null id. Further columns are ignored.
    """
    spark, width = positions.sparkSession, SEGMENT_TOKENS
    size = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    table = _with_starts(spark, path).withColumn("end", F.col("start") + size).where("end > start")
    table = table.withColumn("range", F.explode(F.expr(f"sequence(start div {width}, (end - 1) div {width})"))).select("range", "start", "end", "codes")
    # a place that is asked for often is looked up once
    asked = positions.groupBy(F.col("position").cast("bigint").alias("position")).agg(F.count("*").alias("times")).withColumn("range", F.coalesce(F.expr(f"position div {width}"), F.lit(-1)))
    deals = asked.groupBy("range").agg(F.ceil(F.count("*") / POSITIONS).cast("bigint").alias("deals"))
    asked = asked.join(deals, "range").withColumn("deal", F.pmod(F.xxhash64("position"), F.col("deals"))).select("range", "deal", "position", "times")
    table = table.join(deals, "range").withColumn("deal", F.explode(F.expr("sequence(0L, deals - 1)"))).drop("deals")

    def access(wanted: pa.Table, segments: pa.Table) -> pa.Table:
        places = pc.fill_null(wanted["position"], -1).to_numpy()
        order = np.argsort(places, kind="stable")
        own, ids, known = places[order], np.zeros(len(places), np.int64), np.zeros(len(places), bool)
        for start, end, codes in zip(segments["start"].to_pylist(), segments["end"].to_pylist(), segments["codes"], strict=True):
            first, last = np.searchsorted(own, [start, end])
            if first == last:
                continue
            held, here = DirectCodes(codes.as_buffer()), own[first:last] - start
            edges = np.concatenate([[0], np.flatnonzero(np.diff(here) > NEIGHBOURS) + 1, [len(here)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):  # a run of near places is one slice
                ids[order[first + a : first + b]] = held.slice(int(here[a]), int(here[b - 1]) + 1)[here[a:b] - here[a]]
            known[order[first:last]] = True
        return pa.table({"position": wanted["position"], "token_id": pa.array(ids, pa.int64(), mask=~known), "times": wanted["times"]})

    found = asked.groupBy("range", "deal").cogroup(table.groupBy("range", "deal")).applyInArrow(access, "position bigint, token_id bigint, times bigint")
    return found.select("position", "token_id", F.explode(F.expr("sequence(1L, times)"))).drop("col")


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes docs as files in the shared scratch folder and reads every document back from them."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_documents(spark, path)
