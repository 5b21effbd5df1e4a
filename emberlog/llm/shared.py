"""What several operators need: ASCII words, hashes, folds, and the scratch folder of the library."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.scratch import scratch, stored

__all__ = ["WORD", "document_columns", "give_back_memory", "hot_join", "learning_fold", "mix64", "releasing", "scratch", "shingle_hashes", "stored", "texts_of", "whole_runs", "word_hashes", "words_of"]

#: A word, as Spark's regular expressions write it: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: From how many rows on a key is hot, and the most hot keys that are broadcast.
HOT, MOST_HOT = 500, 100_000


def document_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the caller can't clash with an operator's own."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def learning_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """left joined to right, which has each key once; the keys of very many rows of left by broadcast, the others by a shuffle.

    weight: right's column with the rows that left has of the key, total in all. A key is hot from HOT rows on, or from
    total / MOST_HOT on, so that no more than MOST_HOT keys are broadcast. Both sides are read twice: store them.
    """
    least = max(HOT, -(-total // MOST_HOT))
    hot = F.broadcast(right.where(F.col(weight) >= least))
    rest = left.join(hot, key, "left_anti").join(right.where(F.col(weight) < least), key)
    return left.join(hot, key).unionByName(rest)


def whole_runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, list[int]]]:
    """A sorted partition's rows in tables that no run of equal keys crosses, and where the runs of each start and end."""
    held = None
    for b in batches:
        rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        edges = _edges(rows, keys)
        if len(edges) > 2:
            yield rows.slice(0, edges[-2]), edges[:-1]
        held = rows.slice(edges[-2]) if len(edges) > 1 else None
    if held is not None:
        yield held, [0, len(held)]


def _edges(rows: pa.Table, keys: tuple[str, ...]) -> list[int]:
    if not len(rows):
        return [0]
    differs = np.zeros(len(rows), bool)
    for k in keys:
        column = rows[k].to_numpy()
        differs[1:] |= column[1:] != column[:-1]
    return [0, *np.flatnonzero(differs).tolist(), len(rows)]


def give_back_memory() -> None:
    """Returns what this process has freed to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(work: Callable) -> Callable:
    """A function over a task's Arrow batches that gives memory back at the end: Spark keeps idle workers for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back_memory()

    return run


def texts_of(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The texts of a column, made into Python strings a few rows at a time."""
    for k in range(0, len(column), rows):
        yield from column.slice(k, rows).to_pylist()


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space (space, \\t \\n \\v \\f \\r); bytes.split() means exactly these."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes], seen: dict[bytes, int]) -> np.ndarray:
    """64-bit hash of each word; `seen` saves hashing frequent words again and is emptied when it grows large."""
    if len(seen) > 400_000:
        seen.clear()
    for w in set(words):
        if w not in seen:
            seen[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), so that sums of word hashes spread evenly."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all windows of `width` words; one hash for a shorter sequence, none for none."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    size = min(n, width)
    rolled = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + mix64(hashes[k : n - size + 1 + k] + np.uint64(k))
    return np.unique(mix64(rolled))
