"""Statistics of whole texts for the quality operators, one Arrow pass over the documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberlog.llm.shared import document_columns, releasing, texts_of, word_hashes

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
#: Counts of a text, in this order. All are exact.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_top_word", "n_upper", "n_digits", "n_marks", "n_short_words")
UPPER, DIGITS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?;:"


def _held(data: bytes, of: bytes) -> int:
    return len(data) - len(data.translate(None, of))


def repeated_words(hashes: np.ndarray, width: int = 3) -> int:
    """Words inside windows of `width` words that are found at least twice, the first place included."""
    n = len(hashes)
    if n <= width:
        return 0
    windows = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= twice
    return int(covered.sum())


def text_counts(text: str | None, seen: dict[bytes, int]) -> tuple[int, ...]:
    """COUNTS of one text; null and empty texts have zeros."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    hashes = word_hashes(words, seen)
    lines = [x for x in data.split(b"\n") if x.strip()]
    _, counts = np.unique(hashes, return_counts=True)
    short = sum(map((4).__gt__, map(len, words)))
    return (len(words), len(text) - _held(data, SPACE), _held(data, SYMBOLS), len(lines) - len(set(lines)), repeated_words(hashes), len(lines), len(counts), int(counts.max(initial=0)), _held(data, UPPER), _held(data, DIGITS), _held(data, MARKS), short)


def with_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns of docs and COUNTS of the whole text."""
    own = document_columns(docs, *keep, "text")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name != "text"), *(f"{c} bigint" for c in COUNTS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in batches:
            rows = [text_counts(t, seen) for t in texts_of(b.column("text"))]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *columns], [*keep, *COUNTS])

    return own.mapInArrow(releasing(count), schema)
