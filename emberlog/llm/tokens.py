"""Token ids of whole texts, the same as the tokenizers or sentencepiece library gives them, at word-cache speed.

A byte-level BPE of GPT-2's kind never joins two words over a single space or line feed: its splitting pattern starts
a new piece at such a space and makes the line feed a piece of its own. So texts whose white space is only single
spaces and line feeds between words are cut there, a column of them at a time: numpy finds the cuts, Arrow numbers the
distinct words and puts their ids back in the texts' order, and Python only sees words that the worker's bounded cache
lacks, each once. Those words' merges run in tiktoken in one call, on ranks read from the same vocabulary file; when an
encoder is loaded, the file's merges are held against its ids and the encoder against the tokenizers library on probe
texts, and it is dropped if anything differs. Every other text
(runs of white space, tabs, special strings) and every other kind of tokenizer goes to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from emberlog.llm.shared import give_back_memory, texts_of

#: Texts of this many bytes (or one longer text) are cut into words at once.
COLUMN_BYTES = 4 << 20
#: A worker's cache grows to this many bytes of words; then only those of the last texts stay.
CACHE_BYTES = 4 << 20
#: The splitting pattern of this family of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A word of a regular text: no white space, as Python and the pattern know it, but a space before it.
REGULAR = r"^ ?[^\x09-\x0D\x1C-\x20\x{85}\pZ]+$"
#: Texts on which words and library must agree before words are trusted.
PROBES = ("The cat's 12th élan, naïve-ly; (ok)!", "ÄÖÜ ßtraße\nnewline 3.14 a_b|c", "don't WE'LL \U0001f44d\U0001f3fd 漢字 кот $%&***", "x" * 90 + " " + "!?" * 40)

_loaded: dict[str, "Encoder"] = {}


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer, or the path itself if one is given."""
    return name if "/" in name else public_tokenizers.path(name)


def version_digest(name: str) -> str:
    """SHA-256 of the tokenizer's file: another vocabulary, another version of every stored count."""
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class WordCache:
    """Ids of words (each with the space before it) as bytes; null marks a piece that a regular text doesn't have.

    Words that the cache lacks are encoded in one call, as lines: a line feed is a token of its own and ends the word.
    """

    def __init__(self, encode_text: Callable[[str], np.ndarray], specials: tuple[str, ...]):
        self.encode_text, self.specials = encode_text, specials
        self.line = encode_text("\n")
        self._keep(pa.array([], pa.large_binary()), pa.array([], pa.large_binary()))

    def _keep(self, words: pa.Array, ids: pa.Array) -> None:
        self.words, self.held = (pa.concat_arrays([pa.array([x], pa.large_binary()), xs]) for x, xs in ((b"\n", words), (self.line.tobytes(), ids)))

    def _encoded(self, words: pa.Array) -> pa.Array:
        regular = pc.match_substring_regex(words, REGULAR)
        for s in self.specials:
            regular = pc.and_not(regular, pc.match_substring(words, s))
        plain = words.filter(regular)
        lines = pc.binary_join(pa.LargeListArray.from_arrays([0, len(plain)], plain), pa.scalar("\n", pa.large_string()))[0]
        ids = self.encode_text(lines.as_py()).astype("<u4", copy=False)
        ends = np.append(np.flatnonzero(ids == self.line[0]), len(ids))
        if len(ends) != max(1, len(plain)):
            raise ValueError("a word's ids hold a line feed's")
        # without the line feeds, and without their places in the ends of words
        offsets, ids = np.append(0, ends - np.arange(len(ends))) * 4, ids[ids != self.line[0]]
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
        regular = regular.to_numpy(zero_copy_only=False)
        return found.take(pa.array(np.cumsum(regular) - 1, pa.int64(), mask=~regular))

    def ids(self, words: pa.Array) -> pa.Array:
        """The ids of each of these distinct words."""
        place = pc.index_in(words, value_set=self.words)
        new = words.filter(place.is_null())
        if not len(new):
            return self.held.take(place)
        encoded = self._encoded(new.cast(pa.large_string()))
        place, lacks = place.fill_null(0).to_numpy().astype(np.int64), place.is_null().to_numpy(zero_copy_only=False)
        place[lacks] = len(self.held) + np.arange(len(new))
        ids = pa.concat_arrays([self.held, encoded]).take(pa.array(place))
        if self.words.nbytes + new.nbytes <= CACHE_BYTES:
            self.words, self.held = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.held, encoded])
        else:
            self._keep(words, ids)
        return ids


def _byte_symbols() -> dict[str, int]:
    """How vocabulary files of this family print bytes: visible Latin-1 as itself, the others from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _word_encoder(said: dict) -> WordCache | None:
    """The words' encoder, or None if the file's tokenizer isn't of the kind above."""
    before, model = said.get("pre_tokenizer") or {}, said.get("model", {})
    plain = said.get("normalizer") is None and said.get("post_processor") is None and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    import tiktoken

    of, special = _byte_symbols(), tuple(t["content"] for t in said.get("added_tokens", []))
    if any(t.split() != [t] for t in special):  # such a string isn't within one word
        return None
    ranks = {bytes(of[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
    # tiktoken takes ids for the order of merges: they must be that, and every longer token the result of a merge
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if None in merged or any(x >= y for x, y in zip(merged, merged[1:])) or set(merged) != {k for token, k in ranks.items() if len(token) > 1}:
        return None
    encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = WordCache(lambda text: encoding.encode_to_numpy(text, disallowed_special=()), special)
    return words if len(words.line) == 1 else None


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        path = tokenizer_path(name)
        self.words: WordCache | None = None
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: pieces.encode(texts, num_threads=1)
            return
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.library = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.words = _word_encoder(said)
        if self.words and self.encode(list(PROBES)) != [array("I", ids).tobytes() for ids in self.library(list(PROBES))]:
            self.words = None

    def _whole(self, text: str) -> bytes:
        return array("I", self.library([text])[0]).tobytes()

    def _regular_texts(self, texts: pa.Array) -> Iterator[bytes | None]:
        """The ids of each text of a column without nulls; None for a text that isn't regular."""
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.empty(0, np.uint8)
        edges = edges - edges[0]
        begins, breaks = np.zeros(len(data) + 1, bool), data == 10
        begins[edges] = True
        feeds, starts = np.flatnonzero(breaks), begins.copy()
        starts[1:] |= breaks
        breaks |= data == 32
        starts[:-1] |= breaks
        # a line feed has a word right before it, which the words themselves tell, and right after it
        after = data[np.minimum(feeds + 1, len(data) - 1)]
        odd = [feeds[begins[feeds] | begins[feeds + 1] | (after == 10) | (after == 32)]]
        cuts = np.flatnonzero(starts)
        del begins, breaks, starts, after  # of the texts' size: gone before the words are made
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        ids, of = self.words.ids(words.dictionary), words.indices
        if ids.null_count:
            odd.append(cuts[np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)[of.to_numpy()])])
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(edges, np.concatenate(odd), "right") - 1] = True
        ids = ids.take(of)
        at = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(cuts, edges)].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return (None if w else bytes(raw[a:b]) for w, a, b in zip(whole.tolist(), at, at[1:], strict=False))

    def encode_column(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text (null: none) as bytes."""
        if self.words is None:
            yield from (self._whole(t) if t else b"" for t in texts_of(column))
            return
        ends, first = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy().astype(np.int64)), 0
        while first < len(column):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + COLUMN_BYTES, "right")))
            part = column.slice(first, last - first).cast(pa.large_binary()).fill_null(b"")
            for k, ids in enumerate(self._regular_texts(part)):
                yield self._whole(part[k].as_py().decode()) if ids is None else ids
            first = last
            give_back_memory()  # else what these texts took stays beside what the next ones take

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return list(self.encode_column(pa.array(texts, pa.large_string())))


def encoder(name: str) -> Encoder:
    """One encoder for each tokenizer and worker process."""
    if name not in _loaded:
        _loaded[name] = Encoder(name)
    return _loaded[name]
