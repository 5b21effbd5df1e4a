"""The pipeline and its stages against plain Python, on null, empty, repeated and clashing rows."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from emberlog.llm import langid, line_dedup, mixing, near_dup
from emberlog.llm.tokens import tokenizer_path

CLASHES = ["gone", "taken_id", "position", "positions", "dropped", "lines", "own_id", "no_text", "row", "set_key", "stays", "part", "kept", "text_hash", "cid", "own_doc_id", "size", "hash", "bucket", "digest", "path", "x"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)
WORDS = {
    "en": "the cat and dog with that thing in house of our town where people talk about weather every single morning before they go".split(),
    "de": "der hund und die katze ist nicht auf dem haus unserer stadt wo leute jeden morgen vom wetter reden bevor sie gehen".split(),
    "fr": "le chien et la maison dans les rues de notre ville ou des gens parlent chaque matin du temps avant leur depart".split(),
    "es": "el perro y la casa de los pueblos donde nuestra gente habla cada manana sobre tiempo antes que salgan juntos ayer".split(),
}


def _text(rng, lang, n=60):
    return "\n".join(" ".join(rng.choice(WORDS[lang], 12)) for _ in range(n // 12))


def _rows():
    rng, rows = np.random.default_rng(3), []
    for k in range(160):
        lang = list(WORDS)[k % 4]
        rows.append((k, _text(rng, lang), lang, "abc"[k % 3]))
    copy = rows[20][1]
    rows += [(200, copy, "en", "a"), (201, copy.replace("the", "a", 1), "en", None), (202, None, None, "b"), (203, "", None, "b"), (204, "12 ! 34", None, "a")]
    rows += [(5, _text(rng, "fr"), "fr", "b"), (5, rows[7][1], None, "a"), (7, rows[7][1], "fr", "a"), (7, rows[7][1], "fr", "a")]  # other texts of an id, repeated rows
    rows += [(None, _text(rng, "es"), "es", "c"), (None, _text(rng, "de"), None, None), (None, copy, "en", "a"), (None, copy, "en", "a")]
    return [(d, t, lang, s, None if t is None else len(t), *[f"{c}{k % 5}" for c in CLASHES]) for k, (d, t, lang, s) in enumerate(rows)]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _counted(rows):
    return Counter(tuple(map(repr, r)) for r in rows)


def lines_stage(rows):
    """Rows without the lines of at least 10 code points that a smaller id holds."""
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    ident = lambda r: float("inf") if r[0] is None else r[0]
    holders: dict[str, set] = {}
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(ident(r))
    out = []
    for r in rows:
        text = None if r[1] is None else "\n".join(x for x in r[1].split("\n") if ident(r) == min(holders.get(key(x), {ident(r)})))
        out.append((r[0], text, r[2], r[3], None if text is None else len(text), *r[5:]))
    return out


def groups_of(rows, threshold=80):
    """The group of each row by all pairs, None without words."""
    words = [tuple((r[1] or "").encode().lower().split()) for r in rows]
    sets = [frozenset(w[i : i + 5] for i in range(max(1, len(w) - 4))) if w else None for w in words]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
    return [None if s is None else r for s, r in zip(sets, root, strict=True)]


def test_language_stage(docs, nothing):
    model = langid.learn(docs)
    langs, scores = model.predict([r[1] for r in ROWS])
    expected = [r for r, lang, s in zip(ROWS, langs, scores, strict=True) if lang != "und" and s >= 0.3]
    got = langid.identified_documents(docs)
    assert got.columns == docs.columns and _counted(got.collect()) == _counted(expected)
    assert all(r[1] and any(c.isalpha() for c in r[1]) for r in expected) and len(expected) > 150
    assert langid.identified_documents(nothing).count() == 0


def test_lines_stage(docs, nothing):
    got = line_dedup.documents_without_repeated_lines(docs)
    assert got.columns == docs.columns and _counted(got.collect()) == _counted(lines_stage(ROWS))
    assert line_dedup.documents_without_repeated_lines(nothing).count() == 0


def _check_distinct(rows, got, groups):
    """One row of each group stays, of its smallest id (null last); rows without words all stay; no other text is lost."""
    of_text = {r[1]: g for r, g in zip(rows, groups, strict=True)}
    counted = Counter(of_text[r[1]] for r in got)
    assert all(n == 1 for g, n in counted.items() if g is not None) and set(counted) == set(groups)
    assert counted[None] == groups.count(None)
    ident = lambda r: (r[0] is None, r[0] or 0)
    for r in got:
        if (g := of_text[r[1]]) is not None:
            assert ident(r) == min(ident(x) for x, y in zip(rows, groups, strict=True) if y == g)
    assert not _counted(got) - _counted(rows)


def test_near_copies_stage(docs, nothing, spark):
    got = near_dup.distinct_documents(docs)
    assert got.columns == docs.columns
    _check_distinct(ROWS, got.collect(), groups_of(ROWS))
    assert near_dup.distinct_documents(nothing).count() == 0
    a, b = "one two three four five six seven", "nine ten eleven twelve thirteen fourteen"
    three = spark.createDataFrame([(1, a), (5, a), (5, b)], "doc_id bigint, text string")
    assert sorted(map(tuple, near_dup.distinct_documents(three).collect())) == [(1, a), (5, b)]
    two = spark.createDataFrame([(7, a), (7, a), (8, ""), (8, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, near_dup.distinct_documents(two).collect())) == [(7, a), (8, ""), (8, "")]


def test_mixing_stage(docs, nothing):
    taken = Counter()
    for r in mixing.mix(docs).where("taken > 0").collect():
        taken[r["doc_id"], r["source"], r["size"]] += (2 * r["taken"] + r["size"]) // (2 * r["size"])
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert Counter((r["doc_id"], r["source"], len(r["text"].encode().split())) for r in rows) == +taken
    assert {tuple(map(repr, r)) for r in rows} <= set(_counted(ROWS)) and not any(r["text"] in (None, "") for r in rows)
    assert mixing.mixed_documents(nothing).count() == 0


def test_run(spark, docs, nothing, tmp_path):
    """The whole run: each stage's rows from the stage before, and the packed pieces against the library's ids."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = stage(spark, before, str(tmp_path))
        before.write.parquet(f"{tmp_path}/{name}")
        before = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = before.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    assert _counted(kept["line_dedup"]) == _counted(lines_stage([tuple(r) for r in kept["language_id"]]))
    lines = [tuple(r) for r in kept["line_dedup"]]
    _check_distinct(lines, kept["near_dedup"], groups_of(lines))
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = [(r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in kept["mix_sources"]]
    assert Counter((repr(d), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids) == Counter((repr(r["doc_id"]), r["length"], r["ids_crc32"]) for r in kept["pack_sequences"])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    pieces = lambda rows: Counter((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert pieces(packed.collect()) == pieces(kept["pack_sequences"])
    nothing.write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
