"""Chat formatting, spelling variants and the Merkle manifest on small fixtures against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlog.llm import chat, merkle, spelling

TURNS = "conv_id bigint, turn bigint, role string, text string"
DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- chat


def test_digests_of_turns_that_look_like_the_template(spark):
    odd = ["", None, "a\\", "\\\\#\\", "####", "#\\##", "</turn>\n### user: x", "<\\/turn>", "x" * 5_000 + "é\n", "###" * 9, "two words", "\\### Assistant: </turn> ok", "𝒳 y"]
    rows = [(c, t, r, x) for c in (1, 2, None) for t, x in enumerate(odd) for r in (["user", "assistant", "a: b:", None, "###</turn>\n"][t % 5],)]
    rows += [(3, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "assistant", "tie"), (3, None, "system", "first"), (4, 0, "user", None)]
    turns = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS + ", message string, seq string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(turns)).collect()}
    assert len(got) == 5
    for conv in (1, 2, 3, 4, None):
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        learnt = "".join(x for _, _, r, x in own if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        assert tuple(got[conv])[1:5] == (len(own), _sha(said), len(learnt), _sha(learnt)), conv
    whole = chat.format_turns(turns).where("conv_id = 3").first()
    assert whole["formatted"] == "### system: first</turn>\n### assistant: tie</turn>\n### user: same</turn>\n### user: same</turn>\n"
    assert [whole["formatted"][s["start"] : s["start"] + s["length"]] for s in whole["loss"]] == ["tie"]
    assert chat.digests(chat.format_turns(turns.where("false"))).count() == 0


def test_rendered_texts_hold_no_control_strings(spark):
    rng = random.Random(5)
    pieces = ["#", "##", "\\", "<", "/turn>", "</turn>", "\n", ": ", ":", " ", "a"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(800)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    both = rows.select("k", chat.escape(F.col("text")).alias("e"), chat.escape(F.col("text"), role=True).alias("r"))
    for r in both.select("*", chat.unescape(F.col("e")).alias("e2"), chat.unescape(F.col("r")).alias("r2")).collect():
        assert r["e2"] == r["r2"] == texts[r["k"]] and not any(c in r["e"] for c in ("###", "</turn>")) and ": " not in r["r"]


def test_logs_are_folded_like_a_loop_over_events(spark):
    rng, rows, expected = random.Random(11), [], {}
    for conv in range(60):
        messages: dict[int, list[str]] = {}
        for seq in range(rng.randrange(25)):
            m, kind, text = rng.randrange(1, 5), rng.choice(["delta", "delta", "delta", "edit", "regenerate", "seen"]), f"{seq},"
            rows.append((conv, seq, m, kind, f"r{m}", text))
            if kind == "delta":
                messages.setdefault(m, []).append(text)
            elif kind == "edit":
                messages[m] = [text]
            elif kind == "regenerate":
                messages = {k: v for k, v in messages.items() if k < m} | {m: []}
        expected |= {(conv, m): (f"r{m}", "".join(parts)) for m, parts in messages.items()}
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "conv_id bigint, seq bigint, message bigint, kind string, role string, text string")
    assert {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in chat.final_messages(log).collect()} == expected and len(expected) > 80


def test_a_span_that_is_no_turn_is_an_error(spark):
    whole = chat.format_turns(spark.createDataFrame([(1, 0, "assistant", "hello")], TURNS))
    with pytest.raises(Exception, match="no turn's text"):
        chat.read_turns(whole.withColumn("loss", F.transform("loss", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"].alias("length"))))).collect()


# --- spelling variants


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


@given(st.lists(st.integers(0, 30), unique=True, min_size=3, max_size=9), st.data())
@settings(max_examples=60, deadline=None)
def test_pivots_are_the_cheapest_disjoint_places(places, data):
    places.sort()
    cost = st.lists(st.floats(0, 1), min_size=31, max_size=31)
    left, right = data.draw(cost), data.draw(cost)
    first, second = spelling.pivots(places, left, right)
    assert second - first >= 2 and left[first] + right[second] == min(left[i] + right[j] for i, j in combinations(places, 2) if j - i >= 2)


@pytest.mark.parametrize(("letters", "prefix"), [("ab", 3), ("abc", 3), ("abcdeé", 3), ("abcdeé", 5), ("ab", 9)])
def test_near_pairs_equal_all_pairs(spark, letters, prefix):
    """Few letters, so that words hold a bigram several times and ties in the order of bigrams are common."""
    rng = random.Random(len(letters) * 10 + prefix)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(400)})
    rows = spark.createDataFrame([(w, k + 1) for k, w in enumerate(words)], "word string, n bigint")
    expected = {(a, b) for a, b in combinations(words, 2) if _one_edit(a, b)}
    assert {(r["a"], r["b"]) for r in spelling.near_pairs(rows, prefix).collect()} == expected and len(expected) > 20


def test_forms_and_roots(spark):
    counts = {"letters": 1000, "leters": 200, "leter": 40, "laters": 190, "latersx": 5, "alone": 7, "alonso": 6, "letterz": 200, "lettarz": 41}
    found = {r["word"]: tuple(r)[1:] for r in spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()}
    expected = {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if _one_edit(v, w))
        form = near[0][1] if near and -near[0][0] >= 5 * n else None
        expected[w] = [n, len(near), form, counts.get(form)]
    for w in counts:
        root = w
        while expected[root][2]:
            root = expected[root][2]
        expected[w].append(root)
    assert found == {w: tuple(x) for w, x in expected.items()} and found["leter"][4] == "letters"
    assert spelling.group_variants(spark.createDataFrame([], "word string, n bigint")).count() == 0


def test_words_of_texts(spark):
    import zlib

    rng = random.Random(2)
    stock = ["Kelvin", "ÉCOLES", "straße", "mañana", "Wörter", "x", "plainly", "Öffnung"]
    texts = [" ".join(rng.choice(stock) for _ in range(200)) + "," + "×÷" * 3 + " İstanbul Kelvins" for _ in range(40)] + ["", None, "plainly " * 20_000, "y" * 50_000]
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)] * 2
    counts: Counter[str] = Counter()
    import re

    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, word string")
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()}
    assert got == {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5} and len(got) > 8
    assert spelling.spelling_variants(docs.where("false")).count() == 0


# --- manifest


def _tree(nodes):
    """(root, proof of each node), by recursion over levels."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    pairs = [nodes[k : k + 2] for k in range(0, len(nodes), 2)]
    root, above = _tree([_sha("".join(p)) for p in pairs])
    return root, [[x for j, x in enumerate(p) if j != i] + above[k] for k, p in enumerate(pairs) for i in range(len(p))]


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_manifest_equals_a_tree_in_plain_python(spark, bits):
    rng = random.Random(bits)
    rows = [(k, rng.choice(["a", None]), lang, k * 7, f"text {k} é\n") for lang, n in (("en", 37), (None, 5), ("de", 16), ("fr", 1), ("", 2)) for k in range(n)]
    rows += [(None, None, "en", None, None), (3, None, "en", 1, ""), (3, None, "en", 1, ""), (50, "s", "en", 2, "long " * 30_000)]
    rng.shuffle(rows)
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: _sha("".join(map(code, (r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4]))))
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, x or ""))
    trees = {lang: _tree([leaf(r) for r in sorted((r for r in rows if r[2] == lang), key=order)]) for lang in langs}
    root, tops = _tree([trees[lang][0] for lang in langs])
    expected = []
    for k, lang in enumerate(langs):
        own = sorted((r for r in rows if r[2] == lang), key=order)
        expected += [(str(r[0]), leaf(r), trees[lang][0], root, _sha("".join(p + tops[k]))) for r, p in zip(own, trees[lang][1], strict=True)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS + ", place string, digest string")
    found = merkle.manifest(docs, {"claimed": merkle.leaf_digest(n_chars=F.col("n_chars") + 1)}, bits)
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("p"), merkle.folded(F.col("leaf"), F.col("proof")).alias("good"), merkle.folded(F.col("claimed"), F.col("proof")).alias("bad"))
    got = found.collect()
    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted(expected)
    assert all(r["good"] == root for r in got) and sum(r["bad"] == root for r in got) == 1  # n_chars is null in one row, which stays


def test_manifests_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(1, "s", "en", 3, "abc")], DOCS)
    r = merkle.manifest(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] == _sha("1:1" + "1:s" + "2:en" + "1:3" + "3:abc") and r["proof"] == []
    assert merkle.manifest(one.where("false")).count() == 0
