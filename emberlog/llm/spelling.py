"""Grouping of spelling variants: words that are one edit apart, found by pivotal grams.

A word's bigrams stand in one order for all words, rare ones first. Its prefix is the first PREFIX of them and all that
are as rare as the last one of these; a prefix needs at least 2 * 1 + 1, so that it holds two disjoint ones. Of two words
one edit apart, the edit spoils at most one of two disjoint bigrams of the one, the pivots; the other stands in the
other word too, and in that word's prefix if the prefix reaches as far in the order. So the pivots of each word are
looked up in the index of prefixes whose last bigram isn't before its own.

Positions limit the look-up: an edit that spares the left pivot lies behind it (or spoils the right one), so all letters
up to the left pivot's end are those of the other word; else all letters from the right pivot on are. The key of an index
row is therefore the bigram with these letters and the word's length, which may differ by one. Which two disjoint bigrams
of the prefix are the pivots is chosen by dynamic programming, for the least expected length of the two lists, from the
counts of bigrams. What is found is verified by letters' parities (an edit changes two at most) and the edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import document_columns, releasing, scratch, stored, texts_of

#: Bigrams in a word's prefix, at least.
PREFIX = 5
SHORTEST, LEAST_SEEN = 6, 5
#: A form is this many times as frequent as the word that it stands for, at least.
TIMES = 5
#: One run in so many loses a letter: misspellings that can be told from the text.
SPOILT = 199
#: More bigrams than two letters of A-Z and U+00C0-U+00FF without A-Z's lower case make: the bound of what the driver gets.
MOST_GRAMS = 90 * 90
GRAM_ROWS = "pivot boolean, key bigint, reach int, letters bigint, word string, n bigint"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased. lower() does just that for texts of ASCII and of letters that are lower-case already."""
    return F.when(text.rlike(r"[^\x00-\x7fß-ÿ]"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def word_counts(docs: DataFrame, spoilt: int = SPOILT, shortest: int = SHORTEST, least: int = LEAST_SEEN) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) of at least `shortest` letters that are found at least `least` times.

    Counted in the tasks before the shuffle, so a very frequent word is a row a task. Shorter runs can't give a word,
    so they aren't taken out of the text.
    """
    own = document_columns(docs, "doc_id", "text")
    runs = own.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(rf"[a-zÀ-ÿ]{{{shortest},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    word = F.when(h % spoilt == 0, F.concat(F.left("run", at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.char_length("word") >= shortest) & (F.col("n") >= least))


def _gram_order(words: DataFrame) -> dict[str, int]:
    """The count of each bigram among the words, rarest first: MOST_GRAMS entries at most, whatever the input."""
    each = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda k: F.substring("word", k, F.lit(2)))).alias("gram"))
    found = each.groupBy("gram").agg(F.count("*").alias("n")).orderBy("n", "gram").limit(MOST_GRAMS).collect()
    return {r["gram"]: r["n"] for r in found}


def pivots(places: list[int], left: list[float], right: list[float]) -> tuple[int, int]:
    """Two places at least 2 apart of least left[first] + right[second], by dynamic programming over the places."""
    best, first, out = float("inf"), -1, (float("inf"), -1, -1)
    behind = 0
    for j in places:
        while places[behind] + 2 <= j:  # the best first pivot that ends before j
            if left[places[behind]] < best:
                best, first = left[places[behind]], places[behind]
            behind += 1
        if first >= 0 and best + right[j] < out[0]:
            out = (best + right[j], first, j)
    return out[1], out[2]


class GramIndex:
    """Makes the index rows and the pivot rows of words."""

    def __init__(self, counts: dict[str, int], prefix: int = PREFIX):
        total = sum(counts.values()) or 1
        self.rank = {g: k for k, g in enumerate(counts)}
        self.prefix = prefix
        starts: dict[str, int] = {}
        ends: dict[str, int] = {}
        for g, n in counts.items():
            starts[g[0]] = starts.get(g[0], 0) + n
            ends[g[1]] = ends.get(g[1], 0) + n
        self.share = {g: n / total for g, n in counts.items()}
        self.after = {g: n / starts[g[0]] for g, n in counts.items()}  # of a letter's followers, and of its forerunners
        self.before = {g: n / ends[g[1]] for g, n in counts.items()}

    def plan(self, word: str) -> tuple[int, list[int], tuple[int, int]]:
        """How far the word's prefix reaches in the order, its places, and the places of the two pivots."""
        grams = [word[k : k + 2] for k in range(len(word) - 1)]
        ranks = [self.rank[g] for g in grams]
        reach = sorted(ranks)[min(self.prefix, len(ranks)) - 1]
        left, right = [self.share[grams[0]]], [self.share[grams[-1]]]
        for g in grams[1:]:
            left.append(left[-1] * self.after[g])
        for g in grams[-2::-1]:
            right.append(right[-1] * self.before[g])
        places = [k for k, r in enumerate(ranks) if r <= reach]
        return reach, places, pivots(places, left, right[::-1])

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = lambda side, letters, n: xxhash.xxh3_64_intdigest(f"{side}{n}:{letters}") - (1 << 63)
        for b in batches:
            for start in range(0, b.num_rows, 2048):
                part = b.slice(start, 2048)
                at, kind, keys, reaches, letters = [], [], [], [], []
                for i, word in enumerate(texts_of(part["word"])):
                    reach, places, (first, second) = self.plan(word)
                    mask, size = 0, len(word)
                    for c in word:
                        mask ^= 1 << (ord(c) & 63)
                    mine = [key("<", word[: k + 2], size) for k in places] + [key(">", word[k:], size) for k in places]
                    other = [key(side, text, n) for n in (size - 1, size, size + 1) for side, text in (("<", word[: first + 2]), (">", word[second:]))]
                    n = len(mine) + len(other)
                    keys += mine + other
                    kind += [False] * len(mine) + [True] * len(other)
                    at += [i] * n
                    reaches += [reach] * n
                    letters += [mask - (1 << 64) if mask >> 63 else mask] * n
                take = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind), pa.array(keys, pa.int64()), pa.array(reaches, pa.int32()), pa.array(np.array(letters, np.int64)), part["word"].take(take), part["n"].take(take)],
                    ["pivot", "key", "reach", "letters", "word", "n"],
                )


def near_pairs(words: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """(a, b, a_n, b_n): each two of words (word, n; each word once, of 4 letters or more, stored) that are one edit apart, a before b."""
    index = GramIndex(_gram_order(words), prefix)
    path = scratch(words.sparkSession, "spelling")
    grams = stored(words.mapInArrow(releasing(index.rows), GRAM_ROWS), f"{path}/grams")
    side = lambda kind, pivot: grams.where(F.col("pivot") == pivot).select("key", *[F.col(c).alias(f"{kind}_{c}") for c in ("reach", "letters", "word", "n")])
    found = side("p", True).join(side("i", False), "key").where("p_reach <= i_reach and p_word != i_word and bit_count(p_letters ^ i_letters) <= 2 and levenshtein(p_word, i_word, 1) = 1")
    first = F.col("p_word") < F.col("i_word")
    pair = [F.when(first, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(name) for name, x, y, c in (("a", "p", "i", "word"), ("b", "i", "p", "word"), ("a_n", "p", "i", "n"), ("b_n", "i", "p", "n"))]
    return found.select(*pair).distinct()


def _roots(links: DataFrame, path: str) -> DataFrame:
    """(word, root) of links (word, form): the last of the forms that follow each other. Each pass doubles the steps."""
    ways = stored(links.select("word", F.col("form").alias("root")), f"{path}/0")
    for k in range(1, 64):  # a form is TIMES times as frequent, so ways are short: 5 passes at 10^12 occurrences
        on = ways.select(F.col("word").alias("via"), F.col("root").alias("next"))
        ways = stored(ways.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"{path}/{k}")
        if ways.where("moved").isEmpty():
            break
        ways = ways.drop("moved")
    return ways.select("word", "root")


def group_variants(words: DataFrame, times: int = TIMES, prefix: int = PREFIX) -> DataFrame:
    """words (word, n) with form, form_n, root and n_near.

    n_near: words one edit away. form: the most frequent of these (ties: the first in code point order) if it is at least
    `times` times as frequent, else null. root: where the forms lead to, the word itself without a form. An empty table
    gives no row.
    """
    path = scratch(words.sparkSession, "variants")
    words = stored(words, f"{path}/words")
    pairs = near_pairs(words, prefix)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= times * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    formed = stored(formed, f"{path}/formed")
    roots = _roots(formed.where("form is not null"), f"{path}/roots")
    return formed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """group_variants of word_counts of docs (doc_id, text).

    Null and empty texts have no words; a null id counts as empty text in the choice of spoilt runs. Repeated rows are
    counted as often as they stand there; further columns are ignored; texts are read whole, whatever their length.
    """
    return group_variants(word_counts(docs))
