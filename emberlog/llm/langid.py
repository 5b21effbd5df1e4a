"""Hierarchical language identification: the family first, then one-versus-one linear SVMs inside it.

Features of a text: square roots of the relative frequencies of its hashed byte bigrams and trigrams (lower case, all
but letters and bytes above ASCII as one blank), so each text has length 1. A pair's SVM (squared hinge loss) is fitted
by dual coordinate descent. Families are told apart by the same kind of pairwise SVMs, then the languages of the
winning family. A winner has the most pairs won, then the largest sum of margins.

The models are fitted on the driver on at most PER_LANGUAGE texts of each language and MOST_TEXTS in all, those with
the smallest hash of the id. They take 2 * WIDTH numbers a pair. Languages of no known family begin as families of
their own; the most similar families, by the mean features of their texts, are merged until MOST_FAMILIES are left,
so that pairs don't grow with the square of the languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.shared import document_columns, learning_fold, releasing, texts_of

PER_LANGUAGE = 300
MOST_TEXTS = 6_000
#: Hashes of ids are counted in 2 ** BUCKET_BITS buckets a language.
BUCKET_BITS = 8
WIDTH = 1 << 11
UNDETERMINED = "und"
MOST_FAMILIES = 24
#: Families of languages that are easily taken for one another; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "da", "sv", "no", "nb", "nn", "is", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ca", "gl", "ro", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_CLASS = np.full(256, 32, np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str | None) -> np.ndarray:
    """The 2 * WIDTH features of a whole text."""
    b = _CLASS[np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    counts = [np.bincount((x * np.uint32(2654435761)) >> np.uint32(21), minlength=WIDTH) for x in (two, three)]
    return np.sqrt(np.concatenate([c / max(1, c.sum()) / 2 for c in counts])).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last for a constant 1) of a squared hinge SVM on rows x and signs y, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, alpha, rng = np.zeros(x.shape[1]), np.zeros(len(x)), np.random.default_rng(0)
    curvature = np.einsum("ij,ij->i", x, x) + 0.5 / cost
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = max(0.0, alpha[i] - (y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / cost) / curvature[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class OneVersusOne:
    """Pairwise SVMs over the classes of some rows."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.classes = sorted(set(labels))
        own = np.array(labels)
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.weights = np.zeros((x.shape[1] + 1, len(self.pairs)), np.float32)
        for k, (i, j) in enumerate(self.pairs):
            rows = (own == self.classes[i]) | (own == self.classes[j])
            self.weights[:, k] = linear_svm(x[rows], np.where(own[rows] == self.classes[i], 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winning class of each row, and the least of its pairs' probabilities (a logistic curve over the margin)."""
        n, k = len(x), len(self.classes)
        margins = x @ self.weights[:-1] + self.weights[-1]
        won, total, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for p, (i, j) in enumerate(self.pairs):
            for c, m in ((i, margins[:, p]), (j, -margins[:, p])):
                won[:, c] += m > 0
                total[:, c] += m
                least[:, c] = np.minimum(least[:, c], m)
        best = np.lexsort((total, won), axis=1)[:, -1] if k > 1 else np.zeros(n, int)
        return best, 1 / (1 + np.exp(-2 * np.minimum(least[np.arange(n), best], 30.0)))


def family_names(x: np.ndarray, langs: list[str], most: int = MOST_FAMILIES) -> dict[str, str]:
    """The family of each language of rows x: the known one or its own, the most similar ones merged until `most` are left."""
    members: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        members.setdefault(FAMILY_OF.get(lang, f"only {lang}"), []).append(lang)
    own = np.array(langs)
    sums = {f: x[np.isin(own, ls)].sum(axis=0, dtype=np.float64) for f, ls in members.items()}
    while len(members) > most:
        names = sorted(members)
        means = np.array([sums[f] / np.linalg.norm(sums[f]) for f in names])
        near = np.triu(means @ means.T, 1) - np.tril(np.full((len(names), len(names)), 2.0))
        i, j = np.unravel_index(int(near.argmax()), near.shape)
        members[names[i]] += members.pop(names[j])
        sums[names[i]] = sums[names[i]] + sums.pop(names[j])
    return {lang: f for f, ls in members.items() for lang in ls}


class LanguageModel:
    """Families, and the languages of each."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        of = family_names(x, langs)
        family = [of[lang] for lang in langs]
        self.families = OneVersusOne(x, family)
        self.within = {}
        for name in self.families.classes:
            rows = [k for k, f in enumerate(family) if f == name]
            self.within[name] = OneVersusOne(x[rows], [langs[k] for k in rows])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        out, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if has_letter(t)]
        if not known or not self.families.classes:
            return out, score
        x = np.stack([features(texts[k]) for k in known])
        family, sure = self.families.predict(x)
        for f, name in enumerate(self.families.classes):
            rows = np.flatnonzero(family == f)
            if len(rows):
                best, inside = self.within[name].predict(x[rows])
                for r, b, s in zip(rows, best, inside, strict=True):
                    out[known[r]], score[known[r]] = self.within[name].classes[b], float(min(s, sure[r]))
        return out, score


def learn(docs: DataFrame, folds: int = 5) -> LanguageModel:
    """Fits the models on texts with a language whose id's fold isn't 0. No such text gives a model that knows nothing."""
    usable = document_columns(docs, "doc_id", "text", "lang").where((learning_fold(F.col("doc_id"), folds) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = usable.select("lang", "doc_id").distinct().withColumn("hash", F.xxhash64("doc_id")).withColumn("bucket", F.shiftright("hash", 64 - BUCKET_BITS))
    # buckets of the lowest hashes up to the one that reaches PER_LANGUAGE, so that only their rows meet by language
    below = F.coalesce(F.sum("rows").over(Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = hashed.groupBy("lang", "bucket").agg(F.count("*").alias("rows")).withColumn("below", below).where(F.col("below") < PER_LANGUAGE).select("lang", "bucket")
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    chosen = hashed.join(first, ["lang", "bucket"], "left_semi").withColumn("place", F.row_number().over(order)).where(F.col("place") <= PER_LANGUAGE)
    chosen = chosen.orderBy("place", "lang").limit(MOST_TEXTS).select(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang"))
    # broadcast: at most MOST_TEXTS ids
    sample = usable.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("lang") == F.col("chosen_lang")))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array([features(t).tobytes() for t in texts_of(b.column("text"))], pa.binary())], ["doc_id", "lang", "x"])

    found = sample.select("doc_id", "text", "lang").mapInArrow(releasing(extract), "doc_id bigint, lang string, x binary")
    # of several rows of one id and language one is learnt from, so these are MOST_TEXTS rows at most
    rows = found.groupBy("lang", "doc_id").agg(F.min("x").alias("x")).orderBy("lang", "doc_id").collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), 2 * WIDTH)
    return LanguageModel(x, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs (doc_id, text); `und` and 0 for a null text or one without a letter.

    Null ids and repeated rows are kept; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * WIDTH numbers for each pair of languages in a family

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [shared.value.predict(b.column("text").slice(k, 256).to_pylist()) for k in range(0, len(b), 256)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for p in parts for x in p[0]], pa.string()), pa.array([x for p in parts for x in p[1]], pa.float64())], ["doc_id", "lang_pred", "score"])

    return document_columns(docs, "doc_id", "text").mapInArrow(releasing(predict), "doc_id bigint, lang_pred string, score double")


def identified_documents(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs whose language is determined with a score of at least `least`; learns from their own lang.

    Null texts and texts without a letter are undetermined and go; null languages are only not learnt from. Null ids,
    repeated rows and further columns of any name are kept. An empty table, or one with no language to learn, gives no
    row.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bool] = []
            for k in range(0, len(b), 256):
                langs, scores = model.value.predict(b.column("text").slice(k, 256).to_pylist())
                out += [x != UNDETERMINED and s >= least for x, s in zip(langs, scores, strict=True)]
            yield b.filter(pa.array(out, pa.bool_()))

    return docs.mapInArrow(releasing(keep), docs.schema)
