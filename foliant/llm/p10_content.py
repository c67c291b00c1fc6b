"""Problem 10: abusive, hateful or sexually explicit content.

Method: cumulative-link ordinal regression. Ratings are grades (clean, unsure,
offensive); sentences have sparse features (words and word pairs, brought to
one spelling and one script), one weight vector is shared by all thresholds,
and the output is the expected severity. A document's severity is that of its
worst sentence; which sentences of an offensive document bear its rating is
found while fitting (the rating names only the document).

The model is fitted on all sentences of at most MAX_LABELLED rated documents,
taken by hash, with one constraint of sign: only a feature that is far more
frequent in documents rated offensive than in all documents may raise the
severity, any other can only lower it. Every sentence of every document is
scored; one without known features has the severity of score 0.
Defined results: null, empty and blank texts have severity 0; a source of null
is reported as null; without any rating every severity is 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.runtime import read_table

MAX_LABELLED = 20_000  # rated documents the model is fitted on
TRIGGER = 1.5  # log odds from which a feature may raise the severity
SURE = 4.0  # log of how much less than one feature may do so by chance
GRADES = {"clean": 0, "unsure": 1, "offensive": 2}
FOUND_AT = 1.3  # expected severity, from 0 to 2
MIN_SEEN = 2  # sentences a feature occurs in
ROUNDS = 4
STEPS = 150
RIDGE = 0.02

# Romanisation of the Indic blocks, by offset within the block of Devanagari.
_CONSONANTS = "k kh g gh n c ch j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v s s s h".split()
_VOWELS = {0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "r", 0x0F: "e", 0x10: "ai", 0x13: "o", 0x14: "au"}
_SIGNS = {0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "r", 0x47: "e", 0x48: "ai", 0x4B: "o", 0x4C: "au"}
# Tirhuta characters and the Devanagari ones they stand for: runs of equal order.
_TIRHUTA = {
    **{0x11481 + i: o for i, o in enumerate((0x05, 0x06, 0x07, 0x08, 0x09, 0x0A, 0x0B))}, 0x1148B: 0x0F, 0x1148C: 0x10, 0x1148D: 0x13, 0x1148E: 0x14,
    **{0x1148F + i: 0x15 + i for i in range(20)}, **{0x114A3 + i: 0x2A + i for i in range(6)}, 0x114A9: 0x30, 0x114AA: 0x32, **{0x114AB + i: 0x35 + i for i in range(5)},
    0x114B0: 0x3E, 0x114B1: 0x3F, 0x114B2: 0x40, 0x114B3: 0x41, 0x114B4: 0x42, 0x114B5: 0x43, 0x114B9: 0x47, 0x114BA: 0x47, 0x114BB: 0x48, 0x114BC: 0x4B, 0x114BD: 0x4B, 0x114BE: 0x4C,
    0x114BF: 0x01, 0x114C0: 0x02, 0x114C1: 0x03, 0x114C2: 0x4D, 0x114C3: 0x3C,
}
_LEET = str.maketrans("01345@$!", "oieasasi")
# what is put inside a word to hide it, and is no part of it
_HIDING = re.compile(r"(?<=[^\W\d_])[*.\-_·•​‌‍­+~^|']+(?=[^\W_]|[ऀ-ःऺ-ॏ𑒰-𑓃])", re.UNICODE)
_MARKED = re.compile(r"[*.\-_·•+~^|']+(?=[ऀ-ःऺ-ॏ𑒰-𑓃])")
_SENTENCE = re.compile(r"(?<=[.?!।॥|])[\s”\"’]+|\n+")
_WORD = re.compile(r"[^\s,;:?!।॥“”\"‘’()\[\]{}<>—–|#/]+")
_RUN = re.compile(r"(\w)\1{2,}")
_EDGE = ".*-_~'…"


def romanise(word: str) -> str:
    """A word of Devanagari or Tirhuta in plain Latin letters, the last inherent vowel dropped as in speech."""
    out: list[str] = []
    open_ = False
    for c in word:
        o = ord(c)
        d = o - 0x900 if 0x900 <= o < 0x980 else _TIRHUTA.get(o, -1)
        if 0x15 <= d <= 0x39:
            out += (["a"] if open_ else []) + [_CONSONANTS[d - 0x15]]
            open_ = True
        elif d in _SIGNS:
            out.append(_SIGNS[d])
            open_ = False
        elif d == 0x4D:
            open_ = False
        elif d in _VOWELS:
            out += (["a"] if open_ else []) + [_VOWELS[d]]
            open_ = False
        elif d in (0x01, 0x02):
            out += (["a"] if open_ else []) + ["m"]
            open_ = False
        elif d != 0x3C:
            out += (["a"] if open_ else []) + ([c] if d < 0 else [])
            open_ = False
    return "".join(out)


class Words:
    """Words in one spelling; a bounded memo, as words repeat."""

    MEMO = 300_000

    def __init__(self):
        self.memo: dict[str, str] = {}

    def one(self, raw: str) -> str:
        got = self.memo.get(raw)
        if got is None:
            w = unicodedata.normalize("NFKC", raw).lower()
            w = _MARKED.sub("", _HIDING.sub("", w)).strip(_EDGE)
            w = romanise(w) if not w.isascii() else w
            w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
            if any(c.isdigit() or c in "@$!" for c in w):
                w = "0" if not any(c.isalpha() for c in w) else w.translate(_LEET)
            got = _RUN.sub(r"\1", w)
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            self.memo[raw] = got
        return got

    def sentences(self, text: str) -> list[list[str]]:
        one = self.one
        out = []
        for s in _SENTENCE.split(text):
            words = [w for w in map(one, _WORD.findall(s)) if w]
            if words:
                out.append(words)
        return out


def features(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)), *(f"{a} _ {b}" for a, b in zip(words, words[2:], strict=False))}


class Lexicon:
    """Finds which of the given features a sentence holds, without building the others."""

    def __init__(self, names: list[str]):
        self.single: dict[str, int] = {}
        self.pair: dict[tuple[str, str], int] = {}
        self.apart: dict[tuple[str, str], int] = {}
        for i, f in enumerate(names):
            w = f.split(" ")
            if len(w) == 1:
                self.single[f] = i
            elif len(w) == 2:
                self.pair[w[0], w[1]] = i
            else:
                self.apart[w[0], w[2]] = i
        self.known = {*self.single, *(w for p in (*self.pair, *self.apart) for w in p)}

    def held(self, words: list[str]) -> set[int]:
        if self.known.isdisjoint(words):
            return set()
        known, single, pair, apart = self.known, self.single, self.pair, self.apart
        out = set()
        a = b = None  # the two words before, where known
        for w in words:
            if w not in known:
                a, b = b, None
                continue
            if w in single:
                out.add(single[w])
            if b is not None and (b, w) in pair:
                out.add(pair[b, w])
            if a is not None and (a, w) in apart:
                out.add(apart[a, w])
            a, b = b, w
        return out


class Model:
    """raising: the features whose weights may be positive."""

    def __init__(self, weights: dict[str, float], thresholds: tuple[float, ...], raising: set[str] | None = None):
        self.weights, self.raising = weights, raising or set()
        self.thresholds = np.array(thresholds)
        self.lexicon = Lexicon(list(weights))
        self.values = list(weights.values())

    def severity(self, z: float) -> float:
        """Expected grade: the sum over the ordered thresholds of P(grade above it)."""
        return float((1 / (1 + np.exp(np.clip(self.thresholds - z, -40, 40)))).sum())

    def worst(self, sentences: list[list[str]]) -> float | None:
        """Largest linear score of the sentences, None without one or without a fitted weight."""
        values, held = self.values, self.lexicon.held
        return None if not values else max((sum([values[i] for i in held(s)]) for s in sentences), default=None)


def _fit_ordinal(rows: list[tuple[int, ...]], grades: np.ndarray, weights: np.ndarray, raising: np.ndarray, steps: int, start=None):
    """Proximal Adam on the cumulative-link likelihood with a ridge; rows hold feature
    indices. Weights of features that are not raising stay at most 0."""
    n = len(raising)
    lens = np.array([len(r) for r in rows])
    at = np.repeat(np.arange(len(rows)), lens)
    idx = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(lens.sum()))
    w, th = (np.zeros(n), np.array([2.0, 2.5])) if start is None else (start[0].copy(), start[1].copy())
    m, v, mt, vt = np.zeros(n), np.zeros(n), np.zeros(2), np.zeros(2)
    total = weights.sum()
    above = (grades[:, None] > np.arange(2)).astype(float)
    for t in range(1, steps + 1):
        z = np.bincount(at, w[idx], minlength=len(rows))
        p = 1 / (1 + np.exp(np.clip(th - z[:, None], -40, 40)))
        err = (p - above) * weights[:, None]  # of both binary cuts, which share w
        g = np.bincount(idx, err.sum(1)[at], minlength=n) / total * 100 + RIDGE * w
        gt = -err.sum(0) / total * 100
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mt, vt = 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt * gt
        rate = 0.1
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-3)
        w[~raising] = np.minimum(w[~raising], 0.0)
        th -= rate * (mt / (1 - 0.9**t)) / (np.sqrt(vt / (1 - 0.99**t)) + 1e-3)
        th.sort()
    return w, th


def candidates(texts: list[str], ratings: list[list[int]]) -> dict[str, int]:
    """Features of at least MIN_SEEN texts rated offensive on average, with how many they are in."""
    words, seen = Words(), Counter()
    for t, g in zip(texts, ratings, strict=True):
        if g and np.mean(g) > 1.0:
            seen.update(set().union(*map(features, words.sentences(t or ""))))
    return {f: n for f, n in seen.items() if n >= MIN_SEEN}


def document_counts(documents: DataFrame, text: str, wanted: set[str]) -> tuple[int, dict[str, int]]:
    """Number of all documents, and in how many of them each wanted feature is.

    What comes to the driver is bounded by ``wanted``, which the labelled sample bounds.
    """
    names = sorted(wanted)
    shared = documents.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, lexicon = Words(), 0, Lexicon(shared.value)
        seen = [0] * len(shared.value)
        for b in batches:
            for t in b.column(0):
                n += 1
                t = t.as_py()
                if t:
                    for i in set().union(*map(lexicon.held, words.sentences(t))):
                        seen[i] += 1
        there = [i for i, c in enumerate(seen) if c]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *there], pa.int32()), pa.array([n, *[seen[i] for i in there]], pa.int64())], names=["f", "n"])

    got = {r["f"]: r["n"] for r in documents.select(text).mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()}
    return got.pop(-1, 0), {names[i]: n for i, n in got.items()}


def fit(texts: list[str], ratings: list[list[int]], n_docs: int, counts: dict[str, int]) -> Model:
    """ratings: the grades given to each text (they may contradict each other).

    n_docs, counts: documents in all, and those that hold each candidate feature.
    """
    held = candidates(texts, ratings)
    nb = sum(bool(g) and np.mean(g) > 1.0 for g in ratings)
    if not held:
        return Model({}, (2.0, 2.5))
    odds, raising = {}, set()
    for f, n in held.items():
        rest = max(0, counts.get(f, n) - n)
        odds[f] = float(np.log((n + 0.1) / (nb + 1)) - np.log((rest + 0.5) / (max(1, n_docs - nb) + 1)))
        # how likely so many of its documents are rated offensive by chance, against as many features as documents
        chance = lgamma(n + rest + 1) - lgamma(n + 1) - lgamma(rest + 1) + n * np.log(nb / max(n_docs, nb + 1))
        if odds[f] > TRIGGER and chance < -(np.log(n_docs + 1) + SURE):
            raising.add(f)
    words = Words()
    split = [words.sentences(t or "") if g else [] for t, g in zip(texts, ratings, strict=True)]
    mean = [float(np.mean(g)) if g else 0.0 for g in ratings]
    marks = Lexicon(sorted(raising))
    marked = [(i, features(s)) for i, d in enumerate(split) for s in d if marks.held(s)]
    # a feature lowers only what another raises, so those of sentences with a raising one are all that matter
    seen = Counter(f for _, s in marked for f in s)
    index = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= MIN_SEEN))}
    if not index:
        return Model({}, (2.0, 2.5))
    may_raise = np.array([f in raising for f in index])
    doc = np.array([i for i, _ in marked])
    ids = [tuple(sorted(index[f] for f in s if f in index)) for _, s in marked]
    score = np.array([sum(sorted((odds.get(x, -1.0) for x in s), reverse=True)[:6]) for _, s in marked])
    lexicon, plain = Lexicon(list(index)), Counter()
    for d, mu in zip(split, mean, strict=True):
        if mu <= 0.5:
            plain.update(r for r in (tuple(sorted(lexicon.held(s))) for s in d) if not any(may_raise[i] for i in r))
    start, lead, least = None, 5.0, 6.0
    for turn in range(ROUNDS):
        top = np.full(len(mean), -np.inf)
        np.maximum.at(top, doc, score)
        x, y, wt = [], [], []
        for r, i, sc in zip(ids, doc, score, strict=True):
            mu = mean[i]
            if mu <= 1.0:
                x.append(r), y.append(1 if mu > 0.5 else 0), wt.append(1.0)
            elif top[i] >= least and sc >= max(top[i] - lead, least):
                x.append(r), y.append(2 if mu > 1.4 else 1), wt.append(2.0)
            elif sc < 0:
                x.append(r), y.append(0), wt.append(0.5)
        if not x:
            return Model({}, (2.0, 2.5))
        # the many sentences that nothing raises weigh as much as all others together
        share = sum(wt) / max(1, plain.total())
        x += list(plain)
        y += [0] * len(plain)
        wt += [n * share for n in plain.values()]
        w, th = _fit_ordinal(x, np.array(y), np.array(wt), may_raise, STEPS if turn == 0 else STEPS // 2, start)
        start, lead, least = (w, th), 6.0, -0.5
        score = np.array([w[list(r)].sum() for r in ids]) - th.mean()
    return Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 0.01}, tuple(float(t) for t in th), raising)


def rated(documents: DataFrame, reviews: DataFrame, bound: int = MAX_LABELLED) -> tuple[list[str], list[list[int]]]:
    """Texts and grades of at most ``bound`` rated documents, by hash."""
    grade = F.when(F.col("rating") == "offensive", 2).when(F.col("rating") == "unsure", 1).when(F.col("rating") == "clean", 0)
    per = reviews.withColumn("g", grade).where("g is not null and doc_id is not null").groupBy("doc_id").agg(F.collect_list("g").alias("grades"))
    chosen = F.broadcast(per.orderBy(F.xxhash64("doc_id")).limit(bound))  # bounded by the limit
    got = documents.where("text is not null").select("doc_id", "text").join(chosen, "doc_id").orderBy("doc_id").select("text", "grades").toPandas()
    return list(got["text"]), [list(g) for g in got["grades"]]


def learn(documents: DataFrame, reviews: DataFrame) -> Model:
    texts, grades = rated(documents, reviews)
    return fit(texts, grades, *document_counts(documents, "text", set(candidates(texts, grades))))


def score(documents: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """``documents`` without the text, with severity (0 to 2)."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, tuple(model.thresholds)))  # bounded by the labelled sample

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, words = Model(*shared.value), Words()
        for s in it:
            out = []
            for t in s:
                z = own.worst(words.sentences(t)) if t else None
                out.append(0.0 if z is None else own.severity(z))
            yield pd.Series(out, dtype=float)

    return documents.withColumn("severity", F.pandas_udf(run, T.DoubleType())(F.col(text))).drop(text)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return score(d, "doc_id", "text", learn(d, read_table(spark, sf_dir, "content_review")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("severity") >= FOUND_AT).select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "severity")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, share found and mean severity per source."""
    return _scored(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("n_docs"), F.avg((F.col("severity") >= FOUND_AT).cast("double")).alias("found_share"), F.avg("severity").alias("mean_severity"))
