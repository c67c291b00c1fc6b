"""Problem 2: the languages of documents and of their segments.

Method: a linear-chain conditional random field over words. A word's features
are its script, affixes, character n-grams and its place in the lexicon of
known words; transitions between languages are learned; words of texts that
switch languages are labelled by forward-backward. Runs of words with one
label are the segments, with the mean posterior as confidence.

The field is trained on about MAX_TRAIN labelled texts at most of a language in a
script, taken by hash, cut to windows of WINDOW words, without those whose label is contradicted
by a field trained on the other half of them. Every text is labelled whole.

Defined results: null and blank texts, and texts without any letter, have no
segments; digits and punctuation belong to the run around them; an insertion
of fewer than MIN_RUN words does not part the run around it and is not a
language of the text, nor is a run beside the longest that is not SURE (it is
still a segment).
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.runtime import read_table

MIN_RUN = 8
SURE = 0.96  # mean posterior from which a run other than the longest counts; right ones are nearly all above it
MAX_TRAIN = 800
WINDOW = 60
BUCKETS = 1 << 17
STEPS = 50
STEPS_CROSS = 20  # of the fields that only tell wrong labels
FOREIGN = -9.0  # score of a language in a script the registry does not give it
MEMO = 400_000
BATCH = 4_000

# Code points of the letters of the corpus' scripts (dandas and digits are shared).
SCRIPTS = {
    "Devanagari": ((0x900, 0x963), (0x970, 0x97F), (0xA8E0, 0xA8FF)), "Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)), "Tirhuta": ((0x11480, 0x114DF),),
    "Limbu": ((0x1900, 0x194F),), "Ol Chiki": ((0x1C50, 0x1C7F),), "Lepcha": ((0x1C00, 0x1C4F),), "Sunuwar": ((0x11BC0, 0x11BFF),),
}
_EDGES = re.compile(r"^[^\w]+|[^\w]+$")


class _Letters(dict):
    """Script of each character that is a letter or a mark: None where no listed one, False for other characters."""

    def __missing__(self, c: str) -> str | None | bool:
        o = ord(c)
        script = next((n for n, ranges in SCRIPTS.items() if any(a <= o <= b for a, b in ranges)), None)
        self[c] = got = script if c.isalpha() or unicodedata.category(c)[0] == "M" or 0x11BC0 <= o <= 0x11BFF else False
        return got


_LETTERS = _Letters()


def word_features(raw: str) -> np.ndarray:
    """Hashed features; none for a word without letters."""
    letters = [c for c in raw if _LETTERS[c] is not False]
    w = "".join(letters).lower()
    names = [s for s in map(_LETTERS.__getitem__, letters) if s]
    if not w or not names:
        return np.zeros(0, dtype=np.int64)
    script = max(set(names), key=names.count)
    if script == "Latin":  # transliterations are written with and without marks
        w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    f = [f"s{script}", f"w{w}"]
    f += [f"p{w[:n]}" for n in (1, 2, 3, 4) if len(w) >= n] + [f"e{w[-n:]}" for n in (1, 2, 3, 4, 5) if len(w) >= n]
    b = f"^{w}$"
    f += [f"g{b[i : i + 3]}" for i in range(len(b) - 2)]
    return np.array(sorted({zlib.crc32(x.encode()) % BUCKETS for x in f}), dtype=np.int64)


class Field:
    """weights: features x languages. transitions: from x to, and of the first word."""

    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray, first: np.ndarray):
        self.languages, self.weights, self.transitions, self.first = languages, weights, transitions, first

    def posteriors(self, emissions: np.ndarray, lengths: np.ndarray, with_pairs: bool = False):
        """Forward-backward over padded sequences, longest first. emissions: n x t x k log scores."""
        n, t, k = emissions.shape
        e = np.exp(emissions - emissions.max(axis=2, keepdims=True)).astype(np.float32)
        a = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        alive = np.array([(lengths > i).sum() for i in range(t)])
        fwd = np.zeros((t, n, k), dtype=np.float32)
        x = e[:, 0] * np.exp(self.first - self.first.max()).astype(np.float32)
        fwd[0] = x / x.sum(1, keepdims=True)
        for i in range(1, t):
            m = alive[i]
            x = (fwd[i - 1, :m] @ a) * e[:m, i]
            x /= x.sum(1, keepdims=True) + 1e-30
            fwd[i, :m] = x
        pairs = np.zeros((k, k))
        back = np.ones((n, k), dtype=np.float32)
        for i in range(t - 1, 0, -1):
            m = alive[i]
            y = back[:m] * e[:m, i]
            if with_pairs:
                z = ((fwd[i - 1, :m] @ a) * y).sum(1, keepdims=True) + 1e-30
                pairs += a * ((fwd[i - 1, :m] / z).T @ y)
            p = fwd[i, :m] * back[:m]
            fwd[i, :m] = p / (p.sum(1, keepdims=True) + 1e-30)
            nb = y @ a.T
            back[:m] = nb / (nb.max(1, keepdims=True) + 1e-30)
        p = fwd[0] * back
        fwd[0] = p / (p.sum(1, keepdims=True) + 1e-30)
        return (fwd, pairs) if with_pairs else fwd


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys, and where each key's run begins in it; every key from 0 on occurs."""
    return np.argsort(keys, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(keys))[:-1]])


def train(texts: list[list[str]], labels: list[int], languages: list[str], scripts: dict[str, set[str]] | None = None, steps: int = STEPS, seed: int = 2) -> Field:
    """texts: words. A third of the sequences join two texts, so that switches are learned."""
    rng = np.random.RandomState(seed)
    k = len(languages)
    seqs: list[tuple[list[str], list[int]]] = []
    order = rng.permutation(len(texts))
    for j, i in enumerate(order):
        w, y = texts[i], [labels[i]] * len(texts[i])
        if j % 3 == 0 and j:
            o = order[j - 1]
            w, y = w + texts[o], y + [labels[o]] * len(texts[o])
        seqs.append((w, y))
    known = {w: word_features(w) for w in {w: None for s, _ in seqs for w in s}}
    # words without letters are no links of the chain
    seqs = [([w for w in s if len(known[w])], [x for w, x in zip(s, y, strict=True) if len(known[w])]) for s, y in seqs]
    seqs = sorted((s for s in seqs if s[0]), key=lambda s: -len(s[0]))
    if not seqs:
        return Field(languages, np.zeros((BUCKETS, k), dtype=np.float32), np.eye(k) * 2, np.zeros(k))
    vocabulary = {w: i for i, w in enumerate(w for w, f in known.items() if len(f))}
    feats = [known[w] for w in vocabulary]
    sizes = np.array([len(f) for f in feats])
    rows, flat = np.repeat(np.arange(len(feats)), sizes), np.concatenate(feats) if feats else np.zeros(0, dtype=np.int64)
    used, cols = np.unique(flat, return_inverse=True)
    lengths = np.array([len(s) for s, _ in seqs])
    t = int(lengths.max())
    words, gold = np.zeros((len(seqs), t), dtype=np.int64), np.zeros((len(seqs), t), dtype=np.int64)
    mask = np.arange(t)[None, :] < lengths[:, None]
    for i, (s, y) in enumerate(seqs):
        words[i, : len(s)], gold[i, : len(s)] = [vocabulary[w] for w in s], y
    total = mask.sum()
    # sums over the features of a word, the words of a feature and the places of a word, each as runs of one sorted list
    by_word = np.cumsum(sizes) - sizes
    by_col, of_col = _runs(cols)
    places = words.T[mask.T]  # of the words in the order of the posteriors: place in the text, then text
    by_place, of_word = _runs(places)
    gold_at = np.flatnonzero(mask.T.ravel())
    gold_y = gold.T[mask.T]
    params = [np.zeros((len(used), k), dtype=np.float32), np.eye(k) * 2.0, np.zeros(k)]
    given = np.zeros_like(params[0])  # what the registry tells is not learned
    for script in SCRIPTS:
        bucket = zlib.crc32(f"s{script}".encode()) % BUCKETS
        at = np.searchsorted(used, bucket)
        if scripts and at < len(used) and used[at] == bucket:
            given[at] = [0.0 if script in scripts[x] else FOREIGN for x in languages]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    empirical = np.zeros((k, k))
    np.add.at(empirical, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    first_gold = np.bincount(gold[:, 0], minlength=k)
    field = Field(languages, params[0], params[1], params[2])
    for step in range(1, steps + 1):
        table = np.add.reduceat((params[0] + given).take(cols, axis=0), by_word, axis=0)
        field.transitions, field.first = params[1], params[2]
        post, pairs = field.posteriors(table.take(words, axis=0), lengths, True)
        first_g = (post[0].sum(0) - first_gold) / len(seqs)
        diff = post.reshape(-1, k).take(gold_at, axis=0)
        diff[np.arange(len(diff)), gold_y] -= 1
        word_g = np.add.reduceat(diff.take(by_place, axis=0), of_word, axis=0)
        g0 = np.add.reduceat(word_g.take(rows[by_col], axis=0), of_col, axis=0) * (1000 / total) + 0.002 * params[0]
        grads = [g0, (pairs - empirical) / total * 100 + 0.01 * (params[1] - np.eye(k)), first_g]
        for p, g, m in zip(params, grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.98 * m[1] + 0.02 * g * g
            p -= 0.15 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.98**step)) + 1e-3)
    weights = np.zeros((BUCKETS, k), dtype=np.float32)
    weights[used] = params[0] + given
    return Field(languages, weights, params[1], params[2])


class Labeller:
    """Segments of texts; the emissions of a bounded number of words are remembered."""

    def __init__(self, field: Field):
        self.field, self.k = field, len(field.languages)
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1 << 14, self.k), dtype=np.float32)
        self.known = np.zeros(1 << 14, dtype=bool)  # has letters
        self.counts = np.zeros(1 << 14, dtype=bool)  # has letters or digits

    def _add(self, word: str) -> int:
        i = len(self.rows)
        if i == len(self.table):
            self.table, self.known, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.table, self.known, self.counts))
        f = word_features(word)
        if len(f):
            self.table[i], self.known[i] = self.field.weights[f].sum(0), True
        self.counts[i] = self.known[i] or any(c.isalnum() for c in word)
        self.rows[word] = i
        return i

    def label(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float, int]]]:
        """For each text its segments (language, first word, last word, confidence, words that are no mere signs)."""
        out: list[list[tuple[int, int, int, float, int]]] = [[] for _ in texts]
        ids, late = [], []
        for i, t in enumerate(texts):
            if t and (w := t.split()):
                if len(self.rows) > MEMO:
                    late.append(i)
                    continue
                get = self.rows.get
                a = np.array([r if (r := get(x)) is not None else self._add(x) for x in w], dtype=np.int64)
                at = np.flatnonzero(self.known[a])  # words without letters are no links of the chain
                if len(at):
                    ids.append((i, a[at], at, np.concatenate([[0], np.cumsum(self.counts[a])])))
        ids.sort(key=lambda x: -len(x[1]))
        at = 0
        while at < len(ids):
            # as many texts as keep the padded block small
            n = max(1, min(BATCH, 400_000 // len(ids[at][1])))
            self._block(ids[at : at + n], out)
            at += n
        if late:
            self.reset()
            for i, segs in zip(late, self.label([texts[i] for i in late]), strict=True):
                out[i] = segs
        return out

    def _block(self, block: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], out: list) -> None:
        lengths = np.array([len(a) for _, a, *_ in block])
        words = np.zeros((len(block), lengths[0]), dtype=np.int64)
        for j, (_, a, *_) in enumerate(block):
            words[j, : len(a)] = a
        post = self.field.posteriors(self.table[words], lengths)
        best, sure = post.argmax(2).T, post.max(2).T
        for j, (i, a, at, upto) in enumerate(block):
            out[i] = runs(best[j, : len(a)], sure[j, : len(a)], at, upto)


def runs(best: np.ndarray, sure: np.ndarray, at: np.ndarray, upto: np.ndarray) -> list[tuple[int, int, int, float, int]]:
    """Segments of a labelled text. best, sure: of the words that have letters, at the places ``at``; the others belong to
    the run around them. upto: how many words that are no mere signs stand before each place."""
    last = len(upto) - 2
    cuts = np.flatnonzero(np.diff(best)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(best)]])
    segs = [[int(best[s]), int(at[s]) if s else 0, int(at[e]) - 1 if e < len(at) else last, float(sure[s:e].mean())] for s, e in zip(starts, ends, strict=True)]
    size = lambda s: int(upto[s[2] + 1] - upto[s[1]])
    if len(segs) > 1:
        # an insertion too short to count does not part the run around it
        merged: list[list] = []
        for i, s in enumerate(segs):
            if size(s) < MIN_RUN and merged and i + 1 < len(segs) and merged[-1][0] == segs[i + 1][0]:
                merged[-1][2] = s[2]
            elif merged and merged[-1][0] == s[0]:
                a, b = size(merged[-1]), size(s)
                merged[-1][3] = (merged[-1][3] * a + s[3] * b) / (a + b)
                merged[-1][2] = s[2]
            else:
                merged.append(s)
        segs = merged
    return [(*s, size(s)) for s in segs]


def written(segs: list[tuple[int, int, int, float, int]]) -> set[int]:
    """Languages in which a text is written: that of its longest run, and those of other long runs of which
    the model is sure; without long runs, the one of nearly all of it."""
    most = max((s[4] for s in segs), default=0)
    long = {s[0] for s in segs if s[4] >= MIN_RUN and (s[4] == most or s[3] >= SURE)}
    if long or not segs:
        return long
    share: dict[int, int] = {}
    for s in segs:
        share[s[0]] = share.get(s[0], 0) + s[4]
    return {max(share, key=share.get)}


_SEGMENT = "array<struct<lang:string,first_word:int,last_word:int,confidence:double,counts:boolean>>"


def label_languages(df: DataFrame, text: str, field: Field) -> DataFrame:
    """``df`` without ``text``, with segments: lang, first_word, last_word (from 0), confidence,
    and counts (the text is written in that language)."""
    kept = [c for c in df.columns if c != text]
    shared = df.sparkSession.sparkContext.broadcast((field.languages, field.weights, field.transitions, field.first))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(Field(*shared.value))
        names = own.field.languages
        kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("confidence", pa.float64()), ("counts", pa.bool_())]))
        for whole in batches:
            for begin in range(0, len(whole), BATCH):
                b = whole.slice(begin, BATCH)
                found = []
                for segs in own.label(b.column(len(kept)).to_pylist()):
                    main = written(segs)
                    found.append([{"lang": names[s[0]], "first_word": s[1], "last_word": s[2], "confidence": s[3], "counts": s[0] in main} for s in segs])
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(kept))], pa.array(found, kind)], names=[*kept, "segments"])

    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("segments", T._parse_datatype_string(_SEGMENT))])
    return df.select(*kept, text).mapInArrow(run, schema)


def training_rows(rows: DataFrame, label: str, text: str, languages: list[str], scripts: dict[str, set[str]], bound: int = MAX_TRAIN) -> tuple[list[list[str]], list[int]]:
    """At most about ``bound`` texts of each language in each of its scripts, chosen by
    the hash of the text, cut to windows."""
    script = F.coalesce(*[
        F.when(F.col("t").rlike("[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SCRIPTS[n]) + "]"), n) for n in sorted(SCRIPTS, key=lambda n: n == "Latin")])
    named = rows.where(F.col(label).isNotNull() & (F.length(F.trim(text)) > 20)).select(F.col(label).alias("l"), F.col(text).alias("t")).withColumn("s", script)
    sizes = {(r["l"], r["s"]): r["count"] for r in named.groupBy("l", "s").count().collect() if r["s"] in scripts[r["l"]]}
    u = F.pmod(F.xxhash64(F.lit(2), "t"), F.lit(1 << 30)) / float(1 << 30)
    take = [F.when((F.col("l") == x) & (F.col("s") == y) & (u < bound / n), True) for (x, y), n in sizes.items()]
    got = named.where(F.coalesce(*take, F.lit(False))).orderBy("l", "t").toPandas()
    texts, labels = [], []
    for name, t in zip(got["l"], got["t"], strict=True):
        w = t.split()
        at = (zlib.crc32(t.encode()) % (len(w) - WINDOW)) if len(w) > WINDOW else 0
        texts.append(w[at : at + WINDOW])
        labels.append(languages.index(name))
    return texts, labels


def fit(texts: list[list[str]], labels: list[int], languages: list[str], scripts: dict[str, set[str]] | None = None) -> Field:
    """Labels that the field of the other half of the texts contradicts are left out."""
    halves = [[i for i in range(len(texts)) if i % 2 == h] for h in (0, 1)]
    if not texts:
        return Field(languages, np.zeros((BUCKETS, len(languages)), dtype=np.float32), np.eye(len(languages)) * 2, np.zeros(len(languages)))
    if not all(halves):
        return train(texts, labels, languages, scripts)
    sound: list[int] = []
    for own, other in (halves, halves[::-1]):
        by = Labeller(train([texts[i] for i in other], [labels[i] for i in other], languages, scripts, STEPS_CROSS))
        for i, segs in zip(own, by.label([" ".join(texts[i]) for i in own]), strict=True):
            if segs and written(segs) == {labels[i]}:
                sound.append(i)
    sound = sorted(sound) or list(range(len(texts)))
    return train([texts[i] for i in sound], [labels[i] for i in sound], languages, scripts)


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], dict[str, set[str]]]:
    """tbl, record_id, named (language the label names, or null), text of both tables; languages and their scripts."""
    registry = read_table(spark, sf_dir, "language_registry")
    listed = registry.select("id", "aliases", "scripts.script").orderBy("id").collect()  # fixed, a few rows
    names = [(r["id"], [r["id"], *(r["aliases"] or [])]) for r in listed]
    alias = {a: i for i, al in names for a in al}
    table = F.create_map(*[F.lit(x) for pair in alias.items() for x in pair])
    parts = [
        read_table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), F.col(i).alias("record_id"), F.try_element_at(table, F.trim(F.coalesce(c, F.lit("")))).alias("named"), "text")
        for t, i, c in (("documents", "doc_id", "lang"), ("synthesis_text", "row_id", "language"))
    ]
    return parts[0].unionByName(parts[1]), [i for i, _ in names], {r["id"]: set(r["script"] or []) for r in listed}


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, languages, scripts = _rows(spark, sf_dir)
    field = fit(*training_rows(rows, "named", "text", languages, scripts), languages, scripts)
    return label_languages(rows, "text", field)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages in which a text is written and which its label does not name."""
    got = _labelled(spark, sf_dir)
    langs = F.array_distinct(F.transform(F.filter("segments", lambda s: s["counts"]), lambda s: s["lang"]))
    return got.select("tbl", "record_id", "named", F.explode(langs).alias("lang")).where("named is null or named <> lang").drop("named").select("tbl", "record_id", "lang")


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment with its language and confidence."""
    return _labelled(spark, sf_dir).select("tbl", "record_id", F.explode("segments").alias("s")).select(
        "tbl", "record_id", F.col("s.first_word").alias("first_word"), F.col("s.last_word").alias("last_word"), F.col("s.lang").alias("lang"), F.col("s.confidence").alias("confidence"))


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every record (null without words) with its confidence."""
    best = F.array_max(F.transform("segments", lambda s: F.struct((s["last_word"] - s["first_word"] + 1).alias("n"), s["confidence"].alias("confidence"), s["lang"].alias("lang"))))
    return _labelled(spark, sf_dir).select("tbl", "record_id", "named", best.alias("b")).select("tbl", "record_id", F.col("b.lang").alias("lang"), F.col("b.confidence").alias("confidence"), "named")
