"""Problem 3: one form for text that looks the same.

Method: width variants and blanks are brought to their plain form, canonical
composition is applied, ignorable characters are deleted; then each word of
Latin, Cyrillic or Greek letters becomes a lattice of look-alikes, of which
Viterbi search takes the best path under character bigram scores of words in
one script (counted over all given texts), leaving a script being penalised.
The lattice depends on what is seen only, so words that look the same get the
same reading, whichever letters they were spelled with.

Defined results: null stays null; blanks of any width become spaces; a joiner
that alters the drawn shape (after a virama) is kept, elsewhere it is deleted; a vowel spelled as another vowel and a sign becomes that vowel;
letter case, visible marks and the number of blanks make a difference.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.runtime import materialize, read_table

# Letters drawn alike, Latin first.
LOOK_ALIKES = (
    "aаα", "cсϲ", "dԁ", "eе", "gɡ", "hһ", "iі", "jјϳ", "lӏ", "oоο", "pрρ", "qԛ", "sѕ", "vνѵ", "wԝ", "xх", "yуү",
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "FϜ", "GԌ", "HНΗ", "IІΙӀ", "JЈͿ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "QԚ", "SЅ", "TТΤ",
    "VѴ", "WԜ", "XХΧ", "YҮΥ", "ZΖ",
)
# Ignorable characters (soft hyphen, zero-width space, marks, joiners of words and bidirectional controls, byte order mark, variation selectors).
IGNORABLE = "­͏؜᠎​‎‏‪-‮⁠-⁤⁦-⁯︀-️﻿"
# Hyphens drawn alike, and ligatures drawn as their letters.
SAME_DRAWN = {"‐": "-", "‑": "-", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

# Vowels that may be spelled as another vowel and a sign, drawn alike.
SPELLED_ALIKE = {
    "अा": "आ", "अो": "ओ", "अौ": "औ", "आे": "ओ", "आै": "औ", "एे": "ऐ", "ाे": "ो", "ाै": "ौ", "𑒁𑒰": "𑒂",
}

WORD = re.compile("[A-Za-zÀ-ɏɐ-ʯ̀-ͯͰ-ԯḀ-῿]+")
_LETTER = re.compile("[A-Za-zͰ-ԯ]")
_IGNORED = re.compile(f"[{IGNORABLE}]")
_JOINER = re.compile("[‌‍]")
_ALIKE = re.compile("|".join(SPELLED_ALIKE))
LEAVE = -12.0  # log score of a step between scripts

_OPTIONS = {c: letters for letters in LOOK_ALIKES for c in letters}


def _script(c: str) -> str:
    o = ord(c)
    if 0x300 <= o <= 0x36F:
        return ""
    return "G" if 0x370 <= o <= 0x3FF else "C" if 0x400 <= o <= 0x52F else "L"


def _plain(c: str) -> str:
    """A wide, narrow or non-breaking character in its plain form, any blank as a space."""
    if c in SAME_DRAWN:
        return SAME_DRAWN[c]
    if unicodedata.category(c) == "Zs" or c == "\t":
        return " "
    kind, _, code = unicodedata.decomposition(c).partition("> ")
    return "".join(chr(int(x, 16)) for x in code.split()) if kind in ("<wide", "<narrow") else c


def _keeps(text: str, at: int) -> bool:
    """Does the joiner at ``at`` alter the drawn shape? After a virama one that joins
    always does, one that parts only before a letter."""
    if at == 0 or unicodedata.combining(text[at - 1]) != 9:
        return False
    return text[at] == "\u200d" or at + 1 < len(text) and text[at + 1].isalpha()


class _Plain(dict):
    def __missing__(self, o: int) -> str:
        self[o] = got = _plain(chr(o))
        return got


class Canonical:
    """Texts in the one form. scores: (a, b) -> log probability of b after a, '' at the edges."""

    MEMO = 200_000

    def __init__(self, bigrams: dict[tuple[str, str], int]):
        total: Counter = Counter()
        for (a, _), n in bigrams.items():
            total[a] += n
        self.scores = {k: math.log((n + 0.5) / (total[k[0]] + 300)) for k, n in bigrams.items()}
        self.unseen = {a: math.log(0.5 / (n + 300)) for a, n in total.items()}
        self.plain = _Plain()
        self.memo: dict[str, str] = {}

    def _step(self, a: str, b: str) -> float:
        if a and b and (x := _script(a)) and (y := _script(b)) and x != y:
            return LEAVE
        return self.scores.get((a, b), self.unseen.get(a, math.log(0.5 / 300)))

    def word(self, word: str) -> str:
        seen = "".join(_OPTIONS.get(c, c)[0] for c in unicodedata.normalize("NFD", word))
        got = self.memo.get(seen)
        if got is None:
            paths = {"": (0.0, "")}
            for c in seen:
                after: dict[str, tuple[float, str]] = {}
                for o in _OPTIONS.get(c, c):  # Latin first, and it stays on ties
                    for last, (score, path) in paths.items():
                        s = score + self._step(last, o)
                        if o not in after or s > after[o][0]:
                            after[o] = (s, path + o)
                paths = after
            got = max(((s + self._step(last, ""), p) for last, (s, p) in paths.items()), key=lambda x: x[0])[1]
            got = unicodedata.normalize("NFC", got)
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            self.memo[seen] = got
        return got

    def text(self, text: str) -> str:
        if text.isascii() and "\t" not in text:
            out = text
        else:
            out = _IGNORED.sub("", text).translate(self.plain)
            if _JOINER.search(out):
                out = "".join(c for i, c in enumerate(out) if c not in "‌‍" or _keeps(out, i))
            out = unicodedata.normalize("NFC", out)
            out = _ALIKE.sub(lambda m: SPELLED_ALIKE[m[0]], out)
        return WORD.sub(lambda m: self.word(m[0]), out) if _LETTER.search(out) else out


def _count_batches(batches):
    seen: Counter = Counter()
    plain = _Plain()
    words: Counter = Counter()
    for b in batches:
        for t in b.column(0):
            t = t.as_py()
            if t and _LETTER.search(t):
                words.update(WORD.findall(t))
        if len(words) > 500_000:
            _add(seen, words, plain)
    _add(seen, words, plain)
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in seen], pa.string()), pa.array([b for _, b in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["a", "b", "n"])


def _add(seen: Counter, words: Counter, plain: _Plain) -> None:
    for w, n in words.items():
        w = unicodedata.normalize("NFD", w.translate(plain))
        if len({_script(c) for c in w} - {""}) == 1:
            last = ""
            for c in [*w, ""]:
                seen[last, c] += n
                last = c
    words.clear()


def bigram_model(texts: DataFrame) -> dict[tuple[str, str], int]:
    """Counts of letter pairs in words of one script, over all rows of the one text column.

    Its size is bounded by the square of the three alphabets, whatever the corpus.
    """
    got = texts.mapInArrow(_count_batches, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return {(r["a"], r["b"]): r["n"] for r in got.collect()}


def canonical(df: DataFrame, text: str, out: str, model: dict[tuple[str, str], int]) -> DataFrame:
    """``df`` with the column ``out``: its texts in the one form."""

    def series(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        canon = Canonical(model)
        for s in it:
            yield s.map(lambda t: canon.text(t) if t else t)

    return df.withColumn(out, F.pandas_udf(series, T.StringType())(F.col(text)))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, id, text of the three tables' fields."""
    parts = [
        read_table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), F.col(i).alias("id"), F.col(c).alias("text"))
        for t, i, c in (("manifest", "row_id", "text"), ("limbu_conversion", "conversion_id", "unicode_text"), ("page_eval", "eval_id", "reference_text"))
    ]
    return reduce(DataFrame.unionByName, parts)


def _digests(model):
    def run(batches):
        canon = Canonical(model)
        for b in batches:
            raw = [t.as_py() for t in b.column(2)]
            forms = [canon.text(t) for t in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([hashlib.blake2b(f.encode("utf-8", "surrogatepass"), digest_size=16).digest() if f.strip() else None for f in forms], pa.binary()),
                 pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in raw], pa.binary())],
                names=["tbl", "id", "form", "raw"])

    return run


def same_looking_pairs(fields: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b) of rows of one tbl whose texts differ but have one form; the smaller id first.

    fields: tbl, id, text. Only spellings are paired with each other; rows join
    to the pairs of spellings, so rows that are plain copies never meet.
    """
    texts = fields.where("text is not null and text <> ''")
    model = bigram_model(texts.select("text"))
    rows = texts.mapInArrow(_digests(model), T.StructType([fields.schema["tbl"], fields.schema["id"], T.StructField("form", T.BinaryType()), T.StructField("raw", T.BinaryType())]))
    rows = materialize(rows.where("form is not null"), "p3-forms")
    several = rows.groupBy("tbl", "form").agg(F.min("raw").alias("x"), F.max("raw").alias("y")).where("x <> y").select("tbl", "form")
    held = materialize(rows.join(several, ["tbl", "form"], "left_semi"), "p3-held")
    spelled = held.select("tbl", "form", "raw").distinct()
    pairs = spelled.withColumnRenamed("raw", "raw_a").join(spelled.withColumnRenamed("raw", "raw_b"), ["tbl", "form"]).where("raw_a < raw_b")
    a = held.select("tbl", F.col("raw").alias("raw_a"), F.col("id").alias("a"))
    b = held.select("tbl", F.col("raw").alias("raw_b"), F.col("id").alias("b"))
    return pairs.drop("form").join(a, ["tbl", "raw_a"]).join(b, ["tbl", "raw_b"]).select("tbl", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_looking_pairs(_fields(spark, sf_dir))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its one form."""
    fields = _fields(spark, sf_dir)
    return canonical(fields, "text", "form", bigram_model(fields.select("text"))).select("tbl", "id", "form")
