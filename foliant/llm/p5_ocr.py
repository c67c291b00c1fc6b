"""Problem 5: noise in text from scanned pages.

Method: anagram hashing. The hash of a word is the sum of its characters'
hashes, so two words that differ by a confusion differ by a constant; rare
words of the pages are joined in SQL with much more frequent words over the
hash that is left when a character, or a pair of neighbours, is taken out.
Confusions are ranked by the number of different rare words they explain, over
the different texts of the corpus, and only well supported ones correct. Running titles and
page numbers are removed at the edges of the page, titles by how many different
pages they recur on (copies of a page are one); words broken at a line end are joined unless the corpus writes them
with a hyphen.

Defined results: null and empty texts have no lines; a text of one line has no
edges, its words can only be misread; of two lines each is an edge, and a
title only with a page number or on other pages too; a page number outside the edge lines is
left alone; repeated rows are repaired each.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.runtime import materialize, read_table

LEAST = 10  # occurrences of a word that others may be corrected to; the same for a corpus of any size
RATIO = 15  # how much more often the right word occurs than the misread one
SUPPORT = 4  # different rare words that a confusion must explain
REVERSED = 2  # and that the reverse of such a confusion must explain
TITLE_WORDS = 5
WIDE, NARROW = 0.85, 0.62  # of the widest line: a longer line is body text, a shorter one at an edge needs no more evidence
TITLES = 2  # different pages on which a title recurs at least
TITLE_SHARE = 9e-4  # and this share of all different pages, as body lines that recur by chance grow with them
SUFFIXES = 4  # different titles that share all but their first word

HYPHENS = "-‐‑¬­"
EDGES = "“”\"'‘’()[]{},;:?!।॥.—–|…" + HYPHENS
_IGNORABLE = re.compile("[​‎‏⁠﻿]")
_PAGE = re.compile(r"(?:p|pp|pg|page|no|पृ|पृष्ठ|पाना|पेज)?[.\s]*[\[(—–\-\s]*(?:\d{1,4}|[ivxlc]{1,7})[\])—–\-\s.]*(?:(?:/|of)\s*\d{1,4})?[\s\])]*", re.IGNORECASE)
_TAIL = re.compile(r"(?:\s{2,}|\s*\|\s*|\t)(?:p|pp|pg|page|no|पृ|पृष्ठ|पाना|पेज)?[.\s]*[\[(—–\-\s]*(?:\d{1,4}|[ivxlc]{1,7})[\])—–\-\s.]*(?:(?:/|of)\s*\d{1,4})?[\s\])]*$", re.IGNORECASE)
_HEAD = re.compile(r"^(?:p|pp|pg|page|no|पृ|पृष्ठ|पाना|पेज)?[.\s]*[\[(—–\-\s]*(?:\d{1,4}|[ivxlc]{1,7})[\])—–\-\s.]*(?:(?:/|of)\s*\d{1,4})?[\])]*(?:\s{2,}|\s*\|\s*|\t)", re.IGNORECASE)
_ENDS = re.compile(r"[।॥.?!…][”\"'’)\]]*$")


def plain(text: str) -> str:
    return unicodedata.normalize("NFC", _IGNORABLE.sub("", text).replace("\u00a0", " ").replace("\u202f", " "))


def is_page_number(line: str) -> bool:
    s = line.strip()
    return bool(s) and bool(_PAGE.fullmatch(s)) and (any(c.isdigit() for c in s) or s.isascii())


class Page:
    """The lines of a text and the part each plays, as far as the page itself tells."""

    def __init__(self, text: str):
        self.lines = plain(text).split("\n")
        at = [i for i, s in enumerate(self.lines) if s.strip()]
        self.numbers: set[int] = set()
        self.titles: dict[int, tuple[str, bool]] = {}  # line -> (title, is one by its page number, year or length)
        if len(at) > 1:
            widest = max(len(self.lines[i].strip()) for i in at)
            for side in (at[:2], at[-1:-3:-1]) if len(at) > 2 else (at[:1], at[1:]):
                found = False
                for i in side:
                    if is_page_number(self.lines[i]):
                        self.numbers.add(i)
                    elif not found and i not in self.titles and (t := self._title(i, widest)):
                        # of two lines, the shorter one is no title by its length alone
                        bare = " ".join(self.lines[i].split()).lower() == t[0]
                        self.titles[i], found = (t[0], t[1] and not (bare and len(at) == 2)), True
                    else:
                        break
        self.body = [i for i in at if i not in self.numbers]

    def _title(self, i: int, widest: int) -> tuple[str, bool] | None:
        s = self.lines[i].strip()
        bare = _HEAD.sub("", _TAIL.sub("", s)).strip()
        w = bare.split()
        if not 1 <= len(w) <= TITLE_WORDS or _ENDS.search(bare) or bare[-1] in HYPHENS or bare[0] in "“\"(" or any(c.isdigit() for c in bare):
            return None
        if not any(c.isalpha() for c in bare):
            return None
        if len(bare) > WIDE * widest and bare == s:
            return None
        return " ".join(w).lower(), bare != s or len(bare) <= NARROW * widest

    def unsure(self) -> list[int]:
        """Lines that are titles only if the corpus bears them out; two at most."""
        return [i for i, (_, sure) in self.titles.items() if not sure]

    def body_hash(self) -> str:
        """Of the lines that are neither titles nor page numbers."""
        return blake2b("\n".join(self.lines[i].strip() for i in self.body if i not in self.titles).encode(errors="surrogatepass"), digest_size=12).hexdigest()

    def words(self, skip: set[int]) -> Iterator[tuple[int, int, str, int]]:
        """(line, its next body line, word, length of the part before a break or 0) of the lines not skipped."""
        rows = [i for i in self.body if i not in skip]
        carried = 0
        for k, i in enumerate(rows):
            parts = self.lines[i].split()
            for j, w in enumerate(parts):
                if j == 0 and carried:
                    carried = 0
                    continue
                if j == len(parts) - 1 and len(w) > 1 and w[-1] in HYPHENS and w[-2] not in EDGES and k + 1 < len(rows):
                    left, right = w.rstrip(HYPHENS).lstrip(EDGES), self.lines[rows[k + 1]].split()[0]
                    if left and right[0].isalpha() or unicodedata.category(right[0])[0] == "M":
                        carried = 1
                        yield i, rows[k + 1], w[-1] + left + "\n" + right.rstrip(EDGES), len(left)
                        continue
                w = w.strip(EDGES)
                if len(w) > 1:
                    yield i, i, w, 0


def _number(word: str) -> bool:
    return not any(c.isalpha() for c in word)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, item, title, n): words (w), words of pages (p) of a partition; with a title, what to add if it is body text."""
    counts: Counter = Counter()

    def out():
        items = [(*k, n) for k, n in counts.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in items], pa.string()) for c in range(3)] + [pa.array([x[3] for x in items], pa.int64())], names=["kind", "item", "title", "n"])

    def of_page(p: Page, skip: set[int]) -> Counter:
        words = (w[1:].replace("\n", "") if cut else w for _, _, w, cut in p.words(skip))
        return Counter(w for w in words if not _number(w))

    for b in batches:
        for text, page in zip(b.column(0), b.column(1), strict=True):
            text = text.as_py()
            if not text:
                continue
            if page.as_py():
                p = Page(text)
                sure = of_page(p, set(p.titles))
                found = [("", sure)]
                for i in p.unsure():
                    more = of_page(p, set(p.titles) - {i})
                    more.subtract(sure)
                    found.append((p.titles[i][0], more))
                for title, held in found:
                    for w, n in held.items():
                        if n:
                            counts["w", w, title] += n
                            counts["p", w, title] += n
            else:
                counts.update(("w", w, "") for x in plain(text).split() if len(w := x.strip(EDGES)) > 1 and not _number(w))
        if len(counts) > 400_000:
            yield out()
    yield out()


def count_items(texts: DataFrame) -> DataFrame:
    """texts: text, page (has several lines). Counts over the different texts, so that copies are no evidence; combined before the shuffle."""
    texts = texts.where("text is not null").groupBy("text").agg(F.max("page").alias("page"))
    return texts.mapInArrow(_count, "kind string, item string, title string, n long").groupBy("kind", "item", "title").agg(F.sum("n").alias("n"))


_KEYS = """
  flatten(array(
    array(struct(0L as gone, '' as part)),
    transform(array_distinct(chars), c -> struct(pmod(xxhash64(c), 1099511627776) as gone, c as part)),
    transform(array_distinct(transform(sequence(1, greatest(1, size(chars) - 1)), i -> concat(chars[i - 1], coalesce(get(chars, i), '')))),
      p -> struct(pmod(xxhash64(substring(p, 1, 1)), 1099511627776) + pmod(xxhash64(substring(p, 2, 1)), 1099511627776) as gone, p as part))))
"""


def _anagram_keys(words: DataFrame) -> DataFrame:
    """word, n, part taken out, anagram hash of the rest."""
    return (
        words.withColumn("chars", F.split("word", ""))
        .withColumn("hash", F.expr("aggregate(transform(chars, c -> pmod(xxhash64(c), 1099511627776)), 0L, (a, x) -> a + x)"))
        .select("word", "n", "hash", F.explode(F.expr(_KEYS)).alias("k"))
        .select("word", "n", (F.col("hash") - F.col("k.gone")).alias("rest"), F.col("k.part").alias("part"))
        .where("length(part) < 2 or length(part) = 2")
    )


def find_confusions(counts: DataFrame) -> DataFrame:
    """Corrections (word, variant, wrong, right, n_words) ranked by how many words their confusion explains.

    counts: kind, item, n of :func:`count_items`, titles decided.
    """
    lexicon = counts.where("kind = 'w' and length(item) > 2").select(F.col("item").alias("word"), "n")
    frequent = _anagram_keys(lexicon.where(F.col("n") >= LEAST)).select(F.col("word").alias("variant"), F.col("n").alias("n_variant"), "rest", F.col("part").alias("right"))
    of_pages = counts.where("kind = 'p'").select(F.col("item").alias("word"))
    rare = _anagram_keys(lexicon.join(of_pages, "word", "left_semi")).select("word", "n", "rest", F.col("part").alias("wrong"))
    near = rare.join(frequent, "rest").where(
        (F.col("n_variant") >= RATIO * F.col("n")) & (F.length("wrong") + F.length("right")).between(1, 3) & (F.abs(F.length("wrong") - F.length("right")) < 2) & (F.col("wrong") != F.col("right"))
        # a pair is needed only where no single character tells the same
        & ((F.length("wrong") < 2) | (~F.col("wrong").contains(F.col("right"))) | (F.length("right") == 0)) & ((F.length("right") < 2) | (~F.col("right").contains(F.col("wrong"))) | (F.length("wrong") == 0))
        & F.expr("exists(sequence(1, length(word) + 1), i -> overlay(word placing right from i for length(wrong)) = variant and substring(word, i, length(wrong)) = wrong)"))
    # a change at an end may be another ending of the word: it is no evidence for a confusion
    near = near.withColumn("inner", F.expr("left(word, 1) = left(variant, 1) and right(word, 1) = right(variant, 1)"))
    near = materialize(near.select("word", "variant", "wrong", "right", "n_variant", "inner").distinct(), "p5-near")
    ranked = near.groupBy("wrong", "right").agg(F.countDistinct(F.when(F.col("inner"), F.col("word"))).alias("n_words"))
    back = ranked.select(F.col("right").alias("wrong"), F.col("wrong").alias("right"), F.col("n_words").alias("n_back"))
    ranked = ranked.join(back, ["wrong", "right"], "left").where((F.col("n_words") >= SUPPORT) | (F.col("n_words") >= REVERSED) & (F.col("n_back") >= SUPPORT) & (F.length("wrong") > 0) & (F.length("right") > 0)).drop("n_back")
    best = F.max_by(F.struct("variant", "wrong", "right", "n_words"), F.struct("n_words", "n_variant", "variant"))
    return near.join(ranked, ["wrong", "right"]).groupBy("word").agg(best.alias("b")).select("word", "b.*")


_ITEMS = "tbl string, id long, line_no int, next_line int, kind string, item string, part string, cut int, sure boolean, sample string, body string, given string"


def _body_items(p: Page, skip: set[int]) -> Iterator[tuple]:
    seen = set()
    for i, nxt, w, cut in p.words(skip):
        if cut:
            left, _, right = w[1:].partition("\n")
            yield i, nxt, "break", left + right, left + "-" + right, cut, w[0] in "¬­"
        elif (i, w) not in seen and not _number(w):
            seen.add((i, w))
            yield i, nxt, "word", w, None, 0, True


def _page_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for tbl, key, text, sample in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
            p = Page(text)
            out += [(tbl, key, i, i, "page_number", None, None, 0, True, None, None, None) for i in p.numbers]
            body = p.body_hash() if p.titles else None
            out += [(tbl, key, i, i, "title", t, t.partition(" ")[2], 0, sure, sample, body, None) for i, (t, sure) in p.titles.items()]
            # a title that the corpus does not bear out is body text: what depends on it is given for each outcome
            unsure = p.unsure()
            cases = {}
            for held in itertools.chain.from_iterable(itertools.combinations(sorted(unsure), n) for n in range(len(unsure) + 1)):
                cases[",".join(map(str, held))] = dict.fromkeys(_body_items(p, set(p.titles).difference(unsure).union(held)))
            first, *others = cases.values()
            always = {x for x in first if all(x in o for o in others)}
            out += [(tbl, key, *x, None, None, None) for x in first if x in always]
            out += [(tbl, key, *x, None, None, given) for given, xs in cases.items() for x in xs if x not in always]
        cols = list(zip(*out, strict=True)) if out else [[]] * 12
        kinds = [pa.string(), b.schema.field(1).type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["tbl", "id", "line_no", "next_line", "kind", "item", "part", "cut", "sure", "sample", "body", "given"])


def _title_pages(titles: DataFrame) -> DataFrame:
    """(item, n_title, n_suffix): different pages of each title, and different titles that share all but its first word.

    Rows of one sample or of one body are one page, as are rows linked over two of these.
    """
    rows = titles.select("item", "body", F.coalesce("sample", "body").alias("sample")).distinct()
    by_body = rows.groupBy("item", "body").agg(F.min("sample").alias("page"))
    by_sample = rows.join(by_body, ["item", "body"]).groupBy("item", "sample").agg(F.min("page").alias("page"))
    known = by_sample.groupBy("item").agg(F.countDistinct("page").alias("n_title"))
    known = known.withColumn("part", F.expr("case when instr(item, ' ') > 0 then substring(item, instr(item, ' ') + 1) else '' end"))
    suffixes = known.where("part <> ''").groupBy("part").agg(F.count("*").alias("n_suffix"))
    return known.join(suffixes, "part", "left").select("item", "n_title", "n_suffix")


def find_noise(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """(tbl, id, line_no, kind, item, variant) of every noisy line of the pages.

    pages: tbl, id, text, and sample if known. texts: text, page — all texts of the corpus, for counts.
    kind: hyphen, header, page_number or misread; item and variant: the broken or
    misread word and what it becomes.
    """
    sample = F.col("sample") if "sample" in pages.columns else F.lit(None)
    pages = pages.where("text is not null").select("tbl", "id", "text", sample.cast("string").alias("sample"))
    items = materialize(pages.mapInArrow(_page_items, _ITEMS), "p5-items")
    text = F.xxhash64("text")
    different = pages.agg(F.least(F.countDistinct(F.coalesce("sample", text.cast("string"))), F.countDistinct(text))).first()[0]
    needed = max(TITLES, TITLE_SHARE * different)
    nothing = F.lit(None).cast("string")
    numbers = items.where("kind = 'page_number'").select("tbl", "id", "line_no", F.lit("page_number").alias("kind"), nothing.alias("item"), nothing.alias("variant"))
    known = _title_pages(items.where("kind = 'title'"))
    borne = materialize(known.where((F.col("n_title") >= needed) | (F.col("n_suffix") >= SUFFIXES)).select(F.col("item").alias("title"), F.lit(True).alias("borne")), "p5-titles")
    edge = items.where("kind = 'title'").select("tbl", "id", "line_no", "sure", F.col("item").alias("title")).join(borne, "title", "left").where("sure or borne")
    headers = edge.select("tbl", "id", "line_no", F.lit("header").alias("kind"), nothing.alias("item"), nothing.alias("variant"))
    held = edge.where("not sure").groupBy("tbl", "id").agg(F.concat_ws(",", F.sort_array(F.collect_set("line_no")).cast("array<string>")).alias("held"))  # two at most
    told = items.where("given is not null").join(held, ["tbl", "id"], "left").where("given = coalesce(held, '')").drop("held")
    told = items.where("given is null").unionByName(materialize(told, "p5-told"))
    raw = materialize(count_items(texts), "p5-raw")
    raw = raw.where("title = ''").unionByName(raw.where("title <> ''").join(borne, "title", "left_anti"))
    counts = materialize(raw.groupBy("kind", "item").agg(F.sum("n").alias("n")).where("n > 0"), "p5-counts")
    corrections = find_confusions(counts)
    freq = counts.where("kind = 'w'").select("item", "n")
    breaks = told.where("kind = 'break'").join(freq.select("item", F.col("n").alias("n_joined")), "item", "left").join(freq.select(F.col("item").alias("part"), F.col("n").alias("n_hyphen")), "part", "left")
    broken = breaks.where("sure or coalesce(n_hyphen, 0) = 0 or coalesce(n_joined, 0) > 3 * n_hyphen")
    hyphens = broken.select("tbl", "id", "line_no", F.lit("hyphen").alias("kind"), F.col("part").alias("item"), F.col("item").alias("variant"))
    # the hyphenated form stands for a compound
    whole = breaks.join(broken.select("tbl", "id", "line_no"), ["tbl", "id", "line_no"], "left_anti").select("tbl", "id", "line_no", "next_line", F.col("part").alias("item"), "cut")
    read = told.where("kind = 'word'").select("tbl", "id", "line_no", "next_line", "item", "cut").unionByName(broken.select("tbl", "id", "line_no", "next_line", "item", "cut")).unionByName(whole)
    wrong = read.join(corrections, read["item"] == corrections["word"])
    at = F.expr("coalesce(array_min(filter(sequence(1, length(word)), i -> substring(word, i, 1) <> substring(variant, i, 1))), length(word))")
    misread = wrong.select("tbl", "id", F.when((F.col("cut") > 0) & (at > F.col("cut")), F.col("next_line")).otherwise(F.col("line_no")).alias("line_no"), F.lit("misread").alias("kind"), "item", "variant")
    return numbers.unionByName(headers).unionByName(hyphens).unionByName(misread)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = read_table(spark, sf_dir, "manifest").select(F.lit("manifest").alias("tbl"), F.col("row_id").alias("id"), "text", (F.col("text").contains("\n") | F.coalesce(F.col("metadata")["unit"] == "page", F.lit(False))).alias("page"), F.col("sample_id").alias("sample"))
    e = read_table(spark, sf_dir, "page_eval").select(F.lit("page_eval").alias("tbl"), F.col("eval_id").alias("id"), F.col("prediction_text").alias("text"), F.lit(True).alias("page"), F.col("sample_id").alias("sample"))
    both = m.unionByName(e)
    return both.where("page and text is not null"), both.select("text", "page")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_noise(*_inputs(spark, sf_dir)).select("tbl", F.col("id").alias("record_id"), "line_no", "kind").distinct()


def rebuild(text: str, noise: list) -> str:
    """The paragraphs of a page without its noise. noise: (line_no, kind, item, variant)."""
    lines = plain(text).split("\n")
    drop = {n["line_no"] for n in noise if n["kind"] in ("header", "page_number")}
    breaks = {n["line_no"] for n in noise if n["kind"] == "hyphen"}
    fixes = [(n["item"], n["variant"]) for n in noise if n["kind"] == "misread"]
    widest = max((len(s) for i, s in enumerate(lines) if i not in drop), default=0)
    out, current, glue = [], "", ""
    for i, s in enumerate(lines):
        if i in drop:
            continue
        s = s.strip()
        if i in breaks:
            current, glue = current + glue + s.rstrip(HYPHENS), ""
        else:
            current, glue = current + glue + s, "" if s[-1:] in HYPHENS else " "
        if not s or _ENDS.search(s) and len(s) < 0.8 * widest:
            out, current, glue = [*out, current.strip()], "", ""
    out.append(current.strip())
    text = "\n".join(p for p in out if p)
    for wrong, right in fixes:
        text = re.sub(rf"(?<![^\W\d_]){re.escape(wrong)}(?![^\W\d_])", lambda _, r=right: r, text)
    return text


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as continuous clean paragraphs."""
    pages, texts = _inputs(spark, sf_dir)
    noise = find_noise(pages, texts).groupBy("tbl", "id").agg(F.collect_list(F.struct("line_no", "kind", "item", "variant")).alias("noise"))  # bounded by the page

    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, found in it:
            yield pd.Series([rebuild(t, list(n) if n is not None else []) for t, n in zip(text, found, strict=True)], dtype=object)

    made = F.pandas_udf(run, "string")
    return pages.join(noise, ["tbl", "id"], "left").select("tbl", F.col("id").alias("record_id"), made("text", "noise").alias("text"))
