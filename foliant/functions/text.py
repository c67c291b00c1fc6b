"""Text expressions: everything that Spark's built-ins can say stays in them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes used by script profiles.
DEVANAGARI = r"[\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}]"
LIMBU = r"[\x{1900}-\x{194F}]"
LATIN = r"[A-Za-z]"
DIGITS = {"०१२३४५६७८९": "0123456789"}


def char_count(c: Column, pattern: str) -> Column:
    """How many characters of ``c`` are in the class; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0))


def visible_length(c: Column) -> Column:
    return char_count(c, r"\S")


def script_ratio(c: Column, pattern: str) -> Column:
    """Share of the visible characters; 0 for texts without any."""
    n = visible_length(c)
    return F.when(n > 0, char_count(c, pattern) / n).otherwise(F.lit(0.0))


def script_class(c: Column, threshold: float = 0.2) -> Column:
    """mixed, limbu, devanagari or other by the share of the visible characters."""
    limbu, deva = script_ratio(c, LIMBU) >= threshold, script_ratio(c, DEVANAGARI) >= threshold
    return F.when(limbu & deva, "mixed").when(limbu, "limbu").when(deva, "devanagari").otherwise("other")


@F.pandas_udf(T.StringType())
def nfc(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical composition, which Spark has no built-in for; null for null."""
    from unicodedata import is_normalized, normalize

    for s in it:
        yield s.map(lambda t: t if t is None or t.isascii() or is_normalized("NFC", t) else normalize("NFC", t))


def normalize_py(text: str) -> str:
    """As :func:`normalize` with runs of blanks collapsed and the ends trimmed, for code that runs in Python."""
    from unicodedata import category, normalize

    v = normalize("NFC", text.replace("\u00a0", " "))
    if not v.isascii() or any(c < " " for c in v):
        v = "".join(c for c in v if c in "\n\t\r\u200c\u200d" or category(c) not in ("Cc", "Cf"))
    return re.sub("[ \t]+", " ", v).strip()


def normalize(c: Column, collapse: bool = True) -> Column:
    """No-break spaces to spaces, NFC, controls and formats dropped but for line ends,
    tabs and joiners; runs of blanks to one space if asked."""
    v = F.regexp_replace(nfc(F.translate(c, "\u00a0", " ")), r"[\p{Cc}\p{Cf}&&[^\n\t\r\x{200C}\x{200D}]]", "")
    return F.regexp_replace(v, "[ \t]+", " ") if collapse else v


def repair_devanagari_blanks(c: Column) -> Column:
    """Blanks between a virama and a consonant, or before a combining mark, are removed."""
    v = F.regexp_replace(c, r"(?<=\x{094D}) +(?=[\x{0915}-\x{0939}])", "")
    return F.regexp_replace(v, r" +(?=\p{Mn})", "")


def ascii_digits(c: Column) -> Column:
    for native, plain in DIGITS.items():
        c = F.translate(c, native, plain)
    return c


def date_key(c: Column) -> Column:
    """yyyy-mm-dd of a date written so or as dd/mm/yyyy, in any digits; null for others."""
    v = F.trim(ascii_digits(c))
    iso = F.regexp_extract(v, r"^(\d{4})-(\d{2})-(\d{2})$", 0)
    parts = [F.regexp_extract(v, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i) for i in (3, 2, 1)]
    slashed = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.when(iso != "", iso).when(parts[0] != "", slashed)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: inside another lambda a plain expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def edits(a: Column, b: Column, band: int = 64) -> Column:
    """Edit distance; most texts are near each other, so a band is tried before the whole table."""
    tried = F.struct(a.alias("a"), b.alias("b"), F.levenshtein(a, b, band).alias("near"))
    return let(tried, lambda s: F.when(s["near"] >= 0, s["near"]).otherwise(F.levenshtein(s["a"], s["b"])))


def cer(prediction: Column, reference: Column) -> Column:
    """Edit distance by reference length; an empty reference gives 0 to an empty prediction, else 1."""
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(prediction) == 0, 0.0).otherwise(1.0)).otherwise(edits(prediction, reference) / n)


def token_distance(a: list, b: list) -> int:
    """Levenshtein distance of two lists."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def wer(prediction: Column | str, reference: Column | str) -> Column:
    """Word error rate over whitespace tokens; conventions as for the character rate. Null counts as empty.

    Each token becomes the one character of its place among the pair's tokens, so that the built-in for strings counts tokens.
    """
    def words(c: Column | str) -> Column:
        return F.filter(F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"\s+"), lambda t: t != "")

    def characters(tokens: Column, known: Column) -> Column:
        return F.array_join(F.transform(tokens, lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, t) + 0xFFFF), 8, "0")), "UTF-32")), "")

    def rate(s: Column) -> Column:
        return F.when(s["n"] == 0, F.when(s["p"] == "", 0.0).otherwise(1.0)).otherwise(edits(s["p"], s["r"]) / s["n"])

    pair = F.struct(words(prediction).alias("p"), words(reference).alias("r"))
    known = let(pair, lambda s: F.struct(s["p"].alias("p"), s["r"].alias("r"), F.array_distinct(F.concat(s["p"], s["r"])).alias("k")))
    coded = let(known, lambda s: F.struct(characters(s["p"], s["k"]).alias("p"), characters(s["r"], s["k"]).alias("r"), F.size(s["r"]).alias("n")))
    return let(coded, rate)


@F.pandas_udf(T.IntegerType())
def grapheme_count(s: pd.Series) -> pd.Series:
    """Extended grapheme clusters, which Java's regular expressions part differently for Indic conjuncts."""
    import regex

    return s.map(lambda t: len(regex.findall(r"\X", t)) if t else 0)


def looks_like_table_line(c: Column) -> Column:
    """A tab, a row of pipes, or three fields parted by wide blanks."""
    return F.contains(c, F.lit("\t")) | c.rlike(r"^\s*\|.*\|\s*$") | (F.size(F.split(F.trim(c), r" {2,}")) >= 3)


def split_row(c: Column) -> Column:
    """Cells of a table line: by tabs, else pipes (empty ends dropped), else wide blanks."""
    pipes = F.transform(F.filter(F.split(c, r"\|"), lambda x: F.trim(x) != ""), lambda x: F.trim(x))
    return F.when(F.contains(c, F.lit("\t")), F.transform(F.split(c, "\t"), lambda x: F.trim(x))).when(F.contains(c, F.lit("|")), pipes).otherwise(F.split(F.trim(c), r" {2,}"))


def edit_opcodes(a: str, b: str, chunk: int | None = None) -> Iterator[tuple[str, str]]:
    """(part of a, part of b) of each run of equal edits of a shortest alignment, in order; "" for what an edit lacks.

    Bit-parallel (Hyyrö), one whole row to an integer. Of long texts,
    rows are kept only every ``chunk`` characters of b and computed again going
    back, so memory is far below the square of the length. Ties: going back, a deletion, else an
    insertion, else a pair; common ends are matched first.
    """
    least = min(len(a), len(b))
    head = next((i for i in range(least) if a[i] != b[i]), least)
    tail = next((i for i in range(least - head) if a[-1 - i] != b[-1 - i]), least - head)
    x, y = a[head:len(a) - tail], b[head:len(b) - tail]
    chunk = chunk or max(256, 2**26 // (len(x) + 1))
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1

    def rows(vp: int, vn: int, part: str) -> Iterator[tuple[int, int]]:
        for c in part:
            eq = at.get(c, 0)
            d0 = (((eq & vp) + vp) ^ vp) | eq | vn
            hp, hn = (vn | ~(d0 | vp)) << 1 | 1, (d0 & vp) << 1
            vp, vn = (hn | ~(d0 | hp)) & full, hp & d0 & full
            yield vp, vn

    starts = [(full, 0)]
    for k in range(0, len(y) - chunk, chunk):
        for last in rows(*starts[-1], y[k:k + chunk]):
            pass
        starts.append(last)
    ops: list[tuple[str, int, int]] = []
    col, row, base = len(x), len(y), len(y)
    held: list[tuple[int, int]] = []  # rows base to base + chunk; the first is the state before them
    while row and col:
        if row <= base:
            base = (row - 1) // chunk * chunk
            held = [starts[base // chunk], *rows(*starts[base // chunk], y[base:base + chunk])]
        if held[row - base][0] >> (col - 1) & 1:
            col -= 1
            ops.append(("d", col, row))
            continue
        row -= 1
        if row and held[row - base][1] >> (col - 1) & 1:
            ops.append(("i", col, row))
        else:
            col -= 1
            if x[col] != y[row]:
                ops.append(("r", col, row))
    ops += [("d", i, row) for i in range(col - 1, -1, -1)] + [("i", col, j) for j in range(row - 1, -1, -1)]
    ops.reverse()
    k = 0
    while k < len(ops):
        kind, i, j = ops[k]
        i2, j2 = i, j
        while k < len(ops) and ops[k] == (kind, i2, j2):
            i2, j2, k = i2 + (kind != "i"), j2 + (kind != "d"), k + 1
        yield x[i:i2], y[j:j2]
