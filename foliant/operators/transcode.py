"""Legacy font text to Unicode by byte rules."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compile_rules(rows: list[tuple[int, str, str]]) -> dict[str, str]:
    """source -> target from (rule_no, '0x..' bytes, 'U+....' code points); the lower rule_no holds."""
    out: dict[str, str] = {}
    for _, source, target in sorted(rows):
        s = bytes(int(b, 16) for b in source.split()).decode("latin-1")
        out.setdefault(s, "".join(chr(int(t[2:], 16)) for t in target.split()))
    return out


class Transcoder:
    """Longest match first; a vowel sign goes behind the subjoined letters that follow it."""

    def __init__(self, rules: dict[str, str]):
        self.rules = rules
        self.longest = max(map(len, rules), default=1)

    def convert(self, text: str) -> tuple[str, int, list[str]]:
        """(text, characters replaced, code points that no rule knows)."""
        out: list[str] = []
        replaced, unknown, i = 0, set(), 0
        while i < len(text):
            for n in range(min(self.longest, len(text) - i), 0, -1):
                if (t := self.rules.get(text[i : i + n])) is not None:
                    out += t
                    replaced += 1
                    i += n
                    break
            else:
                c = text[i]
                out.append(c)
                # ASCII needs no rule, nor do letters already in the target script
                if not (c.isascii() or 0x1900 <= ord(c) <= 0x194F):
                    unknown.add(f"U+{ord(c):04X}")
                i += 1
        for i in range(len(out) - 1):
            if 0x1920 <= ord(out[i]) <= 0x1928 and 0x1929 <= ord(out[i + 1]) <= 0x192B:
                out[i], out[i + 1] = out[i + 1], out[i]
        return unicodedata.normalize("NFC", "".join(out)), replaced, sorted(unknown)


def transcode(df: DataFrame, text: str, rules: dict[str, str]) -> DataFrame:
    """``df`` with converted: struct of text, n_replaced and unmapped; null for null."""
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = Transcoder(rules)
        for s in it:
            rows = [t.convert(v) if v is not None else (None, None, None) for v in s]
            yield pd.DataFrame({"text": [r[0] for r in rows], "n_replaced": pd.array([r[1] for r in rows], dtype="Int32"), "unmapped": [r[2] for r in rows]})

    made = F.pandas_udf(run, "text string, n_replaced int, unmapped array<string>")
    return df.withColumn("converted", made(F.col(text)))


def map_characters(df: DataFrame, text: str, sure: dict[str, str], unsure: dict[str, str] | None = None, *, take_unsure: bool = True, plain: str = r"\s\x{21}-\x{7E}") -> DataFrame:
    """``df`` with mapped: struct of text, n_sure, n_unsure and unmapped (sorted characters that no table and no ``plain`` class holds).

    For fonts whose every character stands for one text. Built-ins only; null for null. Characters of unsure rules stay
    as they are, and count, unless they are taken.
    """
    unsure = unsure or {}
    used = sure | (unsure if take_unsure else {})
    c = F.split(F.col(text), "")
    table = F.create_map(*[F.lit(x) for p in used.items() for x in p]) if used else F.create_map().cast("map<string,string>")
    count = lambda keys: F.size(F.filter(c, lambda x: x.isin(*keys))) if keys else F.lit(0)
    unknown = F.array_sort(F.array_distinct(F.filter(c, lambda x: (x != "") & ~x.isin(*sure, *unsure) & ~x.rlike(f"^[{plain}]$"))))
    made = F.struct(F.array_join(F.transform(c, lambda x: F.coalesce(F.try_element_at(table, x), x)), "").alias("text"), count(sure).alias("n_sure"), count(unsure).alias("n_unsure"), unknown.alias("unmapped"))
    return df.withColumn("mapped", F.when(F.col(text).isNotNull(), made))


def reorder_clusters(text: Column, base: str, classes: list[str]) -> Column:
    """Signs behind each base letter sorted by the class they are in (stable); all are character classes without brackets.

    Legacy fonts store signs in the order of drawing; Unicode wants them by class. Nothing moves across a base letter.
    """
    rank = lambda x: F.coalesce(*[F.when(x.rlike(f"^[{k}]$"), F.lit(i)) for i, k in enumerate(classes)], F.lit(len(classes)))
    clusters = F.regexp_extract_all(text, F.lit(f"(?s)[{base}][{''.join(classes)}]*|."), F.lit(0))

    def one(k: Column) -> Column:
        signs = F.transform(F.split(F.substring(k, 2, 1 << 20), ""), lambda x, i: F.struct(rank(x).alias("a"), i.alias("b"), x.alias("c")))
        return F.concat(F.substring(k, 1, 1), F.array_join(F.transform(F.array_sort(signs), lambda s: s["c"]), ""))

    return F.array_join(F.transform(clusters, lambda k: F.when(F.length(k) > 2, one(k)).otherwise(k)), "")


def move_prebase(text: Column, prebase: str, base: str) -> Column:
    """Signs drawn before their base letter are put behind it."""
    return F.regexp_replace(text, f"([{prebase}]+)([{base}])", "$2$1")


def decode_private(df: DataFrame, text: str, rules: dict[str, str], prebase: str = "", base: str = "") -> DataFrame:
    """``df`` with decoded: the text by rules for private-use characters (longer ones first), or null if one of them is left. Fails closed."""
    c = F.col(text)
    for source in sorted(rules, key=lambda s: (-len(s), s)):
        c = F.replace(c, F.lit(source), F.lit(rules[source]))
    if prebase:
        c = move_prebase(c, prebase, base)
    return df.withColumn("decoded", F.when(~c.rlike(r"[\x{E000}-\x{F8FF}\x{FFFD}]"), c))


def recover_glyphs(df: DataFrame, characters: str, glyphs: dict[int, str]) -> DataFrame:
    """``df`` with recovered (text) and unknown_glyphs: characters are array<struct<cp:string, gid:int>>, of which replacement
    characters are read by their glyph; the text is null if a glyph is unknown."""
    table = F.create_map(*[x for g, t in glyphs.items() for x in (F.lit(g), F.lit(t))])
    read = lambda v: F.when(v["cp"] == "�", F.try_element_at(table, v["gid"])).otherwise(v["cp"])
    unknown = F.array_sort(F.array_distinct(F.transform(F.filter(characters, lambda v: read(v).isNull()), lambda v: v["gid"])))
    return df.withColumn("unknown_glyphs", unknown).withColumn("recovered", F.when(F.size(unknown) == 0, F.array_join(F.transform(characters, read), "")))


def resolve_alias(value: Column, aliases: dict[str, list[str]]) -> Column:
    """The name one of whose aliases the value is, case, blanks, hyphens and underscores aside; null for others."""
    plain = lambda s: "".join(ch for ch in s.lower() if ch not in " -_")
    table = {plain(a): name for name, names in aliases.items() for a in (name, *names)}
    return F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s_-]", "")))
