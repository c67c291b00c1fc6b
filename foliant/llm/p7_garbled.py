"""Problem 7: text garbled by a wrong character encoding.

Method: for every pair of an encoding a text may be stored in and one it may
have been read with, the garbled sequence of each character of the corpus'
alphabets is computed in advance; an Aho-Corasick automaton finds them all in
one pass, and only the matched spans are replaced. Sequences that are also
sound text (a typographic sign, a letter of the font) count only where the
other evidence of the same text bears them out.

Defined results: null and empty texts are not affected; text with the
replacement character is affected, but that character cannot be restored.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.runtime import read_table

# Encodings text may be stored in, and encodings it may wrongly be read with.
STORED = ("utf-8", "cp1252", "mac_roman", "cp437", "cp850")
READ = (
    "cp1252", "latin-1", "iso8859_15", "mac_roman", "cp437", "cp850", "cp852", "cp866", "cp1250", "cp1251", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257",
    "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_9", "koi8_r", "koi8_u", "mac_cyrillic", "mac_greek", "mac_latin2",
)
# Letters above ASCII of the legacy fonts (the legacy rules give them; these are the defaults).
FONT_LETTERS = "åçéêîñôöü"
# Sound signs and transliteration letters that need no rule.
SOUND_SIGNS = "‘’“”–—…•·°±§¶×÷©®«»₹€№ "
SOUND_LETTERS = "āīūṛṝḷṅñṇṭḍśṣṃḥēōĀĪŪŚṢṬḌṆßàáâæèëìíïòóøùúûœ"

_BLANKS = re.compile(r"(\s+)")


def _decode(raw: bytes, codec: str) -> str | None:
    """Lenient as common software: undefined bytes of a single-byte table stay control characters."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            if codec not in ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254"):
                return None
            out.append(chr(b))
    return "".join(out)


def _alphabet(letters: str) -> list[str]:
    blocks = [range(0xA0, 0x250), range(0x900, 0x980), range(0x1900, 0x1950), range(0x1C00, 0x1C80), range(0x1E00, 0x1F00), range(0x2010, 0x2040), range(0x20A0, 0x20C0), range(0x2100, 0x2130), range(0x11480, 0x114E0), range(0x11BC0, 0x11C00)]
    return list(dict.fromkeys([*letters, *(chr(o) for b in blocks for o in b), "﻿", "​", "‌", "‍"]))


def garbled_sequences(letters: str = FONT_LETTERS) -> dict[str, list[tuple[str, str]]]:
    """garbled sequence -> [(stored>read, original)] for all pairs of encodings."""
    out: dict[str, list[tuple[str, str]]] = defaultdict(list)

    def put(seq: str | None, pair: str, original: str) -> None:
        if seq and seq != original and not seq.isascii():
            out[seq].append((pair, original))

    for read in READ:
        for c in _alphabet(letters):
            put(_decode(c.encode("utf-8"), read), f"utf-8>{read}", c)
        for stored in STORED[1:]:
            for c in letters:
                try:
                    raw = c.encode(stored)
                except UnicodeEncodeError:
                    continue
                put(_decode(raw, read), f"{stored}>{read}", c)
    for c in [*map(chr, range(0x20, 0x7F)), *letters]:  # two-byte text read with its bytes swapped
        put(chr(ord(c) << 8), "utf-16-le>utf-16-be", c)
    return dict(out)


class Repairer:
    """Finds and restores garbled spans. letters: the font's letters above ASCII."""

    ROUNDS = 4  # text garbled several times over

    def __init__(self, letters: str = FONT_LETTERS):
        import ahocorasick

        self.letters = set(letters)
        self.sound = {*letters, *SOUND_SIGNS, *SOUND_LETTERS}
        self.table = garbled_sequences(letters)
        self.altered: dict[str, set[str]] = defaultdict(set)  # the letters that each pair would not leave as they are
        for means in self.table.values():
            for pair, original in means:
                self.altered[pair].add(original)
        self.machine = ahocorasick.Automaton()
        for seq, means in self.table.items():
            self.machine.add_word(seq, (seq, means))
        self.machine.make_automaton()

    def _near(self, text: str, at: int) -> int:
        """How many neighbours of the character are letters of the font."""
        return sum(0 <= i < len(text) and (text[i].isascii() and (text[i].isalpha() or text[i] in "~[") or text[i] in self.letters) for i in (at - 1, at + 1))

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, restored, pair) of the garbled spans, not overlapping, in order."""
        if text.isascii():
            return []
        found: dict[str, list[tuple[int, int, str, float]]] = defaultdict(list)
        for last, (seq, means) in self.machine.iter(text):
            start, end = last + 1 - len(seq), last + 1
            for pair, original in means:
                if len(seq) > 1 or pair.startswith("utf-16"):
                    found[pair].append((start, end, original, float(len(seq))))
                    continue
                near, sign = self._near(text, start), text[start] in SOUND_SIGNS
                # a sign that is also sound text bears weight only inside a word
                if near and not (sign and near < 2 and text[start] in "‘’“”"):
                    found[pair].append((start, end, original, 1.0 if text[start] not in self.sound else 0.5 if sign and near == 2 else 0.1))
        for pair in [p for p in found if p.startswith("utf-16")]:  # the swapped reading needs a run, one rare sign alone is none
            at = {f[0] for f in found[pair]}
            found[pair] = [f for f in found[pair] if f[0] - 1 in at or f[0] + 1 in at]
        out: dict[int, tuple[int, int, str, str]] = {}
        taken: set[int] = set()
        # the pair that explains most of the text comes first
        for pair, spans in sorted(found.items(), key=lambda x: -sum(f[3] for f in x[1])):
            free = [f for f in spans if not taken & set(range(f[0], f[1]))]
            # letters that are also sound are no evidence by themselves, however many
            if sum(f[3] for f in free) < 1.0 or max(f[3] for f in free) < 0.5:
                continue
            # nor is one letter, where others stand that the same mistake would have altered
            if len(free) == 1 and free[0][1] - free[0][0] == 1 and self.letters & self.altered[pair] & set(text):
                continue
            for start, end, original, _ in sorted(free, key=lambda f: (f[0], -f[1])):
                if not taken & set(range(start, end)):
                    out[start] = (start, end, original, pair)
                    taken.update(range(start, end))
        for i, c in enumerate(text):
            if c == "�":
                out[i] = (i, i + 1, c, "lost")
        return [out[k] for k in sorted(out)]

    def restore(self, text: str) -> tuple[list[tuple[int, int, str, str]], str]:
        """(spans in the given text, text with the spans replaced, as often as it was garbled)."""
        first, now = [], text
        for n in range(self.ROUNDS):
            spans = [s for s in self.spans(now) if s[3] != "lost" or not n]
            if not n:
                first = spans
            if not any(s[3] != "lost" for s in spans):
                break
            parts, at = [], 0
            for start, end, original, _ in spans:
                parts += [now[at:start], original]
                at = end
            now = "".join(parts) + now[at:]
        return first, now


@lru_cache(maxsize=2)
def repairer(letters: str) -> Repairer:
    return Repairer(letters)


def find_garbled(df: DataFrame, key: str, text: str, letters: str = FONT_LETTERS) -> DataFrame:
    """(key, spans, encodings, restored, whole) of the affected rows only.

    spans: JSON list of [start, end, restored]. whole: every span could be restored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = repairer(letters)
        for b in batches:
            at, spans, pairs, texts, whole = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                t = t.as_py()
                if not t or t.isascii():
                    continue
                found, now = fix.restore(t)
                if found:
                    at.append(i)
                    spans.append(json.dumps([[s, e, o] for s, e, o, _ in found], ensure_ascii=False))
                    pairs.append(sorted({p for *_, p in found}))
                    texts.append(now)
                    whole.append(all(p != "lost" for *_, p in found))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int32())), pa.array(spans, pa.string()), pa.array(pairs, pa.list_(pa.string())), pa.array(texts, pa.string()), pa.array(whole, pa.bool_())],
                names=[key, "spans", "encodings", "restored", "whole"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"`{key}` {kind}, spans string, encodings array<string>, restored string, whole boolean")


def font_letters(spark: SparkSession, sf_dir: str) -> str:
    """Letters above ASCII that the legacy rules know (at most 128 bytes)."""
    rules = read_table(spark, sf_dir, "legacy_rule")
    held = rules.select(F.explode(F.split("source_bytes", " ")).alias("b")).distinct().collect()
    return "".join(sorted(c for c in (bytes([int(r["b"], 16)]).decode("cp1252", "ignore") for r in held) if c and not c.isascii()))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "limbu_conversion")
    return find_garbled(c, "conversion_id", "legacy_text", font_letters(spark, sf_dir)).select("conversion_id")


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected spans, with the original text where it can be had."""
    c = read_table(spark, sf_dir, "limbu_conversion")
    return find_garbled(c, "conversion_id", "legacy_text", font_letters(spark, sf_dir))
