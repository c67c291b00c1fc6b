"""Outputs of several recognisers put together: nearest lines, filled structure, refined cells and captions, routes.

Each is a join or one aggregation on the page; what is greedy along a page runs on the page's arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import dist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.geometry import box, iou, iou_py

# Words that mark figures and captions.
FIGURE_MARKER = r"(?i)^\s*(?:\[(?:figure|chart|image|चित्र)[^\]]*\]|(?:figure|fig\.?|chart|चित्र)\s*[:：]?)"
CAPTION = r"(?i)^\s*(?:caption|figure|fig\.?|चित्र|तालिका)\s*[\s\d०-९IVXivx.-]*[:：]"
CAPTION_WORDS = ("figure", "fig", "caption", "चित्र", "तालिका")


def is_figure_marker(c: Column) -> Column:
    return F.coalesce(c.rlike(FIGURE_MARKER), F.lit(False))


def is_caption(c: Column) -> Column:
    return F.coalesce(c.rlike(CAPTION), F.lit(False))


def caption_score(c: Column) -> Column:
    """Least edit distance of a text's beginning to a caption word of the same length; null for null."""
    v = F.lower(F.trim(c))
    return F.least(*[F.levenshtein(F.substring(v, 1, len(w)), F.lit(w)) for w in CAPTION_WORDS])


def merge_outputs(outputs: list[DataFrame], names: list[str]) -> DataFrame:
    """Lines of all systems under one another, with the system's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [o.withColumn("system", F.lit(n)) for o, n in zip(outputs, names, strict=True)])


def nearest_lines(target: list[tuple], source: list[tuple]) -> list[tuple[int | None, float, float]]:
    """For each target box in turn the free source box of most overlap, of equals the one with the nearest middle: (index, IoU, distance).

    No overlap is asked for: while sources are left, every target gets one.
    """
    free = dict(enumerate(source))
    mid = lambda b: (b[0] + b[2] / 2, b[1] + b[3] / 2)
    out: list[tuple[int | None, float, float]] = []
    for t in target:
        best = min(((-iou_py(t, s), dist(mid(t), mid(s)), j) for j, s in free.items()), default=None)
        if best is None:
            out.append((None, 0.0, float("inf")))
        else:
            del free[best[2]]
            out.append((best[2], -best[0], best[1]))
    return out


_LINE = "struct<text:string,x:double,y:double,w:double,h:double,confidence:double>"


def transfer_text(pages: DataFrame, key: str, primary: str, secondary: str, keep_unmatched: bool = False) -> DataFrame:
    """(key, lines, n_matched): the boxes of the secondary reading with the texts of the primary one.

    primary, secondary: arrays of lines (text, x, y, w, h, confidence), null where a system has no such page; then the
    other's lines are taken as they are. keep_unmatched: primary lines without a partner follow at the end.
    """
    place = lambda v: (v["x"], v["y"], v["w"], v["h"])

    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ps, ss in it:
            out = []
            for p, s in zip(ps, ss, strict=True):
                if p is None or s is None:
                    left = p if p is not None else s if s is not None else []
                    out.append((list(left), len(left) if s is None and p is not None else 0))
                    continue
                found = nearest_lines([place(v) for v in s], [place(v) for v in p])
                lines = [v if j is None else {**v, "text": p[j]["text"], "confidence": p[j]["confidence"]} for v, (j, _, _) in zip(s, found, strict=True)]
                used = {j for j, _, _ in found}
                lines += [v for j, v in enumerate(p) if keep_unmatched and j not in used]
                out.append((lines, len(used - {None})))
            yield pd.DataFrame(out, columns=["lines", "n_matched"])

    made = F.pandas_udf(run, f"lines array<{_LINE}>, n_matched int")(F.col(primary), F.col(secondary))
    return pages.select(key, made.alias("_m")).select(key, "_m.lines", "_m.n_matched")


def backfill(primary: DataFrame, secondary: DataFrame, page: list[str]) -> DataFrame:
    """Items of the primary reading, and those of the secondary one on pages for which the primary has none."""
    return primary.unionByName(secondary.join(primary.select(*page).distinct(), page, "left_anti"), allowMissingColumns=True)


def choose_by_page(items: DataFrame, decisions: DataFrame, page: list[str]) -> DataFrame:
    """Items (with system) of the system that is decided on for each page; pages without a decision keep all."""
    d = decisions.select(*page, F.col("system").alias("_chosen"))
    return items.join(d, page, "left").where(F.col("_chosen").isNull() | (F.col("_chosen") == F.col("system"))).drop("_chosen")


def cell_box(table: dict[str, Column], row: Column, col: Column, rowspan: Column, colspan: Column, rows: Column, cols: Column) -> list[Column]:
    """x, y, w, h of a cell in a table of even rows and columns. table: its x, y, w, h."""
    w, h = table["w"] / F.greatest(cols, F.lit(1)), table["h"] / F.greatest(rows, F.lit(1))
    return [(table["x"] + w * col).alias("x"), (table["y"] + h * row).alias("y"), (w * colspan).alias("w"), (h * rowspan).alias("h")]


def expand_box(x: Column, y: Column, w: Column, h: Column, by: float) -> list[Column]:
    return [(x - by).alias("x"), (y - by).alias("y"), (w + 2 * by).alias("w"), (h + 2 * by).alias("h")]


def replace_cell(policy: str, old: Column, new: Column, old_confidence: Column, new_confidence: Column, gain: float = 0.0) -> Column:
    """Null where the new text takes the cell, else why it does not. Policies: always, empty (only empty cells), confidence."""
    empty = F.trim(F.coalesce(old, F.lit(""))) == ""
    if policy == "always":
        return F.lit(None).cast("string")
    if policy == "empty":
        return F.when(~empty, "non_empty_cell")
    return (
        F.when(empty, F.lit(None).cast("string")).when(new == old, "same_text").when(new_confidence.isNull(), "missing_replacement_confidence")
        .when(old_confidence.isNull(), "missing_existing_confidence").when(new_confidence < old_confidence + gain, "replacement_confidence_not_higher"))


def refine(cells: DataFrame, readings: DataFrame, key: list[str], policy: str, gain: float = 0.0) -> DataFrame:
    """Cells (key, text, confidence) after a second reading of them, with is_replaced and the reason of those that stay."""
    new = readings.select(*key, F.col("text").alias("_text"), F.col("confidence").alias("_confidence"))
    j = cells.join(new, key, "left").withColumn("_why", F.when(F.col("_text").isNull(), "no_reading").otherwise(replace_cell(policy, F.col("text"), F.col("_text"), F.col("confidence"), F.col("_confidence"), gain)))
    taken = F.col("_why").isNull()
    return j.select(*key, F.when(taken, F.col("_text")).otherwise(F.col("text")).alias("text"), F.when(taken, F.col("_confidence")).otherwise(F.col("confidence")).alias("confidence"), taken.alias("is_replaced"), F.col("_why").alias("reason"))


def best_caption(captions: DataFrame, candidates: DataFrame, key: list[str], least_iou: float, least_gain: int) -> DataFrame:
    """Captions, each replaced by the candidate that looks most like one, if its box overlaps enough and it scores better by least_gain.

    captions: key, text, x, y, w, h. candidates: the same; several for a key. One join and one aggregation.
    """
    c = candidates.select(*key, F.col("text").alias("_text"), *[F.col(b).alias(f"_{b}") for b in "xywh"])
    over = iou(box(*[F.col(b) for b in "xywh"]), box(*[F.col(f"_{b}") for b in "xywh"]))
    j = captions.join(c, key, "left").withColumn("_gain", caption_score(F.col("text")) - caption_score(F.col("_text"))).withColumn("_iou", over)
    fits = (F.col("_iou") >= least_iou) & (F.col("_gain") >= least_gain)
    best = F.max_by(F.col("_text"), F.when(fits, F.struct("_gain", "_iou", "_text")))
    return j.groupBy(*key).agg(F.first("text").alias("old"), best.alias("new")).select(*key, F.coalesce("new", "old").alias("text"), F.col("new").isNotNull().alias("is_replaced"))


def route_line(readings: DataFrame, key: list[str], script_ratio: Column, weight: float = 0.25) -> DataFrame:
    """The reading of each line by confidence plus a share of its script ratio; ties by confidence, then the first system."""
    score = F.coalesce("confidence", F.lit(0.0)) + weight * script_ratio
    worst_first = F.struct((-score).alias("a"), (-F.coalesce("confidence", F.lit(0.0))).alias("b"), F.col("system_no"))
    return readings.groupBy(*key).agg(F.min_by(F.struct("system", "text", "confidence"), worst_first).alias("r")).select(*key, "r.*")
