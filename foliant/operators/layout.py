"""Lines and boxes of pages: reading order, blocks, bands, rows, matching."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliant.functions.geometry import iou_py
from foliant.functions.text import looks_like_table_line

#: Geometry of lines that are only text.
LINE_STEP, LINE_HEIGHT, CHAR_WIDTH, LEAST_WIDTH = 28.0, 22.0, 9.0, 50.0


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, text, x, y, w, h, line_id, confidence) of the lines that are not blank."""
    rows = df.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "text"))
    return rows.where(F.trim("text") != "").select(
        key, "line_no", "text", F.lit(0.0).alias("x"), (F.col("line_no") * LINE_STEP).alias("y"),
        F.greatest(F.lit(LEAST_WIDTH), F.length("text") * CHAR_WIDTH).alias("w"), F.lit(LINE_HEIGHT).alias("h"),
        F.concat(F.lit("p0-l"), F.col("line_no")).alias("line_id"), F.lit(1.0).alias("confidence"))


def reading_order(lines: DataFrame, page: list[str]) -> DataFrame:
    """order_no from 0: rows by bucketed y, then x, then y. The bucket is three quarters of
    the page's upper median height, 8 at least; half buckets round to even."""
    med = F.array_sort(F.collect_list(F.when(F.col("h") > 0, F.col("h"))))
    heights = lines.groupBy(*page).agg(med.alias("_hs"))  # bounded by the lines of a page
    bucket = F.greatest(F.lit(8.0), 0.75 * F.coalesce(F.get("_hs", F.floor(F.size("_hs") / 2).cast("int")), F.lit(20.0)))
    order = W.partitionBy(*page).orderBy(F.bround(F.col("y") / F.col("_bucket")), "x", "y", "line_no")
    return lines.join(heights.withColumn("_bucket", bucket).drop("_hs"), page).withColumn("order_no", F.row_number().over(order) - 1).drop("_bucket")


def segment_blocks(lines: DataFrame, page: list[str]) -> DataFrame:
    """block_no and block_type of each line: a block ends at a wide gap or where tables begin or end."""
    by = W.partitionBy(*page).orderBy("order_no")
    kind = F.when(looks_like_table_line(F.col("text")), "table").otherwise("text")
    gap = F.col("y") - (F.lag("y").over(by) + F.lag("h").over(by))
    wide = gap > 1.5 * F.greatest(F.lag("h").over(by), F.lit(24.0))
    rows = lines.withColumn("kind", kind)
    rows = rows.withColumn("starts", (F.lag("kind").over(by).isNull() | (F.lag("kind").over(by) != F.col("kind")) | ((F.col("kind") == "text") & wide)).cast("int"))
    rows = rows.withColumn("block_no", F.sum("starts").over(by.rowsBetween(W.unboundedPreceding, 0)) - 1)
    n = F.count("*").over(W.partitionBy(*page, "block_no"))
    title = (F.col("block_no") == 0) & (F.col("kind") == "text") & (n == 1) & (F.length("text") <= 120)
    return rows.withColumn("block_type", F.when(title, "title").otherwise(F.col("kind"))).drop("starts", "kind")


def blocks(lines: DataFrame, page: list[str]) -> DataFrame:
    """One row per block: type, first line, number of lines, text in order."""
    texts = F.array_sort(F.collect_list(F.struct("order_no", "text")))  # bounded by the page
    return lines.groupBy(*page, "block_no", "block_type").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), texts.alias("t")).withColumn("text", F.array_join(F.transform("t", lambda x: x["text"]), "\n")).drop("t")


def line_array(text: Column) -> Column:
    """The lines that are not blank, with the geometry of :func:`text_lines` and is_table, as one array: a page stays one row."""
    made = F.transform(F.split(text, "\n"), lambda t, i: F.struct(
        i.alias("line_no"), t.alias("text"), F.lit(0.0).alias("x"), (i * LINE_STEP).alias("y"), F.greatest(F.lit(LEAST_WIDTH), F.length(t) * CHAR_WIDTH).alias("w"), F.lit(LINE_HEIGHT).alias("h"), looks_like_table_line(t).alias("is_table")))
    return F.filter(made, lambda v: F.trim(v["text"]) != "")


def order_array(lines: Column) -> Column:
    """An array of lines in the reading order of :func:`reading_order`."""
    hs = F.array_sort(F.filter(F.transform(lines, lambda v: v["h"]), lambda h: h > 0))
    bucket = F.greatest(F.lit(8.0), 0.75 * F.coalesce(F.get(hs, F.floor(F.size(hs) / 2).cast("int")), F.lit(20.0)))
    keyed = F.transform(lines, lambda v: F.struct(F.bround(v["y"] / bucket).alias("a"), v["x"].alias("b"), v["y"].alias("c"), v["line_no"].alias("d"), v.alias("line")))
    return F.transform(F.array_sort(keyed), lambda k: k["line"])


def block_arrays(df: DataFrame, lines: str, out: str) -> DataFrame:
    """``df`` with ``out``: its ordered lines cut into blocks as by :func:`segment_blocks`; no shuffle. Rows without lines have no block."""
    here, before = (lambda i: F.get(F.col(lines), i)), (lambda i: F.get(F.col(lines), i - 1))
    wide = lambda i: here(i)["y"] - (before(i)["y"] + before(i)["h"]) > 1.5 * F.greatest(before(i)["h"], F.lit(24.0))
    begins = lambda i: (i == 0) | (here(i)["is_table"] != before(i)["is_table"]) | (~here(i)["is_table"] & wide(i))
    places = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    cut = df.withColumn("_at", F.filter(places, begins))
    return cut.withColumn(out, F.transform("_at", lambda s, k: F.slice(F.col(lines), s + 1, F.coalesce(F.get("_at", k + 1), F.size(lines)) - s))).drop("_at")


def block_kind(block: Column, no: Column) -> Column:
    """title for one short line of text that is the first block, else table or text."""
    first = F.get(block, F.lit(0))
    title = (no == 0) & ~first["is_table"] & (F.size(block) == 1) & (F.length(first["text"]) <= 120)
    return F.when(title, "title").when(first["is_table"], "table").otherwise("text")


def tables_without_cells(blocks: Column) -> Column:
    """How many of a page's table blocks consist of separator rows only."""
    return F.size(F.filter(blocks, lambda b: F.get(b, F.lit(0))["is_table"] & F.forall(b, lambda v: v["text"].rlike(r"^[\s|:\-+]+$"))))


def structure_faults(segmented: DataFrame, cells: DataFrame, page: list[str]) -> DataFrame:
    """(page, tables_without_cells, blocks_without_lines) of lines with their blocks; a block made of lines is never without."""
    held = cells.select(*page, "line_no").distinct().withColumn("held", F.lit(1))
    got = segmented.join(held, [*page, "line_no"], "left").groupBy(*page, "block_no", "block_type").agg(F.count("held").alias("n_held"), F.count("line_no").alias("n_lines"))
    return got.groupBy(*page).agg(F.count_if((F.col("block_type") == "table") & (F.col("n_held") == 0)).alias("tables_without_cells"), F.count_if(F.col("n_lines") == 0).alias("blocks_without_lines"))


def page_quality(lines: DataFrame, page: list[str], low: float = 0.5, faults: DataFrame | None = None) -> DataFrame:
    """Counts of doubtful lines and the quality score of each page, 0 without lines.

    faults: tables_without_cells and blocks_without_lines of each page, if known; a page it lacks has none.
    """
    n, conf = F.count("*"), F.avg("confidence")
    got = lines.groupBy(*page).agg(
        n.alias("n_lines"), F.count_if(F.col("confidence") < low).alias("n_low"), F.count_if(F.col("confidence").isNull()).alias("n_missing"),
        F.count_if(F.trim("text") == "").alias("n_empty"), F.coalesce(conf, F.lit(0.0)).alias("avg_confidence"))
    share = lambda c: F.col(c) / F.col("n_lines")
    if faults is None:
        got = got.withColumn("tables_without_cells", F.lit(0)).withColumn("blocks_without_lines", F.lit(0))
    else:
        got = got.join(faults, page, "left").fillna(0, ["tables_without_cells", "blocks_without_lines"])
    loss = 0.35 * share("n_low") + 0.2 * share("n_missing") + 0.2 * share("n_empty") + 0.2 * F.greatest(F.lit(0.0), 0.95 - F.col("avg_confidence"))
    loss += F.least(F.lit(0.15), 0.05 * F.col("tables_without_cells")) + F.least(F.lit(0.1), 0.02 * F.col("blocks_without_lines"))
    return got.withColumn("quality_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - loss)), 6))


def concordant_pairs(order: list[int]) -> int:
    """Pairs of positions in rising order, counted in n log n."""
    seen: list[int] = []
    n = 0
    for v in order:
        n += bisect_left(seen, v)
        insort(seen, v)
    return n


def order_accuracy(items: DataFrame, group: str, reference: list[str], predicted: str) -> DataFrame:
    """(group, n_items, concordant, accuracy) of a predicted order; 1.0 below two items.

    Rows stream through in order, sorted by Spark; only the predicted places of
    the current group are held.
    """
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        key, seen, good, began = None, [], 0, False

        def close():
            n = len(seen)
            done.append((key, n, good, good / (n * (n - 1) / 2) if n > 1 else 1.0))

        for pdf in it:
            for k, v in zip(pdf[group].tolist(), pdf[predicted].tolist(), strict=True):
                if not began or k != key:
                    if began:
                        close()
                    key, seen, good, began = k, [], 0, True
                good += bisect_left(seen, v)
                insort(seen, v)
            yield pd.DataFrame(done, columns=[group, "n_items", "concordant", "accuracy"])
            done.clear()
        if began:
            close()
            yield pd.DataFrame(done, columns=[group, "n_items", "concordant", "accuracy"])

    kind = items.schema[group].dataType.simpleString()
    ordered = items.select(group, *reference, predicted).repartition(group).sortWithinPartitions(group, *reference, predicted)
    return ordered.select(group, predicted).mapInPandas(run, f"{group} {kind}, n_items long, concordant long, accuracy double")


def column_bands(boxes: list[tuple], fraction: float = 0.6) -> list[int]:
    """Order of boxes (x, y, w, h) column by column: bands of x-centres, from left to right, around a running mean.

    A box joins the first band whose mean is nearer than ``fraction`` of the median width. Within a band the
    order is by y, x and place; so it is of all boxes where the median width is 0.
    """
    down = lambda i: (boxes[i][1], boxes[i][0], i)
    width = median(b[2] for b in boxes) if boxes else 0
    if width <= 0:
        return sorted(range(len(boxes)), key=down)
    bands: list[tuple[list[int], list[float]]] = []
    for center, i in sorted((x + w / 2, i) for i, (x, _, w, _) in enumerate(boxes)):
        found = next((b for b in bands if abs(center - sum(b[1]) / len(b[1])) < fraction * width), None)
        if found is None:
            bands.append(found := ([], []))
        found[0].append(i)
        found[1].append(center)
    return [i for members, _ in sorted(bands, key=lambda b: sum(b[1]) / len(b[1])) for i in sorted(members, key=down)]


def greedy_match(reference: list[tuple], predicted: list[tuple], least: float) -> list[tuple[int | None, int | None, float]]:
    """One-to-one by IoU: each reference in turn takes the free prediction it overlaps most, if enough."""
    free, out = dict(enumerate(predicted)), []
    for i, r in enumerate(reference):
        best, score = None, 0.0
        for j, p in free.items():
            s = iou_py(r, p)
            if s > score:
                best, score = j, s
        if best is not None and score >= least:
            del free[best]
            out.append((i, best, score))
        else:
            out.append((i, None, 0.0))
    return out + [(None, j, 0.0) for j in free]


def suppress(boxes: list[tuple], scores: list[float], most: float) -> list[int]:
    """Kept boxes of greedy non-maximum suppression: best first, none overlapping a kept one by more."""
    kept: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda i: (-scores[i], i)):
        if all(iou_py(boxes[i], boxes[k]) <= most for k in kept):
            kept.append(i)
    return sorted(kept)


def merge_rows(boxes: list[tuple], gap: float = 40.0, tolerance: float = 0.35) -> list[list[int]]:
    """Groups of boxes that stand in one row, transitively: enough vertical overlap and a small gap."""
    groups: list[tuple[tuple, list[int]]] = []
    for i in sorted(range(len(boxes)), key=lambda i: (boxes[i][1], boxes[i][0])):
        b = boxes[i]
        for n, (u, members) in enumerate(groups):
            overlap = min(u[1] + u[3], b[1] + b[3]) - max(u[1], b[1])
            apart = max(u[0], b[0]) - min(u[0] + u[2], b[0] + b[2])
            if overlap >= tolerance * min(u[3], b[3]) and apart <= gap:
                x, y = min(u[0], b[0]), min(u[1], b[1])
                groups[n] = ((x, y, max(u[0] + u[2], b[0] + b[2]) - x, max(u[1] + u[3], b[1] + b[3]) - y), [*members, i])
                break
        else:
            groups.append((b, [i]))
    return [sorted(m) for _, m in groups]


def match_pages(pages: DataFrame, page: str, reference: str, predicted: str, least: float = 0.5) -> DataFrame:
    """(page, ref_line, pred_line, iou): full outer match of the two arrays of lines of each page; a map over rows, no shuffle."""
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rs, ps in it:
            out = []
            for r, p in zip(rs, ps, strict=True):
                r, p = (x if x is not None else [] for x in (r, p))
                found = greedy_match(*[[(v["x"], v["y"], v["w"], v["h"]) for v in side] for side in (r, p)], least)
                out.append([{"ref_line": int(r[i]["line_no"]) if i is not None else None, "pred_line": int(p[j]["line_no"]) if j is not None else None, "iou": float(s)} for i, j, s in found])
            yield pd.Series(out)

    made = F.pandas_udf(run, "array<struct<ref_line:int,pred_line:int,iou:double>>")(F.col(reference), F.col(predicted))
    return pages.select(page, F.explode(made).alias("_m")).select(page, "_m.*")


def page_marker(text: Column, y: Column, w: Column, h: Column, width: float, height: float) -> Column:
    """At most three digits, low on the page, in a small upright box."""
    return text.rlike(r"^\s*[0-9\x{0966}-\x{096F}]{1,3}\s*$") & (y + h / 2 >= 0.82 * height) & (w <= 0.05 * width) & (h <= 0.04 * height) & (w / h).between(0.15, 1.25)
