"""Reading orders of the lines or boxes of a page, by rule.

Modes whose order is a sort key stay in the JVM: one window over (page). Modes
that carry state from line to line take the page as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliant.operators.layout import column_bands

# Least lines of a page and of either half that may be two columns, and how far apart their middles are.
TWO_COLUMNS, HALF, APART = 8, 3, 0.22
# Band of the wide columns (least width, share of the page).
WIDE_BAND, WIDE_SHARE = 600.0, 0.45
# What makes a page one of wide columns from right to left (lines, page width, spread of centres, spread of widths).
WIDE_LINES, WIDE_PAGE, WIDE_SPAN, WIDE_IQR = 4, 1200.0, 0.55, 0.55
# Reach of a row from its anchor (least, share of the row height).
ROW_LEAST, ROW_SHARE = 12.0, 0.75


def center(box: str = "") -> tuple[Column, Column]:
    return F.col(f"{box}x") + F.col(f"{box}w") / 2, F.col(f"{box}y") + F.col(f"{box}h") / 2


def layout_features(boxes: DataFrame, page: list[str], width: str) -> DataFrame:
    """Per page: lines, spread of centres and of widths in relation to the page, and clusters of centres.

    Quartiles interpolate. A cluster ends at a gap of more than the lesser of 0.18 of the page and 1.5 median widths, 80 at least.
    """
    cx, _ = center()
    got = boxes.groupBy(*page).agg(
        F.max(width).alias("page_width"), F.count("*").alias("n_lines"), (F.max(cx) - F.min(cx)).alias("x_span"), F.percentile("w", F.lit(0.5)).alias("median_width"),
        (F.percentile("w", F.lit(0.75)) - F.percentile("w", F.lit(0.25))).alias("width_iqr"), F.array_sort(F.collect_list(cx)).alias("_c"))  # bounded by the page
    gap = F.greatest(F.lit(80.0), F.least(0.18 * F.col("page_width"), 1.5 * F.col("median_width")))
    wide = F.filter(F.zip_with(F.slice("_c", 1, F.greatest(F.size("_c") - 1, F.lit(0))), F.slice("_c", 2, F.size("_c")), lambda a, b: b - a), lambda d: d > F.col("_gap"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return got.withColumn("_gap", gap).withColumn("x_clusters", F.size(wide) + 1).withColumn("x_span_ratio", share("x_span", "page_width")).withColumn("width_iqr_ratio", share("width_iqr", "median_width")).drop("_c", "_gap")


def is_wide_right_to_left(features: DataFrame) -> Column:
    return (F.col("n_lines") >= WIDE_LINES) & (F.col("page_width") >= WIDE_PAGE) & (F.col("x_span_ratio") >= WIDE_SPAN) & (F.col("width_iqr_ratio") <= WIDE_IQR)


def two_columns(boxes: DataFrame, page: list[str], width: str) -> DataFrame:
    """(page, is_two_column): enough lines in either half, with middles far enough apart."""
    cx, _ = center()
    left = cx < F.col(width) / 2
    got = boxes.groupBy(*page).agg(
        F.max(width).alias("_w"), F.count("*").alias("n"), F.count_if(left).alias("n_left"), F.count_if(~left).alias("n_right"),
        F.percentile(F.when(left, cx), F.lit(0.5)).alias("l"), F.percentile(F.when(~left, cx), F.lit(0.5)).alias("r"))
    shape = (F.col("n") >= TWO_COLUMNS) & (F.col("n_left") >= HALF) & (F.col("n_right") >= HALF) & (F.col("r") - F.col("l") >= APART * F.col("_w"))
    return got.select(*page, F.coalesce(shape & (F.col("_w") > 0), F.lit(False)).alias("is_two_column"))


def order_keys(mode: Column | str, width: str, row_height: float) -> list[Column]:
    """Sort keys of the modes rows_ltr, rows_rtl, columns_ltr, columns_rtl, wide_rtl and top_to_bottom; the mode may differ by row."""
    m = F.lit(mode) if isinstance(mode, str) else mode
    cx, cy = center()
    half = (cx >= F.col(width) / 2).cast("int")
    band = F.greatest(F.lit(WIDE_BAND), WIDE_SHARE * F.col(width))
    first = F.when(m == "columns_ltr", half).when(m == "columns_rtl", 1 - half).when(m == "wide_rtl", -F.floor(cx / band)).when(m == "top_to_bottom", F.col("y")).otherwise(F.floor(cy / row_height))
    second = F.when(m.isin("columns_ltr", "columns_rtl"), cy).when(m == "wide_rtl", F.col("y")).when(m == "top_to_bottom", F.col("x")).when(m == "rows_rtl", -cx).otherwise(cx)
    third = F.when(m == "wide_rtl", -F.col("x")).when(m == "top_to_bottom", F.col("h")).when(m.isin("columns_ltr", "columns_rtl"), cx).otherwise(cy)
    return [first.cast("double"), second.cast("double"), third.cast("double")]


def ordered(boxes: DataFrame, page: list[str], mode: str, width: str, row_height: float = 24.0, tie: str = "line_no") -> DataFrame:
    """``boxes`` with position from 0 in the order of the mode; ``auto`` takes two columns where a page has their shape, else rows."""
    m: Column | str = mode
    if mode == "auto":
        boxes = boxes.join(two_columns(boxes, page, width), page)
        m = F.when(F.col("is_two_column"), "columns_ltr").otherwise("rows_ltr")
    by = W.partitionBy(*page).orderBy(*order_keys(m, width, row_height), tie)
    return boxes.withColumn("position", F.row_number().over(by) - 1).drop("is_two_column")


def anchored_rows(boxes: list[tuple], row_height: float, right_to_left: bool = False) -> list[int]:
    """Order of boxes (x, y, w, h) in rows. A row's anchor is the mean of the tops of its boxes; a box too far below it begins the next row."""
    rows: list[list[int]] = []
    reach = max(ROW_LEAST, ROW_SHARE * row_height)
    for i in sorted(range(len(boxes)), key=lambda i: (boxes[i][1], boxes[i][0], i)):
        if rows and abs(boxes[i][1] - sum(boxes[j][1] for j in rows[-1]) / len(rows[-1])) <= reach:
            rows[-1].append(i)
        else:
            rows.append([i])
    side = -1 if right_to_left else 1
    return [i for r in rows for i in sorted(r, key=lambda i: (side * (boxes[i][0] + boxes[i][2] / 2), boxes[i][1], i))]


def overlapping_columns(boxes: list[tuple], page_width: float) -> list[int]:
    """Order of boxes column by column: a box joins the nearest column that it overlaps, or whose middle is near enough."""
    if not boxes:
        return []
    widths = sorted(b[2] for b in boxes)
    m = len(widths) // 2
    reach = max(24.0, min(0.18 * page_width, 1.2 * (widths[m] if len(widths) % 2 else (widths[m - 1] + widths[m]) / 2)))
    columns: list[dict] = []
    for i in sorted(range(len(boxes)), key=lambda i: (boxes[i][0] + boxes[i][2] / 2, boxes[i][1])):
        x, _, w, _ = boxes[i]
        c = x + w / 2
        near = [k for k in columns if min(x + w, k["right"]) > max(x, k["left"]) or abs(c - k["mean"]) <= reach]
        if near:
            k = min(near, key=lambda k: abs(c - k["mean"]))
        else:
            columns.append(k := {"left": x, "right": x + w, "centers": [], "members": []})
        k["members"].append(i)
        k["centers"].append(c)
        k["mean"], k["left"], k["right"] = sum(k["centers"]) / len(k["centers"]), min(k["left"], x), max(k["right"], x + w)
    key = lambda i: (boxes[i][1], boxes[i][0], boxes[i][3], boxes[i][2])
    return [i for k in sorted(columns, key=lambda k: (k["mean"], k["left"])) for i in sorted(k["members"], key=key)]


#: Orders that carry state along a page: name -> function of its boxes and width.
STATEFUL = {
    "column_bands": lambda boxes, width: column_bands(boxes), "overlapping_columns": overlapping_columns,
    "anchored_ltr": lambda boxes, width: anchored_rows(boxes, 24.0), "anchored_rtl": lambda boxes, width: anchored_rows(boxes, 24.0, True),
}


def page_order(pages: DataFrame, key: str, boxes: str, mode: str, width: float, keep: bool = False) -> DataFrame:
    """(key, order), with the boxes if ``keep``: for each page, whose boxes are one array of (x, y, w, h), the indices in reading order. A map over rows: no shuffle."""
    place = STATEFUL[mode]

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda page: place([(b["x"], b["y"], b["w"], b["h"]) for b in page], width) if page is not None else None)

    return pages.select(key, *([boxes] if keep else []), F.pandas_udf(run, "array<int>")(F.col(boxes)).alias("order"))
