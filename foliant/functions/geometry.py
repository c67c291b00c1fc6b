"""Boxes as columns: struct<x, y, w, h> of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x, y, w, h) -> Column:
    return F.struct(*[F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.cast("double").alias(n) for v, n in zip((x, y, w, h), "xywh", strict=True)])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def union_box(b: Column) -> Column:
    """Aggregate: the box around all boxes of a group."""
    x, y = F.min(b["x"]), F.min(b["y"])
    return F.struct(x.alias("x"), y.alias("y"), (F.max(b["x"] + b["w"]) - x).alias("w"), (F.max(b["y"] + b["h"]) - y).alias("h"))


def iou_py(a, b) -> float:
    """The same of two (x, y, w, h), inside grouped maps."""
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(w, 0.0) * max(h, 0.0)
    union = a[2] * a[3] + b[2] * b[3] - both
    return both / union if union > 0 else 0.0
