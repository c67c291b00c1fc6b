"""Named queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import p1_sample, p2_language, p3_visual, p4_groups, p5_ocr, p6_overlap, p7_garbled, p8_tokens, p9_mix, p10_content

MODULES = (p1_sample, p2_language, p3_visual, p4_groups, p5_ocr, p6_overlap, p7_garbled, p8_tokens, p9_mix, p10_content)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for m in MODULES for n, f in vars(m).items() if n.startswith("p") and n[1].isdigit() and callable(f) and f.__module__ == m.__name__}
