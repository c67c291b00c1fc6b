"""Review bundles and work orders: rows for people to fill in, and what comes back, as joins and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.corpus import rank_within
from foliant.operators.review import batches


def review_rows(entries: DataFrame, key: Sequence[str], order: Sequence[str], shown: Sequence[str], blank: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Rows of a review table: order_index within the group, the shown fields and empty fields to fill in."""
    ranked = rank_within(entries.select(*dict.fromkeys([*group, *key, *order, *shown])), list(group), [*order, *[k for k in key if k not in order]])
    return ranked.select(*dict.fromkeys([*group, *key]), F.col("rank").alias("order_index"), *[c for c in shown if c not in key and c not in group], *[F.lit("").alias(c) for c in blank])


def open_rows(rows: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """The work order: rows for which nothing has come back."""
    return rows.join(done.select(*key).distinct(), list(key), "left_anti")


def templates(entries: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, payload): one JSON reference for each entry, with the given fields."""
    return entries.select(key, F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}).alias("payload"))


def reviewer_bundle(rows: DataFrame, group: Sequence[str], order: Sequence[str], size: int, reviewers: Sequence[str], prefix: str) -> DataFrame:
    """Rows with batch_no, reviewer and the bundle's file name."""
    got = batches(rows, list(group), list(order), size, list(reviewers))
    return got.withColumn("bundle", F.concat_ws("-", F.lit(prefix), *group, F.lpad(F.col("batch_no").cast("string"), 4, "0"), F.col("reviewer")))


def assisted(rows: DataFrame, suggestions: DataFrame, key: Sequence[str], text: str, rank: str) -> DataFrame:
    """Rows with the best suggestion (highest rank, of equals the least text), its source, or nulls; one aggregation and one join."""
    order = F.struct(F.col(rank).alias("a"), F.col(text).alias("b"))
    best = suggestions.where(F.trim(text) != "").groupBy(*key).agg(F.max_by(F.struct(F.col(text).alias("suggested"), F.col("source").alias("suggested_by")), order).alias("_s"), F.count("*").alias("n_suggestions"))
    return rows.join(best.select(*key, "_s.*", "n_suggestions"), list(key), "left").fillna(0, ["n_suggestions"])


def sidecars(lines: DataFrame, page: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(page, n_lines, payload): the lines of each page in order as one JSON array. Bounded by the page."""
    held = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], *fields)))
    kept = F.transform("_l", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return lines.groupBy(*page).agg(held.alias("_l")).select(*page, F.size("_l").alias("n_lines"), F.to_json(kept).alias("payload"))


def native_references(lines: DataFrame, page: Sequence[str], order: Sequence[str], text: str, sound: Column, least: float) -> DataFrame:
    """(page, n_lines, sound_share, text): the text of pages most of whose lines are sound, else null text."""
    held = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.col(text).alias("t"))))
    got = lines.groupBy(*page).agg(held.alias("_l"), F.avg(F.coalesce(sound, F.lit(False)).cast("double")).alias("sound_share"))
    return got.select(*page, F.size("_l").alias("n_lines"), "sound_share", F.when(F.col("sound_share") >= least, F.array_join(F.transform("_l", lambda x: x["t"]), "\n")).alias("text"))


def verification(entries: DataFrame, returned: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key, status, text) of what came back: verified, empty, conflicting (several different texts) or open."""
    v = F.trim(text)
    per = returned.groupBy(*key).agg(F.count_distinct(F.when(v != "", v)).alias("_n"), F.max(F.when(v != "", v)).alias("_t"), F.lit(True).alias("_there"))
    j = entries.select(*key).distinct().join(per, list(key), "left")
    status = F.when(F.col("_there").isNull(), "open").when(F.col("_n") == 0, "empty").when(F.col("_n") > 1, "conflicting").otherwise("verified")
    return j.select(*key, status.alias("status"), F.when(F.col("_n") == 1, F.col("_t")).alias("text"))


def recognizer_rows(lines: DataFrame, key: str, image: Column, text: Column, dataset: str, split: str, least: int = 1) -> DataFrame:
    """Manifest rows of lines whose text has at least ``least`` visible characters."""
    rows = lines.select(key, image.alias("image_path"), F.trim(text).alias("text")).where(F.length(F.regexp_replace("text", r"\s", "")) >= least)
    return rows.select(F.concat_ws("-", F.lit(dataset), F.col(key).cast("string")).alias("sample_id"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), "image_path", "text")


def documents_from_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """(key, n_blocks, text, headings): blocks (key, line_no, kind, text) as one document. Bounded by the document."""
    held = F.array_sort(F.collect_list(F.struct("line_no", "kind", "text")))
    got = blocks.groupBy(key).agg(held.alias("_b"))
    said = F.filter("_b", lambda b: b["kind"] != "separator")
    return got.select(
        key, F.size(said).alias("n_blocks"), F.array_join(F.transform(said, lambda b: b["text"]), "\n").alias("text"),
        F.array_join(F.transform(F.filter("_b", lambda b: b["kind"] == "heading"), lambda b: b["text"]), "|").alias("headings"))


def error_report(rows: DataFrame, systems: Sequence[str], value: str, slices: Column, lower_is_better: bool = True) -> DataFrame:
    """(slice, system, n, mean, worst) by slice and over all, for each system."""
    worst = F.max(value) if lower_is_better else F.min(value)
    spread = F.array_distinct(F.concat(F.coalesce(slices, F.array().cast("array<string>")), F.array(F.lit("all"))))
    return rows.where(F.col("system").isin(*systems) & F.col(value).isNotNull()).withColumn("slice", F.explode(spread)).groupBy("slice", "system").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), worst.alias("worst"))


def crop_rows(lines: DataFrame, kinds: dict[str, Column], least: int) -> DataFrame:
    """(all columns, crop_type): each line under every crop type whose condition it meets, if its text is long enough."""
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in kinds.items()]))
    return lines.where(F.length(F.trim("text")) >= least).withColumn("crop_type", F.explode(tags))


def region_filter(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, region: tuple[float, float, float, float]) -> Column:
    """Whether a box's middle lies in the region (left, top, right, bottom as shares of the page, borders included)."""
    return ((x + w / 2) / width).between(region[0], region[2]) & ((y + h / 2) / height).between(region[1], region[3])
