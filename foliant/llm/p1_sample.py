"""Problem 1: samples whose category shares follow given targets.

Method: systematic unequal-probability sampling. Units are ordered at random
within sorted categories, inclusion probabilities are prefix-summed across
range partitions, and the units at which the sum (from one random start per
dataset) crosses an integer are selected; floors are then repaired.

Defined results: rows with a null sample_id or dataset are no units; a null or
blank category is untyped, counts for the dataset's size and is never drawn;
rows sent again under one sample_id are one unit per category. An empty input
gives an empty sample and, in the report, a supply of 0 for every request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliant.runtime import materialize, read_table

UNIT = 1 << 30  # inclusion probabilities are integers of this unit, so that sums are exact


def category(c: Column) -> Column:
    v = F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
    return F.when(v != "", v)


def fill(wanted: list[float], floors: list[float], supplies: list[float]) -> list[float]:
    """Sizes that sum to the wanted total, as far as the supplies reach, in the wanted proportions between floor and supply.

    One factor for all: what short categories lack and floors add is spread over the others in proportion.
    """
    low = [min(f, s) for f, s in zip(floors, supplies, strict=True)]
    total = min(max(sum(wanted), sum(low)), sum(supplies))
    at = lambda x: [min(max(x * w, a), s) for w, a, s in zip(wanted, low, supplies, strict=True)]
    if sum(at(1e9)) < total:  # categories without a target are not raised above their floor
        return at(1e9)
    a, b = 0.0, 1e9
    for _ in range(200):
        m = (a + b) / 2
        a, b = (m, b) if sum(at(m)) < total else (a, m)
    return at(b)


def sample_to_targets(frame: DataFrame, request: DataFrame, seed: int = 17, keep_size: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    keep_size: what short categories lack and floors add is spread over the others of the dataset,
    so that the sample has its planned size and the others keep their proportions; else each category
    is drawn to its own demand.

    frame: dataset, sample_id, category (nullable), possibly repeated.
    request: dataset, category, target_share, min_rows, sample_fraction; small, one row per category.
    sample: dataset, sample_id, category. report: one row per request with
    supply, demand, drawn and short (supply < demand).
    """
    units = (
        frame.where("dataset is not null and sample_id is not null")
        .groupBy("dataset", "sample_id")
        .agg(F.collect_set("category").alias("categories"))  # at most as many as one sample was sent in
    )
    # one pass counts the dataset (rows of the empty grouping key) and its categories
    counted = units.select("dataset", F.explode(F.concat(F.array(F.lit("")), "categories")).alias("category"))
    counts = counted.groupBy("dataset", "category").count()
    sizes = counts.where("category = ''").select("dataset", F.col("count").alias("n_dataset"))
    supply = counts.where("category <> ''").withColumnRenamed("count", "supply")
    plan = (
        request.join(sizes, "dataset", "left").join(supply, ["dataset", "category"], "left").fillna(0, ["n_dataset", "supply"])
        .withColumn("demand", F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.col("sample_fraction") * F.col("n_dataset")))
        .withColumn("w", F.when(F.col("supply") > 0, F.round(F.least(F.lit(1.0), F.col("demand") / F.col("supply")) * UNIT).cast("long")).otherwise(F.lit(0)))
    )
    if keep_size:
        rows = plan.collect()  # as small as the request
        held: dict[str, list] = {}
        for r in rows:
            held.setdefault(r["dataset"], []).append(r)
        sizes_of = {}
        for d, rs in held.items():
            base = [(r["target_share"] or 0.0) * (r["sample_fraction"] or 0.0) * r["n_dataset"] for r in rs]
            for r, size in zip(rs, fill(base, [float(r["min_rows"] or 0) for r in rs], [float(r["supply"]) for r in rs]), strict=True):
                sizes_of[d, r["category"]] = round(size / r["supply"] * UNIT) if r["supply"] else 0
        plan = frame.sparkSession.createDataFrame([(*r[:-1], sizes_of[r["dataset"], r["category"]]) for r in rows], plan.schema)
    plan = F.broadcast(materialize(plan, "p1-plan"))  # as small as the request
    u = F.xxhash64(F.lit(seed), "dataset", "category", "sample_id")
    drawn_from = (
        units.select("dataset", "sample_id", F.explode("categories").alias("category"))
        .join(plan.select("dataset", "category", "w").where("w > 0"), ["dataset", "category"])
        .withColumn("u", u)
        .repartitionByRange("dataset", "category", "u", "sample_id")
        .withColumn("pid", F.spark_partition_id())
    )
    drawn_from = materialize(drawn_from, "p1-order")  # range borders must not move between the two passes
    before = W.partitionBy("dataset").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    start = F.pmod(F.xxhash64(F.lit(seed), "dataset"), F.lit(UNIT))
    # partitions x datasets rows
    offsets = drawn_from.groupBy("dataset", "pid").agg(F.sum("w").alias("part")).select(
        "dataset", "pid", (F.coalesce(F.sum("part").over(before), F.lit(0)) + start).alias("offset"))
    inside = W.partitionBy("dataset", "pid").orderBy("category", "u", "sample_id").rowsBetween(W.unboundedPreceding, 0)
    marked = (
        drawn_from.withColumn("upto", F.sum("w").over(inside)).join(offsets, ["dataset", "pid"])
        .withColumn("upto", F.col("upto") + F.col("offset"))
        .withColumn("hit", F.expr(f"upto div {UNIT} > (upto - w) div {UNIT}"))
    )
    marked = materialize(marked.select("dataset", "category", "sample_id", "u", "hit"), "p1-marked")
    per = marked.groupBy("dataset", "category").agg(
        F.count_if("hit").alias("drawn"), F.min(F.when(~F.col("hit"), F.struct("u", "sample_id"))).alias("next"))
    report = plan.join(per, ["dataset", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    # a crossing count is floor or ceil of the expected size, so a floor lacks at most one unit (rounding of w)
    lacking = report.where("next is not null and drawn < least(min_rows, supply)").select(
        "dataset", F.col("next.sample_id").alias("sample_id"), "category")
    sample = marked.where("hit").select("dataset", "sample_id", "category").unionByName(lacking)
    report = report.select(
        "dataset", "category", "target_share", "min_rows", "sample_fraction", "n_dataset", "supply", "demand",
        (F.col("drawn") + F.when(F.expr("next is not null and drawn < least(min_rows, supply)"), 1).otherwise(0)).alias("drawn"),
        (F.col("supply") < F.col("demand")).alias("short"))
    return sample, report


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = read_table(spark, sf_dir, "manifest")
    frame = m.select("dataset", "sample_id", category(F.col("metadata")["document_type"]).alias("category"))
    request = read_table(spark, sf_dir, "sample_request").withColumnRenamed("document_type", "category")
    return sample_to_targets(frame, request, keep_size=True)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose supply falls short, from the report of the drawn sample."""
    _, report = _run(spark, sf_dir)
    return report.where("short").select("dataset", F.col("category").alias("document_type"))


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, _ = _run(spark, sf_dir)
    return sample.select("dataset", "sample_id", F.col("category").alias("document_type"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target against drawn share of each category, the gap between them and its cause.

    cause: supply (all of it is drawn), floor (min_rows is more than the share), others (what other
    categories of the dataset lack or have by their floors is spread over this one); null for a gap of up to 0.005.
    """
    _, report = _run(spark, sf_dir)
    total = W.partitionBy("dataset")  # at most the categories of one request
    got = report.select(
        "dataset", F.col("category").alias("document_type"), "target_share", "min_rows", "supply", "demand", "drawn",
        (F.col("drawn") / F.nullif(F.sum("drawn").over(total), F.lit(0))).alias("drawn_share"), "short")
    gap = F.col("drawn_share") - F.col("target_share")
    cause = F.when(F.abs(gap) <= 0.005, None).when(F.col("drawn") >= F.col("supply"), "supply").when(F.col("drawn") <= F.col("min_rows"), "floor").otherwise("others")
    return got.withColumn("share_gap", gap).withColumn("cause", cause)
