"""Problem 9: sources mixed to target weights.

Method: entropy balancing. Of all document rates that give each source its
token target, those of least relative entropy are exponential in the
document's tokens, clipped at the source's repeat cap; distributed Newton
iterations solve the convex dual (one multiplier a source) and the rates are
rounded into copies at random, without bias.

A pass over the corpus leaves the counts of (source, tokens), which are all the
dual needs. Defined results: null and empty texts have no tokens and get one
copy at rate 1; a source without documents reaches nothing; sources not in the
targets get no copies but count in the total; with an empty table every target
is 0 tokens and none falls short.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from foliant.llm.p8_tokens import count_tokens
from foliant.runtime import materialize, read_table

MAX_STEPS = 60
CLOSE = 1e-4  # of a source's target

#: Unit of token counts in the exponent, for the step sizes only.
SCALE = 1000.0


def _rate(lam, tokens, cap):
    return F.least(cap, F.exp(F.least(lam * tokens / SCALE, F.lit(50.0))))


def solve_rates(hist: DataFrame, targets: dict[str, tuple[float, float]]) -> dict[str, float | None]:
    """Multiplier of each source (None where its cap binds for every document).

    hist: source, n_tok, n. targets: source -> (target tokens, cap); one entry a
    source, so driver work follows the number of sources only.
    """
    spark = hist.sparkSession
    capacity = {r["source"]: r["t"] * targets[r["source"]][1] for r in hist.groupBy("source").agg(F.sum(F.col("n_tok") * F.col("n")).alias("t")).collect() if r["source"] in targets}
    open_ = {s for s in capacity if capacity[s] > targets[s][0] > 0}
    lam = {s: 0.0 for s in open_}
    low, high = {s: -math.inf for s in open_}, {s: math.inf for s in open_}
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("lam", T.DoubleType()), T.StructField("cap", T.DoubleType())])
    for _ in range(MAX_STEPS):
        if not open_:
            break
        now = spark.createDataFrame([(s, lam[s], float(targets[s][1])) for s in sorted(open_)], schema)
        rate = _rate(F.col("lam"), F.col("n_tok"), F.col("cap"))
        moment = F.col("n") * F.col("n_tok") * F.col("r")
        sums = hist.join(F.broadcast(now), "source").withColumn("r", rate).groupBy("source").agg(
            F.sum(moment).alias("f"), F.sum(F.when(F.col("r") < F.col("cap"), moment * F.col("n_tok") / SCALE).otherwise(0.0)).alias("g")).collect()
        for r in sums:
            s, gap = r["source"], r["f"] - targets[r["source"]][0]
            if abs(gap) <= CLOSE * targets[s][0]:
                open_.discard(s)
                continue
            (high if gap > 0 else low)[s] = lam[s]
            step = lam[s] - gap / r["g"] if r["g"] > 0 else math.nan
            if not low[s] < step < high[s] or abs(step - lam[s]) > 8:  # keep Newton inside the bracket
                lo, hi = low[s], high[s]
                step = (lo + hi) / 2 if lo > -math.inf and hi < math.inf else (lo * 2 + 1 if hi == math.inf and lo >= 0 else lam[s] + (1 if gap < 0 else -1))
            lam[s] = step
    if open_:
        raise RuntimeError(f"no rates within {MAX_STEPS} steps for the sources {sorted(open_)}")
    return {s: lam.get(s) if capacity.get(s, 0) > targets[s][0] else None for s in targets}


def mix_to_weights(docs: DataFrame, targets: DataFrame, seed: int = 9) -> tuple[DataFrame, DataFrame]:
    """(copies, report).

    docs: id, source, n_tok. targets: source, weight, cap (small, one row a source).
    copies: id, source, n_tok, copies. report: one row per target source with
    target, capacity and actual tokens and shares, and short.
    """
    spark = docs.sparkSession
    docs = materialize(docs.select("id", "source", "n_tok"), "p9-docs")
    hist = materialize(docs.groupBy("source", "n_tok").agg(F.count("*").alias("n")), "p9-hist")
    total = hist.agg(F.coalesce(F.sum(F.col("n_tok") * F.col("n")), F.lit(0))).first()[0]
    wanted = {r["source"]: (r["weight"] * total, float(r["cap"])) for r in targets.collect()}
    lam = solve_rates(hist, wanted)
    schema = T.StructType([
        T.StructField("source", T.StringType()), T.StructField("lam", T.DoubleType()), T.StructField("cap", T.DoubleType()), T.StructField("target_tokens", T.DoubleType())])
    solved = spark.createDataFrame([(s, 0.0 if t == 0 else lam[s], cap if t > 0 else 0.0, float(t)) for s, (t, cap) in sorted(wanted.items())], schema)
    rate = F.when(F.col("lam").isNull(), F.col("cap")).otherwise(_rate(F.col("lam"), F.col("n_tok"), F.col("cap")))
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) / float(1 << 40)
    copies = (
        docs.join(F.broadcast(solved), "source").withColumn("rate", rate)  # one row a target source
        .withColumn("copies", (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))
        .select("id", "source", "n_tok", "copies")
    )
    actual = copies.groupBy("source").agg(F.sum(F.col("n_tok") * F.col("copies")).alias("actual_tokens"), F.sum("copies").alias("n_copies"))
    held = hist.groupBy("source").agg(F.sum(F.col("n_tok") * F.col("n")).alias("source_tokens"))
    report = (
        targets.join(solved.select("source", "target_tokens"), "source").join(held, "source", "left").join(actual, "source", "left")
        .fillna(0, ["source_tokens", "actual_tokens", "n_copies"])
        .withColumn("capacity_tokens", F.col("source_tokens") * F.col("cap"))
        .withColumn("short", F.col("capacity_tokens") < F.col("target_tokens"))
    )
    return copies, report


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    t = read_table(spark, sf_dir, "mix_target").select("source", F.col("target_weight").alias("weight"), F.col("max_repeats").alias("cap"))
    return mix_to_weights(count_tokens(d, "text"), t)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share."""
    return _run(spark, sf_dir)[1].where("short").select("source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    report = _run(spark, sf_dir)[1]
    whole = F.sum("actual_tokens").over(W.partitionBy(F.lit(1)))  # one row a target source
    return report.select(
        "source", "weight", "source_tokens", "capacity_tokens", "target_tokens", "actual_tokens", "n_copies",
        (F.col("actual_tokens") / F.nullif(whole, F.lit(0))).alias("actual_share"), "short")


def p9_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document enters the mixture."""
    return _run(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")
