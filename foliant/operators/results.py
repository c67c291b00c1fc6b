"""Benchmark results in long form: means, pairing, oracles, thresholds, gates and tests."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, exp, factorial
from unicodedata import normalize

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import edit_opcodes


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def long_metrics(df: DataFrame, keep: list[str], metrics: str = "metrics") -> DataFrame:
    """One row per finite metric of a row's map."""
    return df.select(*keep, F.explode(metrics).alias("metric", "value")).where(finite(F.col("value")))


def last_row_wins(df: DataFrame, keys: list[str], value: str, order: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def slice_means(long: DataFrame, system: str, slices: str) -> DataFrame:
    """Mean of each metric by system and slice, with the roll-up slice ``all``.

    A row without slices counts under ``all`` once.
    """
    spread = F.array_distinct(F.concat(F.coalesce(F.col(slices), F.array().cast("array<string>")), F.array(F.lit("all"))))
    return long.withColumn("slice", F.explode(spread)).groupBy(system, "slice", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def paired(df: DataFrame, key: str, system: str, value: str, candidate: str, baseline: str) -> DataFrame:
    """(key, candidate, baseline): values of both systems on the keys both have.

    One pivoting aggregation instead of a self-join.
    """
    side = lambda s: F.max(F.when(F.col(system) == s, F.col(value)))
    return df.where(F.col(system).isin(candidate, baseline)).groupBy(key).agg(side(candidate).alias("candidate"), side(baseline).alias("baseline")).where("candidate is not null and baseline is not null")


def outcomes(pairs: DataFrame, lower_is_better: bool, by: list[str] = ()) -> DataFrame:
    """pairs, wins, losses, ties, means and direction-aware improvements."""
    gain = (F.col("baseline") - F.col("candidate")) if lower_is_better else (F.col("candidate") - F.col("baseline"))
    got = pairs.withColumn("gain", gain).groupBy(*by).agg(
        F.count("*").alias("n_pairs"), F.count_if(F.col("gain") > 0).alias("wins"), F.count_if(F.col("gain") < 0).alias("losses"), F.count_if(F.col("gain") == 0).alias("ties"),
        F.avg("candidate").alias("candidate_mean"), F.avg("baseline").alias("baseline_mean"))
    sign = -1 if lower_is_better else 1
    absolute = sign * (F.col("candidate_mean") - F.col("baseline_mean"))
    relative = F.when(F.col("baseline_mean") != 0, absolute / F.abs("baseline_mean")).when(absolute > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return got.withColumn("absolute_improvement", absolute).withColumn("relative_improvement", relative)


def gates(result: DataFrame, *, min_pairs: int, min_absolute: float, min_win_rate: float) -> DataFrame:
    """passed, and the names of the gates that failed."""
    decided = F.col("wins") + F.col("losses")
    rate = F.when(decided > 0, F.col("wins") / decided)
    checks = {"min_pairs": F.col("n_pairs") >= min_pairs, "min_absolute": F.col("absolute_improvement") >= min_absolute, "min_win_rate": F.coalesce(rate >= min_win_rate, F.lit(False))}
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in checks.items()]))
    return result.withColumn("failed", F.array_join(failed, ",")).withColumn("passed", F.size(failed) == 0)


@F.pandas_udf(T.DoubleType())
def sign_test(wins: pd.Series, losses: pd.Series) -> pd.Series:
    """One-sided exact probability of at least so many wins; null without any decision."""
    def p(w: int, n: int):
        return sum(comb(n, i) for i in range(w, n + 1)) / 2**n if n else None

    return pd.Series([p(int(w), int(w + x)) for w, x in zip(wins, losses, strict=True)], dtype="float64")


#: Distribution function of the Poisson law of mean 1, as far as doubles tell it from 1.
_POISSON = np.cumsum([exp(-1) / factorial(i) for i in range(18)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Uniform numbers from counters (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def bootstrap_ci(df: DataFrame, key: str, value: str, replicates: int = 1000, confidence: float = 0.95) -> DataFrame:
    """(low, high) of the mean, by the Poisson bootstrap.

    Every row draws its weight for a replicate from the hash of its key, so rows
    are read once, partial sums of all replicates are combined per partition and
    the result does not depend on the partitioning.
    """
    def run(it):
        top, bottom = np.zeros(replicates), np.zeros(replicates)
        turn = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for pdf in it:
            for s in range(0, len(pdf), 1024):
                k, v = pdf["k"].to_numpy()[s : s + 1024].astype(np.uint64), pdf["v"].to_numpy()[s : s + 1024]
                w = np.searchsorted(_POISSON, _mixed(k[:, None] + turn)).astype(np.float64)
                top += v @ w
                bottom += w.sum(0)
        yield pd.DataFrame({"replicate": np.arange(replicates), "top": top, "bottom": bottom})

    parts = df.where(F.col(value).isNotNull()).select(F.xxhash64(key).alias("k"), F.col(value).cast("double").alias("v")).mapInPandas(run, "replicate int, top double, bottom double")
    means = parts.groupBy("replicate").agg((F.sum("top") / F.nullif(F.sum("bottom"), F.lit(0.0))).alias("mean"))
    tail = (1 - confidence) / 2
    return means.agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))


def best_system(df: DataFrame, key: str, system: str, value: str, quality: str, latency: str, lower_is_better: bool = True) -> DataFrame:
    """The best system of each key: by value, then higher quality, lower latency, first name. One aggregation."""
    order = F.struct((F.col(value) if lower_is_better else -F.col(value)).alias("a"), (-F.col(quality)).alias("b"), F.col(latency).alias("c"), F.col(system).alias("d"))
    return df.groupBy(key).agg(F.min_by(F.struct(system, value), order).alias("_b")).select(key, "_b.*")


def threshold_means(pairs: DataFrame, signal: str, low: float, high: float, step: float) -> DataFrame:
    """(threshold, picks, mean) when the candidate is taken where its signal exceeds the threshold.

    The grid is an array of fixed length exploded in place, no join.
    """
    n = int(round((high - low) / step))
    grid = F.array(*[F.lit(round(low + i * step, 10)) for i in range(n + 1)])
    took = F.col(signal) > F.col("threshold")
    return pairs.withColumn("threshold", F.explode(grid)).groupBy("threshold").agg(
        F.count_if(took).alias("picks"), F.avg(F.when(took, F.col("candidate")).otherwise(F.col("baseline"))).alias("mean"))


def top_failures(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n worst rows; a top-k, so nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)


def confusions(pages: DataFrame, key: str, prediction: str, reference: str, limit: int) -> DataFrame:
    """(a, b, n): the most frequent edits from prediction to reference, counted by page in Python, then combined.

    Ties keep the order in which they are seen, by key and place.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            seen: dict[tuple[str, str], list] = {}
            for k, p, r in zip(pdf["k"].tolist(), pdf["p"], pdf["r"], strict=True):
                for place, (a, b) in enumerate(edit_opcodes(normalize("NFC", p), normalize("NFC", r))):
                    got = seen.setdefault((a or "<eps>", b or "<eps>"), [0, k, place])
                    got[0] += 1
                    if (k, place) < (got[1], got[2]):
                        got[1:] = k, place
            yield pd.DataFrame([(*ab, *v) for ab, v in seen.items()], columns=["a", "b", "n", "k", "place"])

    each = pages.select(F.col(key).alias("k"), F.col(prediction).alias("p"), F.col(reference).alias("r")).mapInPandas(run, f"a string, b string, n long, k {kind}, place long")
    counted = each.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min(F.struct("k", "place")).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(limit).drop("first")
