"""Choosing between systems, and checks on what they gave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def route(candidate: Column, fallback: Column, signal: Column, threshold: float, guard: Column | None = None) -> Column:
    """The candidate where its signal exceeds the threshold and the guard, if given, holds; null signals fall back."""
    test = F.coalesce(signal > threshold, F.lit(False))
    if guard is not None:
        test = test & F.coalesce(guard, F.lit(False))
    return F.when(test, candidate).otherwise(fallback)


def best_of(options: list[tuple[Column, Column]]) -> Column:
    """The value of the highest score; the first wins ties, null scores lose."""
    def pick(best, option):
        value, score = option
        better = F.coalesce(score > best[1], score.isNotNull() & best[1].isNull())
        return F.when(better, value).otherwise(best[0]), F.when(better, score).otherwise(best[1])

    return reduce(pick, options[1:], options[0])[0]


def complete_keys(df: DataFrame, key: str, system: str, systems: list[str]) -> DataFrame:
    """Keys on which every system is present."""
    return df.where(F.col(system).isin(systems)).groupBy(key).agg(F.countDistinct(system).alias("n")).where(F.col("n") == len(systems)).select(key)


def conflicts(df: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose values differ by more than the tolerance, with their range and count."""
    got = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return got.where(F.col("high") - F.col("low") > tolerance)


def blocked(df: DataFrame, text: str, block: DataFrame, block_text: str, by: list[str]) -> DataFrame:
    """Rows per group whose text is on the blocklist, by hash: the longer text is hashed before the shuffle."""
    listed = block.where(F.col(block_text).isNotNull() & (F.col(block_text) != "")).select(F.sha2(block_text, 256).alias("_h")).distinct()
    rows = df.where(F.col(text).isNotNull()).select(*by, F.sha2(text, 256).alias("_h"))
    return rows.join(listed, "_h", "left_semi").groupBy(*by).agg(F.count("*").alias("n"))


def block_rank(text: Column, y: Column, page_height: Column) -> Column:
    """0 for page markers, 1 for lines that begin with a digit in the lowest fifth, 2 for others."""
    marker = text.rlike(r"^\s*[0-9\x{0966}-\x{096F}]{1,3}\s*$")
    low = (y >= 0.8 * page_height) & text.rlike(r"^\s*[0-9\x{0966}-\x{096F}]")
    return F.when(marker, 0).when(low, 1).otherwise(2)


def noise_pairs(df: DataFrame, key: str, text: str, rate: int = 24) -> DataFrame:
    """(key, noisy, clean): every ``rate``-th character, from a place told by the hash, is dropped, blanked or doubled.

    Each row depends on its own key only, so it is the same in any partitioning.
    """
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(rate)).cast("int")
    kind = F.pmod(F.xxhash64(F.col(key), F.lit("kind")), F.lit(3))
    changed = F.transform(F.split(F.col(text), ""), lambda c, i: F.when(i % rate == at, F.when(kind == 0, F.lit("")).when(kind == 1, F.lit(" ")).otherwise(F.concat(c, c))).otherwise(c))
    return df.where(F.col(text).isNotNull()).select(key, F.array_join(changed, "").alias("noisy"), F.col(text).alias("clean"))


def bucket_top_up(df: DataFrame, key: str, buckets: dict[str, Column], least: int) -> DataFrame:
    """(bucket, key, copy_no): rows of each bucket repeated until it has ``least``; a row may be in several buckets."""
    tagged = df.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in buckets.items()]))).alias("bucket"))
    sizes = tagged.groupBy("bucket").agg(F.count("*").alias("n"))
    rounds = F.greatest(F.lit(1), F.ceil(F.lit(least) / F.col("n"))).cast("int")
    return tagged.join(sizes.withColumn("rounds", rounds).drop("n"), "bucket").select("bucket", key, F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("copy_no"))
