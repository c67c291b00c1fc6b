"""Review queues, batches, corrections and rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.corpus import rank_within


def reasons(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold, in order; a null test does not hold."""
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))


def issues(df: DataFrame, key: list[str], tests: dict[str, Column]) -> DataFrame:
    """(key, code) for each test that holds: the form of all constraint audits."""
    return df.select(*key, F.explode(reasons(tests)).alias("code"))


def batches(df: DataFrame, group: list[str], order: list[str], size: int, reviewers: list[str]) -> DataFrame:
    """batch_no of fixed size within each group, and the reviewer of each batch in turn."""
    names = F.array(*[F.lit(r) for r in reviewers])
    ranked = rank_within(df, group, order).withColumn("batch_no", F.ceil(F.col("rank") / size).cast("long")).drop("rank")
    return ranked.withColumn("reviewer", F.element_at(names, ((F.col("batch_no") - 1) % len(reviewers) + 1).cast("int")))


def apply_corrections(lines: DataFrame, reviews: DataFrame, key: list[str], accepted: tuple[str, ...] = ("accept", "corrected")) -> tuple[DataFrame, DataFrame]:
    """(lines with text corrected, errors: key and code).

    A target with several accepted reviews, or an empty correction, is an error
    and leaves the line as it was.
    """
    taken = reviews.where(F.col("review_status").isin(*accepted))
    per = taken.groupBy(*key).agg(F.count("*").alias("n"), F.max("corrected_text").alias("corrected_text"))
    bad = {"duplicate_target": F.col("n") > 1, "empty_correction": F.coalesce(F.trim("corrected_text"), F.lit("")) == ""}
    sound = per.where(F.size(reasons(bad)) == 0)
    done = lines.join(sound.drop("n"), key, "left").withColumn("is_corrected", F.col("corrected_text").isNotNull()).withColumn("text", F.coalesce("corrected_text", "text")).drop("corrected_text")
    return done, issues(per, key, bad)


def merge_batches(source: DataFrame, decided: DataFrame, key: list[str]) -> DataFrame:
    """(key, status): ready, missing, unknown or duplicate of every key on either side."""
    n = decided.groupBy(*key).agg(F.count("*").alias("n"))
    status = F.when(F.col("_known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("ready")
    return source.select(*key).distinct().withColumn("_known", F.lit(True)).join(n, key, "full_outer").select(*key, status.alias("status"))


def pair_profile(pairs: DataFrame, noisy: str, clean: str) -> DataFrame:
    """(noisy, clean, support, n_clean, conflict): a noisy text with several clean ones conflicts."""
    per = pairs.where(f"{noisy} is not null and {clean} is not null").groupBy(noisy, clean).agg(F.count("*").alias("support"))
    n = per.groupBy(noisy).agg(F.count("*").alias("n_clean"))
    return per.join(n, noisy).withColumn("conflict", F.col("n_clean") > 1)


def apply_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered literal replacements of whole blank-parted tokens, each on the output of the one before."""
    def one(c: Column, rule: tuple[str, str]) -> Column:
        return F.array_join(F.transform(F.split(c, " "), lambda t: F.when(t == rule[0], F.lit(rule[1])).otherwise(t)), " ")

    return reduce(one, rules, text)
