"""Column helpers used by several training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.runtime import read_table

#: Spellings of "not known" in metadata, after trimming and lower-casing.
PLACEHOLDERS = ("", "-", "?", "n/a", "na", "nil", "none", "null", "unknown", "not known", "अज्ञात")


def clean_key(c: Column) -> Column:
    """Outer blanks and letter case aside; null for null, empty and placeholder values."""
    v = F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
    return F.when(~v.isin(*PLACEHOLDERS), v)


def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spelling, split): which of the three splits each spelling means. Size: spellings of split_target."""
    t = read_table(spark, sf_dir, "split_target")
    return t.select(F.explode("spellings").alias("spelling"), F.col("split").alias("canonical_split")).distinct()


def with_split(df: DataFrame, names: DataFrame, column: str = "split") -> DataFrame:
    """``df`` with canonical_split (null where the spelling is not listed).

    ``names`` is the small fixed spelling table; the size guard is Spark's own
    broadcast threshold, so no hint is given.
    """
    return df.join(names.withColumnRenamed("spelling", "_spelling"), F.trim(df[column]) == F.col("_spelling"), "left").drop("_spelling")
