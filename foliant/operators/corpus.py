"""Dataset manifests: slices, filters, merging, splitting, rebalancing, leakage, digests."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliant.runtime import materialize

#: Metadata keys whose value is one slice.
SLICE_KEYS = ("slice", "script", "document_type", "degradation", "language", "input_format")


def entry_slices(metadata: Column, keys: tuple[str, ...] = SLICE_KEYS) -> Column:
    """Sorted distinct slices of an entry's metadata; blanks are none."""
    values = F.array_compact(F.array(*[F.nullif(F.trim(metadata[k]), F.lit("")) for k in keys]))
    return F.array_sort(F.array_distinct(values))


def filter_entries(df: DataFrame, slices: Column, *, all_of: list[str] = (), document_types: list[str] = (), degradations: list[str] = (), sample_ids: list[str] = ()) -> DataFrame:
    """Entries that meet every given condition: all slices held, types and degradations listed."""
    tests = [F.array_contains(slices, s) for s in all_of]
    meta = F.col("metadata")
    tests += [meta["document_type"].isin(*document_types)] if document_types else []
    tests += [meta["degradation"].isin(*degradations)] if degradations else []
    tests += [F.col("sample_id").isin(*sample_ids)] if sample_ids else []
    return df.where(reduce(Column.__and__, tests)) if tests else df


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    """(key, n) of the values held more than once; nulls are none."""
    return df.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def keep_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key. An aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def merge(parts: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """(union of the parts by name, keys that occur more than once)."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union, duplicates(union, F.col(key))


def shared_values(df: DataFrame, is_train: Column, keys: dict[str, str]) -> DataFrame:
    """(name, n): distinct non-empty values of each key that train and the other rows share. One scan, one aggregation, combined before its shuffle."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for n, c in keys.items()])
    long = df.select(F.when(is_train, 1).otherwise(2).alias("side"), F.explode(pairs).alias("p")).select("side", "p.*").where("value is not null and value <> ''")
    both = long.groupBy("name", "value").agg(F.bit_or("side").alias("sides"))
    found = both.groupBy("name").agg(F.count_if(F.col("sides") == 3).alias("n"))
    names = df.sparkSession.createDataFrame([(n,) for n in keys], "name string")
    return names.join(F.broadcast(found), "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))  # one row a key


def overlap(train: DataFrame, held: DataFrame, keys: dict[str, str]) -> DataFrame:
    """:func:`shared_values` of two tables that hold the keys' columns."""
    columns = list(dict.fromkeys(keys.values()))
    both = train.select(*columns, F.lit(True).alias("_is_train")).unionByName(held.select(*columns, F.lit(False).alias("_is_train")))
    return shared_values(both, F.col("_is_train"), keys)


def hash_rank(key: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)


def hash_split(df: DataFrame, key: str, ratio: float, salt: str = "split") -> DataFrame:
    """is_held: the key's hash falls into the first ``ratio`` of all hashes.

    A threshold on the hash needs no sort and gives a row the same side in every
    partitioning of the data; the share held is ``ratio`` in expectation.
    """
    bound = format(int(ratio * 16**8), "08x")
    return df.withColumn("is_held", F.substring(hash_rank(F.col(key), salt), 1, 8) < bound)


def rank_within(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with rank, from 1 within each group, however large one group is.

    Rows are range-partitioned by group and order and written, so that borders
    stay; counts of the parts before (groups x partitions rows) are added to the
    rank inside a part. ``order`` must tell the rows of a group apart.
    """
    placed = materialize(df.repartitionByRange(*by, *order).withColumn("_pid", F.spark_partition_id()), "rank")
    before = W.partitionBy(*by).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy(*by, "_pid").agg(F.count("*").alias("_n")).select(*by, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = placed.withColumn("_rank", F.row_number().over(W.partitionBy(*by, "_pid").orderBy(*order)))
    same = reduce(Column.__and__, [inside[c].eqNullSafe(parts[c]) for c in [*by, "_pid"]])
    return inside.join(parts, same).select(*[inside[c] for c in df.columns], (F.col("_rank") + F.col("_before")).alias("rank"))


def stratified_split(df: DataFrame, key: str, stratum: str, ratio: float, salt: str = "strata") -> DataFrame:
    """is_held: exactly max(1, round(n * ratio)) rows of each stratum, none of a stratum of one.

    Only the key, its stratum and its hash are ranked, not the rows.
    """
    ranked = rank_within(df.select(key, stratum, hash_rank(F.col(key), salt).alias("_h")), [stratum], ["_h", key])
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    take = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.bround(F.col("_n") * ratio).cast("long"))).otherwise(0)
    held = ranked.join(sizes, ranked[stratum].eqNullSafe(sizes["_s"])).select(key, (F.col("rank") <= take).alias("is_held"))
    return df.join(held.groupBy(key).agg(F.max("is_held").alias("is_held")), key)  # a key that comes twice has one side


def group_split(df: DataFrame, group: str, stratum: str, ratio: float, salt: str = "group") -> DataFrame:
    """``df`` with is_held, the same for all rows of a group; of each stratum max(1, round(n * ratio)) groups are held, none of one alone.

    A group belongs to the least of its rows' strata. Only groups are ranked, after they are combined.
    """
    groups = df.groupBy(group).agg(F.min(stratum).alias(stratum))
    return df.join(stratified_split(groups, group, stratum, ratio, salt).select(group, "is_held"), group)


def without_listed(df: DataFrame, text: str, listed: DataFrame, listed_text: str) -> DataFrame:
    """Rows whose text is on no list; hashes meet, not texts. Empty texts of the list exclude nothing."""
    out = listed.where(F.col(listed_text) != "").select(F.sha2(listed_text, 256).alias("_h")).distinct()
    return df.withColumn("_h", F.sha2(text, 256)).join(out, "_h", "left_anti").drop("_h")


def first_by_hash(df: DataFrame, by: str, fraction: float, least: int) -> DataFrame:
    """is_held for the rows whose hash comes first: max(least, ceil(n * fraction)), but never all. Ranked over range partitions."""
    n = df.count()
    held = min(n - 1, max(least, math.ceil(n * fraction)))
    ranked = rank_within(df.withColumn("_all", F.lit(0)), ["_all"], [by])
    return ranked.withColumn("is_held", F.col("rank") <= held).drop("_all", "rank")


def rebalance(df: DataFrame, key: str, stratum: str) -> DataFrame:
    """Rows of each stratum repeated until all are as large as the largest; copy_no 0 is the row itself."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n").alias("most"))  # one row
    placed = rank_within(df.select(key, stratum), [stratum], [key])
    planned = placed.join(sizes.join(largest), stratum).withColumn("copies", F.expr("most div n + case when rank <= most % n then 1 else 0 end"))
    return planned.select(key, stratum, F.explode(F.expr("sequence(0, cast(copies as int) - 1)")).alias("copy_no"))


def digest(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Order-independent digest of the rows of each group: exact sums of their hashes and their count."""
    h = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)
    parts = [F.sum(F.conv(F.substring(h, i, 8), 16, 10).cast("long")).alias(f"d{n}") for n, i in enumerate((1, 9, 17))]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *parts)
