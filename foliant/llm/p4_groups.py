"""Problem 4: splits that keep related records together.

Method: connected components by alternating large-star and small-star over the
links between records and the author, source and entity they name; the hash of
the component then falls into proportional split ranges.

Records are first contracted to the distinct pairs of values they hold (a hot
value is then one node, however many records name it), so no record group is
ever gathered. Defined results: null, empty and placeholder values link
nothing; a record without any value is a component of its own; repeated rows
are kept; an empty table gives empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import clean_key, split_names, with_split
from foliant.runtime import drop_materialized, materialize, read_table

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    e = _both(edges)
    least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return e.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    pairs = edges.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
    return pairs.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component is its least node.

    edges: u, v of one comparable type. Direction and repetition do not matter.
    Joins on a hot node are split by AQE; minima are combined map-side.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc")
    mark = None
    for _ in range(MAX_ROUNDS):
        after = materialize(_small_star(_large_star(now)), "cc")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_materialized(now)
        now = after
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not converge within {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def group_records(df: DataFrame, record: str, keys: dict[str, Column], across: bool = False) -> DataFrame:
    """(record, component) with component null for a record without any value.

    keys: name -> cleaned value (null links nothing). across: a value is one node in whichever
    field it stands; else equal values of different fields are different things.
    """
    tagged = [k if across else F.when(k.isNotNull(), F.concat(F.lit(f"{n}:"), k)) for n, k in keys.items()]
    held = df.select(F.col(record).alias("record"), *[t.alias(f"k{i}") for i, t in enumerate(tagged)])
    names = [f"k{i}" for i in range(len(keys))]
    first = F.coalesce(*names)
    pairs = held.select(F.explode(F.array(*[F.struct(first.alias("u"), F.col(n).alias("v")) for n in names])).alias("p"))
    found = connected_components(pairs.select("p.u", "p.v").where("u is not null and v is not null"))
    node = held.select("record", first.alias("node"))
    linked = node.where("node is not null").join(found, "node", "left").select("record", F.coalesce("component", "node").alias("component"))
    # records without any value never meet in one key of the join
    return linked.unionByName(node.where("node is null").select("record", F.lit(None).cast("string").alias("component")))


def assign_splits(grouped: DataFrame, shares: list[tuple[str, float]], salt: int = 4) -> DataFrame:
    """``grouped`` with split: the hash of the component (of the record itself
    where there is none) falls into one of the ranges proportional to shares."""
    h = F.pmod(F.xxhash64(F.lit(salt), F.coalesce(F.col("component"), F.concat(F.lit("record:"), F.col("record").cast("string")))), F.lit(1 << 40)) / float(1 << 40)
    total, upto, out = sum(s for _, s in shares), 0.0, []
    for name, share in shares:
        upto += share / total
        out.append((upto, name))
    chosen = reduce(lambda rest, x: F.when(h < x[0], x[1]).otherwise(rest), reversed(out[:-1]), F.lit(out[-1][1]))
    return grouped.withColumn("split", chosen)


def _grouped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = read_table(spark, sf_dir, "manifest")
    keys = {k: clean_key(F.col("metadata")[k]) for k in ("author", "source_document", "entity")}
    # entities stand in the author's field and authors in the entity's, each under its own id
    return m, group_records(m, "row_id", keys, across=True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked groups that lie in more than one split as the table stands."""
    m, grouped = _grouped(spark, sf_dir)
    held = with_split(m.select(F.col("row_id").alias("record"), "split"), split_names(spark, sf_dir))
    per = (
        grouped.where("component is not null").join(held, "record")
        .groupBy("component").agg(F.min("record").alias("group_row_id"), F.collect_set("canonical_split").alias("splits"))
    )
    return per.where(F.size("splits") > 1).select("group_row_id", F.explode("splits").alias("split"))


def p4_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new split of every manifest row."""
    _, grouped = _grouped(spark, sf_dir)
    shares = [(r["split"], r["share"]) for r in read_table(spark, sf_dir, "split_target").orderBy("split").collect()]
    return assign_splits(grouped, shares).select(F.col("record").alias("row_id"), "component", "split")
