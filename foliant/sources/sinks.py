"""Writers: manifests, label files, documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_labels(df: DataFrame, path: str, image: str = "image_path", text: str = "text") -> None:
    """image<TAB>text lines with blanks collapsed; a path with a tab or line end is an error."""
    line = F.when(F.col(image).rlike("[\t\n]"), F.raise_error(F.concat(F.lit("path holds a tab or line end: "), F.col(image)))).otherwise(
        F.concat_ws("\t", F.col(image), F.regexp_replace(F.trim(F.col(text)), r"\s+", " ")))
    df.select(line.alias("value")).write.mode("errorifexists").text(path)


def page_markdown(blocks: Column) -> Column:
    """Markdown of array<struct<order, block_type, text>>: titles as headings, parted by blank lines."""
    shown = F.filter(F.array_sort(blocks), lambda b: F.trim(b["text"]) != "")
    return F.concat(F.array_join(F.transform(shown, lambda b: F.when(b["block_type"] == "title", F.concat(F.lit("# "), b["text"])).otherwise(b["text"])), "\n\n"), F.lit("\n"))


def write_corpus(df: DataFrame, path: str, by: list[str]) -> None:
    """Partitioned Parquet; rows of a partition are spread over the writers that hold them."""
    df.write.mode("errorifexists").partitionBy(*by).option("compression", "zstd").parquet(path)


def write_documents(documents: DataFrame, path: str, key: str) -> None:
    """Nested documents as Parquet, their Markdown and body as text beside it, each in its own folder."""
    documents.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/documents")
    for c in ("markdown", "body"):
        if c in documents.columns:
            documents.select(F.col(key).cast("string").alias("key"), F.col(c).alias("value")).where("value is not null").write.mode("errorifexists").partitionBy("key").text(f"{path}/{c}")


def report_markdown(rows: DataFrame, title: str, by: list[str], values: list[str]) -> DataFrame:
    """One text: a Markdown table of a small report, sorted by its keys. A report is bounded by its groups."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in [*by, *values]]), F.lit(" |"))
    head = f"# {title}\n\n| {' | '.join([*by, *values])} |\n|{' --- |' * (len(by) + len(values))}\n"
    keyed = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], line.alias("line"))
    return rows.agg(F.array_sort(F.collect_list(keyed)).alias("l")).select(F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("value"))


def write_book(pages: DataFrame, path: str, book: str, page: str, text: str) -> None:
    """The text of each book, pages in order and parted by form feeds. Pages are sorted within the book's task, not gathered."""
    ordered = pages.repartition(book).sortWithinPartitions(book, page)
    ordered.select(F.col(book).cast("string").alias("book"), F.concat(F.coalesce(text, F.lit("")), F.lit("\f")).alias("value")).write.mode("errorifexists").partitionBy("book").text(path)


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Evaluation rows as delimited text with a header; nested columns as JSON."""
    flat = [F.to_json(F.col(c)).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("errorifexists").option("header", "true").option("sep", sep).csv(path)


def publish(parts: dict[str, DataFrame], path: str) -> DataFrame:
    """Write tables under one folder and, last, the packet: part, number of rows and order-independent digest.

    A folder without its packet is incomplete; :func:`verify` tells whether the tables are still those that were published.
    """
    spark = next(iter(parts.values())).sparkSession
    for name, df in parts.items():
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{name}")
    packet = _packet(spark, list(parts), path)
    packet.coalesce(1).write.mode("errorifexists").json(f"{path}/_packet")
    return packet


def _packet(spark, names: list[str], path: str) -> DataFrame:
    def one(name: str) -> DataFrame:
        df = spark.read.parquet(f"{path}/{name}")
        rows = F.xxhash64(F.to_json(F.struct(*df.columns)))  # of equal rows, and only of those, equal
        return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(rows.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")).select(F.lit(name).alias("part"), "n", "digest")

    return reduce(DataFrame.unionByName, [one(n) for n in names])


def verify(spark, path: str) -> DataFrame:
    """(part, status): ok or changed for each part of a published folder; raises where the packet is missing."""
    told = spark.read.json(f"{path}/_packet", schema="part string, n long, digest string")
    names = [r["part"] for r in told.select("part").collect()]  # as many as were published together
    now = _packet(spark, names, path).select("part", F.col("n").alias("_n"), F.col("digest").alias("_d"))
    same = (F.col("n") == F.col("_n")) & (F.col("digest") == F.col("_d"))
    return told.join(now, "part").select("part", F.when(same, "ok").otherwise("changed").alias("status"))
