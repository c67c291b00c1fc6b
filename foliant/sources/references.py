"""References of documents: JSON payloads, texts and layout annotations, as typed columns."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from foliant.operators.scoring import CELLS, FIGURES

REFERENCE = f"text string, markdown string, reading_order array<string>, tables array<struct<cells:{CELLS}, grid:array<array<string>>>>, figures {FIGURES}"


def parse_references(df: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(references, errors: key and code) of JSON payloads, typed by REFERENCE.

    A table given as a grid becomes cells with spans of one; missing spans are one. Payloads that are no
    objects, have negative places, or hold none of the fields are errors.
    """
    got = df.select(key, F.from_json(payload, REFERENCE + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    one = lambda c, n: F.coalesce(c[n], F.lit(1))
    sound = lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), one(c, "rowspan").alias("rowspan"), one(c, "colspan").alias("colspan"), F.coalesce(c["text"], F.lit("")).alias("text"))
    from_grid = lambda g: F.flatten(F.transform(g, lambda row, i: F.transform(row, lambda v, j: F.struct(i.cast("int").alias("row"), j.cast("int").alias("col"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.coalesce(v, F.lit("")).alias("text")))))
    tables = F.transform("r.tables", lambda t: F.when(t["cells"].isNotNull(), F.transform(t["cells"], sound)).otherwise(from_grid(t["grid"])))
    cols = got.select(key, "r.text", "r.markdown", "r.reading_order", tables.alias("tables"), "r.figures", F.col("r._corrupt").alias("_corrupt"), F.col("r").isNull().alias("_null"))
    empty = F.coalesce("text", "markdown").isNull() & F.coalesce(F.size("reading_order") <= 0, F.lit(True)) & F.coalesce(F.size("tables") <= 0, F.lit(True)) & F.coalesce(F.size("figures") <= 0, F.lit(True))
    negative = F.exists(F.flatten(F.coalesce("tables", F.array().cast(f"array<{CELLS}>"))), lambda c: (c["row"] < 0) | (c["col"] < 0) | (c["rowspan"] < 1) | (c["colspan"] < 1))
    bad = F.when(F.col("_corrupt").isNotNull() | F.col("_null"), "no_object").when(empty, "no_field").when(negative, "place")
    marked = cols.withColumn("_code", bad)
    return marked.where("_code is null").drop("_code", "_corrupt", "_null"), marked.where("_code is not null").select(key, F.col("_code").alias("code"))


def read_reference_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, kind, payload) of the JSON, text and Markdown files below a folder; one row a file."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{json,txt,md}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", F.regexp_extract(name, r"^(.*?)(\.reference)?\.[^.]+$", 1).alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("kind"), "payload")


def find_references(entries: DataFrame, key: str, stem: str, files: DataFrame, explicit: str | None = None) -> DataFrame:
    """(key, kind, payload): an entry's reference by its explicit path, else the file of its stem, JSON before Markdown before text.

    Two joins and one aggregation; no path is probed for each entry.
    """
    rank = F.when(F.col("kind") == "json", 0).when(F.col("kind") == "md", 1).otherwise(2)
    by_stem = files.groupBy("stem").agg(F.min_by(F.struct("kind", "payload"), F.struct(rank.alias("a"), F.col("path").alias("b"))).alias("_s"))
    got = entries.select(key, F.col(stem).alias("stem"), *([F.col(explicit).alias("path")] if explicit else [])).join(by_stem, "stem", "left")
    if explicit:
        own = files.select("path", F.struct("kind", "payload").alias("_e"))
        got = got.join(own, "path", "left").withColumn("_s", F.coalesce("_e", "_s"))
    return got.select(key, "_s.kind", "_s.payload")


LAYOUT = "array<struct<category_type:string,order:int,ignore:boolean,text:string,html:string>>"


def layout_references(df: DataFrame, key: str, layout: str) -> DataFrame:
    """(key, text, tables_html, categories) of layout annotations: items in their order, ignored ones left out, tables apart."""
    kept = F.filter(F.from_json(layout, LAYOUT), lambda d: ~F.coalesce(d["ignore"], F.lit(False)) & (d["category_type"] != "abandon"))
    ordered = F.array_sort(F.transform(kept, lambda d, i: F.struct(F.coalesce(d["order"], F.lit(1 << 30)).alias("a"), i.alias("b"), d.alias("d"))))
    items = F.transform(ordered, lambda x: x["d"])
    said = F.filter(F.transform(F.filter(items, lambda d: d["html"].isNull()), lambda d: F.trim(d["text"])), lambda t: t != "")
    return df.select(key, F.array_join(said, "\n\n").alias("text"), F.filter(F.transform(items, lambda d: d["html"]), lambda h: h.isNotNull()).alias("tables_html"), F.array_sort(F.array_distinct(F.transform(items, lambda d: d["category_type"]))).alias("categories"))


def _texts(node, path: str) -> Iterator[tuple[str, str]]:
    """(path, text) of the text leaves of a nested JSON value; blocks below one verse marker carry its name."""
    if isinstance(node, str):
        if node.strip():
            yield path, node
    elif isinstance(node, list):
        for x in node:
            yield from _texts(x, path)
    elif isinstance(node, dict):
        own = "/".join(str(node[k]) for k in ("type", "subtype", "marker", "number") if node.get(k) not in (None, ""))
        below = f"{path}/{own}" if own else path
        for k, x in node.items():
            if k not in ("type", "subtype", "marker", "number"):
                yield from _texts(x, below)


class JsonTexts:
    """The text leaves of a JSON document, for a table function."""

    def eval(self, value: str):
        try:
            found = json.loads(value or "null")
        except ValueError:
            return
        yield from _texts(found, "")


def register(spark: SparkSession) -> None:
    """Table functions for SQL: json_texts(json)."""
    spark.udtf.register("json_texts", udtf(JsonTexts, returnType="path string, text string"))


def text_source(df: DataFrame, text: str, *, dataset: str, split: str, language: str, script: str, least: int = 1, required: str | None = None, row_id: str | None = None) -> DataFrame:
    """Rows of a text source in the form of the synthesis corpus: markup stripped, slashes and runs of blanks to one space,
    at least ``least`` visible characters, of which ``required`` (a character class) must be among; one row for each text."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), "/", " "), r"\s+", " "))
    rows = df.select((F.col(row_id).cast("string") if row_id else F.lit(None).cast("string")).alias("source_row_id"), clean.alias("text"))
    rows = rows.where(F.length(F.regexp_replace("text", r"\s", "")) >= least)
    if required:
        rows = rows.where(F.col("text").rlike(required))
    digest = F.sha2("text", 256)
    one = rows.groupBy("text").agg(F.min("source_row_id").alias("source_row_id"))
    return one.select(F.concat_ws("-", F.lit(dataset), F.substring(digest, 1, 16)).alias("sample_id"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.lit(language).alias("language"), F.lit(script).alias("script"), "text", digest.alias("text_sha256"), "source_row_id")
