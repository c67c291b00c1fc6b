"""Readers: manifests, tables, Markdown and HTML as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names under which labelled rows carry their image and text.
IMAGE_FIELDS = ("image", "image_path", "path", "file", "filename", "img")
TEXT_FIELDS = ("text", "label", "transcription", "ground_truth", "gt", "clean_text")

MANIFEST = "sample_id string, dataset string, split string, image_path string, text string, sha256 string, metadata map<string,string>"


class InvalidRows(ValueError):
    """Input rows that break the contract of their source."""


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped. Bad lines raise, with examples, or
    are kept in ``_corrupt`` if not strict."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    got = lines.select("value", F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    got = got.select("r.*")
    if not strict:
        return got
    bad = [r["_corrupt"] for r in got.where("_corrupt is not null").select("_corrupt").limit(5).collect()]  # examples of an error
    if bad:
        raise InvalidRows(f"{path}: not a JSON object: {bad}")
    return got.drop("_corrupt")


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV with a header, all strings, no inference."""
    return spark.read.csv(path, header=True, sep=sep, multiLine=False, escape='"')


def first_value(df: DataFrame, explicit: str | None, candidates: tuple[str, ...]) -> Column:
    """The named column, else the first of the candidates that is not blank in the row."""
    if explicit:
        return F.col(explicit)
    held = [c for c in candidates if c in df.columns]
    if not held:
        raise InvalidRows(f"none of {candidates} in {df.columns}")
    return F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.col(c)) for c in held], F.col(held[0]))


def rows_to_manifest(df: DataFrame, dataset: str, split: str, image: str | None = None, text: str | None = None) -> DataFrame:
    """Labelled rows of any columns as manifest entries; the id is the hash of image and text."""
    i, t = first_value(df, image, IMAGE_FIELDS), F.coalesce(first_value(df, text, TEXT_FIELDS), F.lit(""))
    rest = F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c).cast("string") for c in df.columns]))
    return df.select(
        F.concat_ws("-", F.lit(dataset), F.lit(split), F.substring(F.sha2(F.concat_ws("\n", i, t), 256), 1, 16)).alias("sample_id"),
        F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), i.alias("image_path"), t.alias("text"), F.lit(None).cast("string").alias("sha256"), rest.alias("metadata"))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Typed manifest with unique non-empty sample_ids; one aggregation checks both."""
    m = read_jsonl(spark, path, MANIFEST)
    bad = [r["sample_id"] for r in m.groupBy(F.trim(F.coalesce("sample_id", F.lit(""))).alias("sample_id")).count().where("count > 1 or sample_id = ''").limit(5).collect()]  # examples of an error
    if bad:
        raise InvalidRows(f"{path}: empty or repeated sample_ids: {bad}")
    return m


#: Names under which a folder may hold its rows, in the order they are looked for.
ROW_FILES = ("metadata.jsonl", "manifest.jsonl", "train.jsonl", "metadata.csv", "labels.csv", "labels.tsv", "data.parquet")


def read_local(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: jsonl (lines that are no objects raise), csv, tsv or parquet; of a folder the first of ROW_FILES, else its Parquet files."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema) if schema else spark.read.json(path, mode="FAILFAST")
    if path.endswith((".csv", ".tsv")):
        return read_csv(spark, path, "\t" if path.endswith(".tsv") else ",")
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    held = next((n for n in ROW_FILES if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(root, n))), None)
    if held:
        return read_local(spark, f"{path.rstrip('/')}/{held}", schema)
    if "." in path.rstrip("/").rsplit("/", 1)[-1]:
        raise InvalidRows(f"{path}: no reader for this suffix")
    return spark.read.parquet(path)


def prepare_dataset(rows: DataFrame, dataset: str, split: str, *, image: str | None = None, text: str | None = None, limit: int | None = None, allowed: str | None = None, slices: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(manifest, rejects: sample_id and code) of labelled rows.

    Rejected are rows without image or text and, if ``allowed`` (a character class) is given, texts with other
    characters. slices are added to the metadata. limit keeps rows by the order of their ids.
    """
    for c in (image, text):
        if c is not None and c not in rows.columns:
            raise InvalidRows(f"no column {c} in {rows.columns}")
    m = rows_to_manifest(rows, dataset, split, image, text)
    tests = {"no_image": F.trim(F.coalesce("image_path", F.lit(""))) == "", "no_text": F.trim("text") == ""}
    if allowed:
        tests["characters"] = F.regexp_replace("text", f"[{allowed}\\s]", "") != ""
    codes = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    marked = m.withColumn("_codes", codes)
    kept = marked.where(F.size("_codes") == 0).drop("_codes")
    if slices:
        kept = kept.withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, _: k != "slices"), F.create_map(F.lit("slices"), F.lit(",".join(slices)))))
    if limit is not None:
        kept = kept.orderBy("sample_id").limit(limit)
    return kept, marked.select("sample_id", F.explode("_codes").alias("code"))


def summarize_columns(df: DataFrame) -> DataFrame:
    """One row a column: type, nulls, approximate distinct values, least and greatest value as text; one aggregation."""
    parts = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count_if(F.col(c).isNull()).alias("n_null"), F.approx_count_distinct(F.col(c).cast("string")).alias("n_distinct"),
                      F.min(F.col(c).cast("string")).alias("least"), F.max(F.col(c).cast("string")).alias("greatest")) for c, t in df.dtypes]
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(suffix, n, bytes) of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    suffix = F.lower(F.regexp_extract(F.regexp_extract("path", r"([^/]*)$", 1), r"(\.[^.]+)$", 1))
    return files.groupBy(suffix.alias("suffix")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def markdown_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, kind, text) of the lines of Markdown: heading, table, separator, list, text; blank lines left out."""
    rows = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "text")).where(F.trim("text") != "")
    t = F.trim("text")
    kind = (
        F.when(t.rlike(r"^#{1,6} "), "heading").when(t.rlike(r"^\|?[\s:|-]*-{3,}[\s:|-]*\|?$"), "separator").when(t.rlike(r"^\|.*\|$"), "table")
        .when(t.rlike(r"^([-*+] |[0-9]+[.)] )"), "list").otherwise("text")
    )
    return rows.select(key, "line_no", kind.alias("kind"), F.regexp_replace(t, r"^(#{1,6}|[-*+]|[0-9]+[.)]) +", "").alias("text"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of image files; their content is read by recognisers only."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
