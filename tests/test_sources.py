"""Readers of references and texts, and sinks, on small files."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.sources import readers as R
from foliant.sources import references as P
from foliant.sources import sinks as W


def test_references(spark):
    good = {"text": "a", "tables": [{"grid": [["x", "y"]]}, {"cells": [{"row": 1, "col": 0, "text": "z"}]}]}
    rows = [(1, json.dumps(good)), (2, "[1"), (3, "{}"), (4, json.dumps({"tables": [{"cells": [{"row": -1, "col": 0}]}]})), (5, None)]
    refs, errors = P.parse_references(spark.createDataFrame(rows, "k int, p string"), "k", "p")
    got = refs.collect()
    assert [r["k"] for r in got] == [1] and [tuple(c) for t in got[0]["tables"] for c in t] == [(0, 0, 1, 1, "x"), (0, 1, 1, 1, "y"), (1, 0, 1, 1, "z")]
    assert {(r["k"], r["code"]) for r in errors.collect()} == {(2, "no_object"), (3, "no_field"), (4, "place"), (5, "no_object")}


def test_find_references(spark, tmp_path):
    for name, text in (("a.reference.json", '{"text": "j"}'), ("a.txt", "t"), ("b.md", "# m"), ("c.txt", "t2")):
        (tmp_path / name).write_text(text)
    files = P.read_reference_files(spark, str(tmp_path))
    assert files.count() == 4
    own = files.where("stem = 'c'").first()["path"]
    entries = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "a", own), (4, "none", None)], "k int, s string, e string")
    assert {r["k"]: (r["kind"], r["payload"]) for r in P.find_references(entries, "k", "s", files, "e").collect()} == {1: ("json", '{"text": "j"}'), 2: ("md", "# m"), 3: ("txt", "t2"), 4: (None, None)}


def test_layout_and_tree(spark):
    layout = [{"category_type": "text", "order": 2, "text": "b"}, {"category_type": "title", "order": 1, "text": " a "}, {"category_type": "table", "order": 3, "html": "<table/>"}, {"category_type": "text", "order": 0, "ignore": True, "text": "x"}]
    r = P.layout_references(spark.createDataFrame([(1, json.dumps(layout))], "k int, l string"), "k", "l").first()
    assert (r["text"], r["tables_html"], r["categories"]) == ("a\n\nb", ["<table/>"], ["table", "text", "title"])
    P.register(spark)
    tree = json.dumps({"type": "chapter", "number": 1, "content": [{"type": "verse", "number": 2, "content": ["in the ", "beginning"]}, 5, None]})
    spark.createDataFrame([(tree,), ("{",), (None,)], "j string").createOrReplaceTempView("trees")
    assert [tuple(x) for x in spark.sql("select t.* from trees, lateral json_texts(j) t").collect()] == [("/chapter/1/verse/2", "in the "), ("/chapter/1/verse/2", "beginning")]


def test_text_source(spark):
    df = spark.createDataFrame([(1, "<b>नयाँ</b>  a/b"), (2, "x"), (3, None), (4, "नयाँ a b")], "id int, t string")
    got = P.text_source(df, "t", dataset="d", split="s", language="nep", script="Devanagari", least=2, required=r"[\x{0900}-\x{097F}]", row_id="id").collect()
    assert [(r["text"], r["source_row_id"]) for r in got] == [("नयाँ a b", "1")]


def test_local_rows(spark, tmp_path):
    (tmp_path / "metadata.jsonl").write_text('{"image": "i1", "text": "abc"}\n{"image": "", "text": "d"}\n{"image": "i2", "text": "é"}\n')
    rows = R.read_local(spark, str(tmp_path))
    kept, rejects = R.prepare_dataset(rows, "d", "train", allowed="a-z", slices=["x"])
    assert [(r["text"], r["metadata"]["slices"]) for r in kept.collect()] == [("abc", "x")] and {r["code"] for r in rejects.collect()} == {"no_image", "characters"}
    with pytest.raises(R.InvalidRows):
        R.prepare_dataset(rows, "d", "train", image="nothing")
    with pytest.raises(R.InvalidRows):
        R.read_local(spark, str(tmp_path / "x.xlsx"))
    cols = {r["column"]: r for r in R.summarize_columns(rows).collect()}
    assert cols["text"]["n_null"] == 0 and cols["text"]["least"] == "abc"
    assert {r["suffix"]: r["n"] for r in R.file_inventory(spark, str(tmp_path)).collect()} == {".jsonl": 1}


def test_publish_and_verify(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, t string")
    W.publish({"rows": df, "none": df.limit(0)}, str(tmp_path / "p"))
    assert {r["part"]: r["status"] for r in W.verify(spark, str(tmp_path / "p")).collect()} == {"rows": "ok", "none": "ok"}
    df.limit(1).write.mode("overwrite").parquet(str(tmp_path / "p/rows"))
    assert {r["part"]: r["status"] for r in W.verify(spark, str(tmp_path / "p")).collect()} == {"rows": "changed", "none": "ok"}


def test_reports_and_books(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a|x", 1)], "s string, n int")
    assert W.report_markdown(df, "T", ["s"], ["n"]).first()["value"] == "# T\n\n| s | n |\n| --- | --- |\n| a\\|x | 1 |\n| b | 2 |"
    pages = spark.createDataFrame([("x", 2, "two"), ("x", 1, "one"), ("y", 1, None)], "book string, page int, t string")
    W.write_book(pages, str(tmp_path / "books"), "book", "page", "t")
    assert spark.read.text(str(tmp_path / "books/book=x"), wholetext=True).first()[0] == "one\f\ntwo\f\n"
    W.write_table(df.withColumn("l", F.array("s")), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True, sep="\t").columns == ["s", "n", "l"]
    W.write_documents(df.select("s", "n", F.lit("# m").alias("markdown")), str(tmp_path / "d"), "n")
    assert spark.read.parquet(str(tmp_path / "d/documents")).count() == 2
