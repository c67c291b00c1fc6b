"""Operators of the core on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.functions import text as X
from foliant.operators import corpus as C
from foliant.operators import layout as L
from foliant.operators import results as M
from foliant.operators import review as R
from foliant.operators import tables as B
from foliant.operators import transcode as Z
from foliant.sources import readers as S
from foliant.sources import sinks as K
from foliant.sources.engines import recognise


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "wanted"), [("a b", "a b"), ("é", "é"), ("a​b\u0007", "ab"), ("क्‍ष", "क्‍ष"), ("a \t  b", "a b"), ("", ""), (None, None)])
def test_normalize(spark, raw, wanted):
    assert one(spark, X.normalize(F.col("t")), t=raw) == wanted


def test_devanagari_blanks(spark):
    assert one(spark, X.repair_devanagari_blanks(F.col("t")), t="क्  षि") == "क्षि"
    assert one(spark, X.repair_devanagari_blanks(F.col("t")), t="नेपाल ्यो क् षेत्र") == "नेपाल्यो क्षेत्र"


@pytest.mark.parametrize(("p", "r", "wanted"), [("", "", 0.0), ("a", "", 1.0), ("", "a", 1.0), ("abd", "abc", 1 / 3), ("\U00016d40x", "\U00016d41x", 0.5)])
def test_cer(spark, p, r, wanted):
    assert one(spark, X.cer(F.col("p"), F.col("r")), p=p, r=r) == pytest.approx(wanted)


def test_edit_distance_beyond_the_band(spark):
    a, b = "x" * 200, "y" * 200
    assert one(spark, X.edits(F.col("a"), F.col("b")), a=a, b=b) == 200


def test_wer_and_graphemes(spark):
    df = spark.createDataFrame([("a b c", "a x c"), (None, "a"), ("", "")], "p string, r string")
    assert [r[0] for r in df.select(X.wer("p", "r")).collect()] == pytest.approx([1 / 3, 1.0, 0.0])
    df = spark.createDataFrame([("क्षेत्र",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(X.grapheme_count("t")).collect()] == [2, 3, 0]


@pytest.mark.parametrize(("raw", "wanted"), [("2022-08-21", "2022-08-21"), ("5/4/2022", "2022-04-05"), ("२०२२-०८-२१", "2022-08-21"), ("soon", None), (None, None)])
def test_date_key(spark, raw, wanted):
    assert one(spark, X.date_key(F.col("d")), d=raw) == wanted


def test_iou(spark):
    df = spark.createDataFrame([((0.0, 0.0, 2.0, 2.0), (1.0, 0.0, 2.0, 2.0)), ((0.0, 0.0, 1.0, 1.0), (1.0, 0.0, 1.0, 1.0)), ((0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0))],
                               "a struct<x:double,y:double,w:double,h:double>, b struct<x:double,y:double,w:double,h:double>")
    assert [r[0] for r in df.select(G.iou(F.col("a"), F.col("b"))).collect()] == pytest.approx([1 / 3, 0.0, 0.0])


def test_splits_cover_and_do_not_move(spark):
    df = spark.range(2000).withColumn("s", (F.col("id") % 7).cast("string"))
    held = C.hash_split(df, "id", 0.1).where("is_held").count()
    assert 140 < held < 260
    got = C.stratified_split(df, "id", "s", 0.1).groupBy("s").agg(F.count_if("is_held").alias("n"), F.count("*").alias("all")).collect()
    assert all(r["n"] == round(r["all"] * 0.1) for r in got) and sum(r["all"] for r in got) == 2000


def test_rebalance(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(9)], "id long, s string")
    assert {r["s"]: r["count"] for r in C.rebalance(df, "id", "s").groupBy("s").count().collect()} == {"a": 7, "b": 7}


def test_digest_ignores_order(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, t string").withColumn("g", F.lit(1))
    assert C.digest(df, ["id", "t"], ["g"]).collect() == C.digest(df.orderBy(F.desc("id")), ["id", "t"], ["g"]).collect()


def test_overlap_ignores_null_and_empty(spark):
    a = spark.createDataFrame([("x", ""), ("y", None)], "k string, v string")
    assert {r["name"]: r["n"] for r in C.overlap(a, a.where("k = 'x'"), {"k": "k", "v": "v"}).collect()} == {"k": 1, "v": 0}


def test_edit_opcodes_are_shortest_and_whole():
    rng = random.Random(3)
    assert list(X.edit_opcodes("kitten", "sitting")) == [("k", "s"), ("e", "i"), ("", "g")]
    assert list(X.edit_opcodes("", "ab")) == [("", "ab")] and list(X.edit_opcodes("ab", "")) == [("ab", "")] and not list(X.edit_opcodes("ab", "ab"))
    for n in range(300):
        a, b = ("".join(rng.choice("abcd"[:2 + n % 3]) for _ in range(rng.randint(0, 40))) for _ in range(2))
        for chunk in (1, 3, 256):
            ops = list(X.edit_opcodes(a, b, chunk))
            assert sum(max(len(p), len(r)) for p, r in ops) == X.token_distance(list(a), list(b))
            assert ops == list(X.edit_opcodes(a, b))
            assert len(a) - len(b) == sum(len(p) - len(r) for p, r in ops)


def test_confusions_of_aligned_pages(spark):
    rows = [(1, "headline of the page\nthe cat sat", "the cat sat"), (2, "tbe cat sat", "the cat sat"), (3, "the cat st tbe", "the cat sat the"), (4, "the e\u0301", "the \u00e9"), (5, "same", "same")]
    got = M.confusions(spark.createDataFrame(rows, "k long, p string, r string"), "k", "p", "r", 2).collect()
    assert [tuple(r) for r in got] == [("b", "h", 2), ("headline of the page\n", "<eps>", 1)]
    every = M.confusions(spark.createDataFrame(rows, "k long, p string, r string").repartition(4), "k", "p", "r", 200).collect()
    assert [tuple(r) for r in every] == [("b", "h", 2), ("headline of the page\n", "<eps>", 1), ("<eps>", "a", 1)]


def test_paired_outcomes(spark):
    df = spark.createDataFrame([(1, "c", 1.0), (1, "b", 2.0), (2, "c", 3.0), (2, "b", 3.0), (3, "c", 5.0)], "k int, s string, v double")
    r = M.outcomes(M.paired(df, "k", "s", "v", "c", "b"), lower_is_better=True).first()
    assert (r["n_pairs"], r["wins"], r["losses"], r["ties"]) == (2, 1, 0, 1)
    zero = spark.createDataFrame([(1, "c", 1.0), (1, "b", 0.0)], "k int, s string, v double")
    assert M.outcomes(M.paired(zero, "k", "s", "v", "c", "b"), lower_is_better=False).first()["relative_improvement"] == math.inf


def test_sign_test(spark):
    df = spark.createDataFrame([(0, 0), (5, 0), (3, 2)], "w int, l int")
    assert [r[0] for r in df.select(M.sign_test("w", "l")).collect()] == [None, pytest.approx(1 / 32), pytest.approx(0.5)]


def test_bootstrap_is_about_the_mean_and_does_not_depend_on_partitions(spark):
    df = spark.range(400).withColumn("v", (F.col("id") % 10).cast("double"))
    a, b = M.bootstrap_ci(df, "id", "v", 200).first(), M.bootstrap_ci(df.repartition(7), "id", "v", 200).first()
    assert a["low"] < 4.5 < a["high"] and a["low"] == pytest.approx(b["low"])


def test_best_system_ties(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 0.5, 9.0), (1, "b", 1.0, 0.9, 9.0), (2, "a", 1.0, 0.5, 2.0), (2, "b", 1.0, 0.5, 1.0)], "k int, s string, v double, q double, t double")
    assert {r["k"]: r["s"] for r in M.best_system(df, "k", "s", "v", "q", "t").collect()} == {1: "b", 2: "b"}


def test_blocks_and_reading_order(spark):
    text = "Title\n\n\nfirst line\nsecond line\n| a | b |\n| c | d |\nlast"
    d = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string")
    lines = L.reading_order(L.text_lines(d.where("t is not null"), "id", "t"), ["id"])
    got = [(r["block_type"], r["n_lines"]) for r in L.blocks(L.segment_blocks(lines, ["id"]), ["id"]).orderBy("block_no").collect()]
    assert got == [("title", 1), ("text", 2), ("table", 2), ("text", 1)]


def test_page_quality_with_faults(spark):
    rows = [(1, 0, "a", 0.9), (1, 1, " ", 0.4), (2, 0, "a", None), (2, 1, "b", 0.95), (3, 0, "a", 1.0), (4, 0, "a", 1.0)]
    lines = spark.createDataFrame(rows, "k long, line_no int, text string, confidence double")
    faults = spark.createDataFrame([(1, 1, 1), (3, 9, 9)], "k long, tables_without_cells long, blocks_without_lines long")
    got = {r["k"]: r["quality_score"] for r in L.page_quality(lines, ["k"], faults=faults).collect()}
    assert got == {1: round(1 - 0.175 - 0.1 - 0.06 - 0.05 - 0.02, 6), 2: 0.9, 3: 0.75, 4: 1.0}
    text = "A title\n\n| --- | --- |\n\nprose\n| x | y |"
    doc = L.text_lines(spark.createDataFrame([(7, text)], "k long, text string"), "k", "text")
    blocks = L.segment_blocks(L.reading_order(doc, ["k"]), ["k"])
    assert [tuple(r) for r in L.structure_faults(blocks, B.cells(doc, "k"), ["k"]).collect()] == [(7, 1, 0)]


def test_concordant_pairs():
    for n in (0, 1, 2, 30):
        v = [random.Random(n).randrange(50) for _ in range(n)]
        assert L.concordant_pairs(v) == sum(v[i] < v[j] for i in range(n) for j in range(i + 1, n))


def test_column_bands_and_rows():
    boxes = [(0, 0, 100, 20), (200, 0, 100, 20), (0, 30, 100, 20), (200, 32, 100, 20)]
    assert L.column_bands(boxes) == [0, 2, 1, 3]
    assert L.column_bands([(5, 1, 0, 0), (4, 0, 0, 0)]) == [1, 0]  # no widths: by y, then x
    assert L.merge_rows([(0, 0, 50, 20), (60, 2, 50, 20), (300, 0, 50, 20), (0, 50, 10, 10)]) == [[0, 1], [2], [3]]


def test_greedy_match_and_suppression():
    a = [(0, 0, 10, 10), (20, 0, 10, 10)]
    got = L.greedy_match(a, [(1, 0, 10, 10), (100, 0, 5, 5)], 0.5)
    assert [(i, j) for i, j, _ in got] == [(0, 0), (1, None), (None, 1)]
    assert L.suppress([(0, 0, 10, 10), (1, 0, 10, 10), (30, 0, 5, 5)], [0.5, 0.9, 0.1], 0.5) == [1, 2]


def test_tables():
    assert B.normalize_grid([["a", "", "—", "a", "b"], ["c", "", "_", "c", "d"]]) == [["a", "b"], ["c", "d"]]
    assert B.header_spans(["x", "x", "y"], ["1", "2", "3"]) == [(0, 2, "x"), (2, 1, "y")]
    assert B.header_spans(["x", "x"], ["1", "1"]) == [(0, 1, "x"), (1, 1, "x")]
    assert B.to_csv([["a,b", 'q"']]) == '"a,b","q"""'
    assert B.to_markdown([["a", "b"], ["c|d", "e"]]) == "| a | b |\n| --- | --- |\n| c\\|d | e |"
    assert B.html_cells("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == [(0, 0, 2, 1, "a"), (0, 1, 1, 1, "b"), (1, 1, 1, 1, "c")]
    assert B.html_text("<p>a  b</p><p>c</p>") == "a b\nc" and B.html_text(None) is None
    assert B.tree_similarity([["a"]], [["a"]], True) == 1.0 and B.tree_similarity([["a"]], [["b"]], True) == pytest.approx(2 / 3)
    assert B.grid([(0, 0, "a"), (0, 0, "b"), (1, 1, "c")]) == [["b", ""], ["", "c"]]


def test_html_table_function(spark):
    B.register(spark)
    assert spark.sql("select row, col, text from html_table_cells('<table><tr><th>x</th><td>y</td></tr></table>') order by col").collect() == [(0, 0, "x"), (0, 1, "y")]


def test_bag_scores(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "k int, w string")
    r = B.multiset_scores(a, a.where("w = 'x'").limit(1), "k", ["w"]).first()
    assert (r["matched"], r["n_predicted"], r["n_reference"], r["precision"], r["recall"]) == (1, 3, 1, pytest.approx(1 / 3), 1.0)


def test_corrections(spark):
    lines = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, text string")
    reviews = spark.createDataFrame([(1, "A", "corrected"), (2, "B", "corrected"), (2, "B2", "accept"), (3, " ", "corrected"), (1, "no", "drop")], "k int, corrected_text string, review_status string")
    done, errors = R.apply_corrections(lines, reviews, ["k"])
    assert {r["k"]: r["text"] for r in done.collect()} == {1: "A", 2: "b", 3: "c"}
    assert {(r["k"], r["code"]) for r in errors.collect()} == {(2, "duplicate_target"), (3, "empty_correction")}


def test_rules_see_the_output_of_those_before(spark):
    assert one(spark, R.apply_rules(F.col("t"), [("a", "b"), ("b", "c")]), t="a ab b") == "c ab c"


def test_transcoder():
    t = Z.Transcoder(Z.compile_rules([(2, "0x61", "U+1921"), (1, "0x61", "U+1920"), (3, "0x7E 0x79", "U+1929"), (4, "0x71", "U+1901")]))
    assert t.convert("qa~y") == ("ᤁᤩᤠ", 3, [])
    assert t.convert("q°") == ("ᤁ°", 1, ["U+00B0"])
    assert t.convert("") == ("", 0, [])


def test_readers(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"sample_id":"a","dataset":"d","split":"s","image_path":"i","text":"t"}\n\n{"sample_id":"b","dataset":"d","split":"s","image_path":"i","text":""}\n')
    assert S.load_manifest(spark, str(p)).count() == 2
    p.write_text('{"sample_id":"a"}\n{"sample_id":"a"}\n')
    with pytest.raises(S.InvalidRows, match="repeated"):
        S.load_manifest(spark, str(p))
    p.write_text("not json\n")
    with pytest.raises(S.InvalidRows):
        S.load_manifest(spark, str(p))
    rows = spark.createDataFrame([("x.png", "", "gt")], "file string, text string, label string")
    assert S.rows_to_manifest(rows, "d", "s").select("image_path", "text").first() == ("x.png", "gt")


def test_markdown_and_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "# T\n\n| a | b |\n|---|---|\n- x\nplain")], "id int, t string")
    assert [(r["kind"], r["text"]) for r in S.markdown_blocks(d, "id", "t").orderBy("line_no").collect()] == [("heading", "T"), ("table", "| a | b |"), ("separator", "|---|---|"), ("list", "x"), ("text", "plain")]
    K.write_labels(spark.createDataFrame([("i.png", "a  b\nc")], "image_path string, text string"), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first()[0] == "i.png\ta b c"


def test_engines_fall_back(spark):
    from foliant.sources import engines

    engines.ENGINES["broken"] = lambda: lambda s, t: 1 / 0
    d = spark.createDataFrame([("a", "x\n\ny"), ("b", None)], "s string, t string")
    assert [(r["source"], r["line_no"]) for r in recognise(d, "s", "t", ("text",)).orderBy("line_no").collect()] == [("a", 0), ("a", 2)]


def test_stream(spark, tmp_path):
    from foliant.streaming import review as V

    rows = spark.createDataFrame([(1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:02"), (2, "2024-01-01 00:00:03")], "k int, ts string").select("k", F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    q = V.review_queue(V.table_stream(spark, str(tmp_path), "events"), ["k"], "ts").writeStream.format("memory").queryName("queue").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from queue").first()[0] == 2
