"""Scores, orders, composite outputs, audits and bundles against brute force on small data."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import audits as A
from foliant.operators import bundles as U
from foliant.operators import composite as C
from foliant.operators import corpus as M
from foliant.operators import orders as O
from foliant.operators import scoring as S


def _cells(grid):
    return [(i, j, 1, 1, v) for i, r in enumerate(grid) for j, v in enumerate(r)]


def _tree(cells, with_text):
    """The table as a nested tree (label, children)."""
    n = max((c[0] + c[2] for c in cells), default=0)
    row = lambda i: [(("td", c[2], c[3], c[4] if with_text else ""), []) for c in sorted(cells, key=lambda c: c[1]) if c[0] == i]
    return ("table", [("tr", row(i)) for i in range(n)])


def _size(t):
    return 1 + sum(map(_size, t[1]))


def _distance(a, b):
    """Least cost over all order-preserving pairings of the children, by trying them all."""
    best = None
    for k in range(min(len(a[1]), len(b[1])) + 1):
        for x in itertools.combinations(range(len(a[1])), k):
            for y in itertools.combinations(range(len(b[1])), k):
                cost = sum(_size(c) for i, c in enumerate(a[1]) if i not in x) + sum(_size(c) for j, c in enumerate(b[1]) if j not in y)
                cost += sum(_distance(a[1][i], b[1][j]) for i, j in zip(x, y, strict=True))
                best = cost if best is None else min(best, cost)
    return (a[0] != b[0]) + best


@pytest.mark.parametrize("with_text", [False, True])
def test_table_similarity_against_all_pairings(with_text):
    rng = random.Random(3)
    for _ in range(30):
        a, b = ([(i, j, 1, rng.choice([1, 1, 2]), rng.choice("xyz")) for i in range(rng.randint(0, 3)) for j in range(rng.randint(0, 3))] for _ in "ab")
        x, y = _tree(a, with_text), _tree(b, with_text)
        assert S.table_similarity(a, b, with_text) == pytest.approx(1 - _distance(x, y) / max(_size(x), _size(y)))


def test_structure_and_cells():
    a, b = _cells([["x", "y"], ["z", ""]]), _cells([["x", "y"], ["z", "w"]])
    assert S.structure_similarity(a, b) == pytest.approx(1 - 1 / 6) and S.structure_similarity([], []) == 1.0 and S.structure_similarity(a, []) == 0.0
    assert S.cell_rates(a, b) == pytest.approx((0.75, 0.75, 0.75)) and S.cell_rates([], []) == (1.0, 1.0, 1.0) and S.cell_rates([], a)[2] == 0.0
    assert S.match_tables([a, b], [b, a, a]) == [(0, 1), (1, 0), (2, None)]
    spans = [(0, 0, 1, 2, "x"), (1, 0, 1, 1, "y"), (1, 1, 1, 1, "z")]
    assert S.table_similarity(spans, spans, True) == 1.0 and S.table_similarity(spans, _cells([["x"], ["y", "z"]]), False) < 1.0


def test_figures():
    f = lambda page, x, caption, ids=(): {"page": page, "x": x, "y": 0.0, "w": 10.0, "h": 10.0, "caption": caption, "line_ids": list(ids)}
    assert S.match_figures([f(0, 0, None), f(0, 100, "Figure 1: map")], [f(0, 90, "Figure 1: map"), f(0, 1, None), f(1, 0, None)]) == [(0, 1), (1, 0), (2, None)]
    assert S.match_figures([f(0, 0, None, ["a"])], [{**f(0, 50, None, ["a"])}]) == [(0, 0)]


def test_order_rate():
    assert S.order_rate(["a", "b", "c"], ["a", "b", "c"]) == 1.0 and S.order_rate(["c", "b", "a"], ["a", "b", "c"]) == 0.0
    assert S.order_rate(["a", "c"], ["a", "b", "c"]) == pytest.approx(1 / 3) and S.order_rate([], ["a"]) == 1.0


def test_cluster_distance():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 80))) for _ in "ab")
        assert S.cluster_distance(list(a), list(b)) == X.token_distance(list(a), list(b))


def test_grapheme_edits(spark):
    df = spark.createDataFrame([("क्षेत्र", "क्षेत"), ("", ""), (None, "ab"), ("é", "é")], "p string, r string")
    assert [tuple(r[0]) for r in df.select(S.grapheme_edits("p", "r")).collect()] == [(1, 2), (0, 0), (2, 2), (0, 1)]


def test_word_rate(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))), " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))) for _ in range(80)] + [(None, "a"), ("a", None), ("x " * 500, "x " * 400)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, r string").select(X.wer("p", "r")).collect()]
    rate = lambda p, r: X.token_distance(p, r) / len(r) if r else float(bool(p))
    assert got == pytest.approx([rate((p or "").split(), (r or "").split()) for p, r in rows])


def test_score_documents(spark):
    schema = f"k int, text string, markdown string, reading_order array<string>, tables array<{S.CELLS}>, figures {S.FIGURES}"
    table = [{"row": 0, "col": 0, "rowspan": 1, "colspan": 1, "text": "a"}]
    p = spark.createDataFrame([(1, " abc ", "# abc", ["l1", "l2"], [table], []), (2, "x", None, None, None, None)], schema)
    r = spark.createDataFrame([(1, "abd", "# abc", ["l2", "l1"], [table], None), (3, "y", None, None, None, None)], schema)
    got = {x["k"]: x["metrics"] for x in S.score_documents(p, r, "k").collect()}
    assert got[1]["cer"] == pytest.approx(1 / 3) and got[1]["document_reconstruction_text_similarity"] == 1.0 and got[1]["table_teds_text"] == 1.0
    assert got[1]["reading_order_pair_accuracy"] == 0.0 and got[1]["document_reconstruction_similarity"] == 0.0 and "figure_detection_f1" not in got[1]
    assert got[3] == {"cer": 1.0, "wer": 1.0} and set(got) == {1, 3}


def test_orders():
    boxes = [(0, 10, 50, 20), (100, 4, 50, 20), (0, 40, 50, 20), (100, 44, 50, 20)]
    assert O.anchored_rows(boxes, 24.0) == [0, 1, 2, 3] and O.anchored_rows(boxes, 24.0, True) == [1, 0, 3, 2]
    assert O.overlapping_columns(boxes, 200.0) == [0, 2, 1, 3] and O.overlapping_columns([], 1.0) == [] and O.anchored_rows([], 1.0) == []


def test_auto_order(spark):
    rows = [(1, i, (i % 2) * 600.0, (i // 2) * 30.0, 300.0, 20.0, 1000.0) for i in range(10)] + [(2, i, 0.0, i * 30.0, 900.0, 20.0, 1000.0) for i in range(3)]
    df = spark.createDataFrame(rows, "page int, line_no int, x double, y double, w double, h double, page_width double")
    got = {(r["page"], r["line_no"]): r["position"] for r in O.ordered(df, ["page"], "auto", "page_width").collect()}
    assert [got[1, i] for i in range(10)] == [0, 5, 1, 6, 2, 7, 3, 8, 4, 9] and [got[2, i] for i in range(3)] == [0, 1, 2]
    f = {r["page"]: r for r in O.layout_features(df, ["page"], "page_width").collect()}
    assert f[1]["x_clusters"] == 2 and f[1]["x_span_ratio"] == pytest.approx(0.6) and f[2]["x_clusters"] == 1


def test_nearest_lines():
    a = [(0, 0, 10, 10), (0, 100, 10, 10), (0, 200, 10, 10)]
    assert [j for j, *_ in C.nearest_lines(a, [(0, 195, 10, 10), (0, 1, 10, 10)])] == [1, 0, None]


def test_transfer_and_backfill(spark):
    line = lambda t, y: (t, 0.0, float(y), 10.0, 10.0, 0.5)
    schema = f"k int, p array<{C._LINE}>, s array<{C._LINE}>"
    df = spark.createDataFrame([(1, [line("b", 20), line("a", 0), line("c", 90)], [line("x", 0), line("y", 21)]), (2, None, [line("z", 0)]), (3, [line("q", 0)], None), (4, None, None)], schema)
    got = {r["k"]: ([v["text"] for v in r["lines"]], r["n_matched"]) for r in C.transfer_text(df, "k", "p", "s", True).collect()}
    assert got == {1: (["a", "b", "c"], 2), 2: (["z"], 0), 3: (["q"], 1), 4: ([], 0)}


def test_captions(spark):
    df = spark.createDataFrame([("Figure 2: x",), ("fig. 1",), ("तालिका १: क",), ("configured",), (None,)], "t string")
    assert [tuple(r) for r in df.select(C.is_figure_marker(F.col("t")), C.is_caption(F.col("t"))).collect()] == [(True, True), (True, False), (False, True), (False, False), (False, False)]
    box = "x double, y double, w double, h double"
    caps = spark.createDataFrame([(1, "Fiqvrc 1", 0.0, 0.0, 10.0, 10.0), (2, "Figure", 0.0, 0.0, 10.0, 10.0)], f"k int, text string, {box}")
    other = spark.createDataFrame([(1, "Figure 1", 0.0, 0.0, 10.0, 9.0), (1, "Figure far", 50.0, 0.0, 10.0, 9.0), (2, "xigure", 0.0, 0.0, 10.0, 10.0)], f"k int, text string, {box}")
    assert {r["k"]: (r["text"], r["is_replaced"]) for r in C.best_caption(caps, other, ["k"], 0.5, 1).collect()} == {1: ("Figure 1", True), 2: ("Figure", False)}


def test_gates_and_decisions(spark):
    df = spark.createDataFrame([("m", 10, 8, 2, 0.9, 0.5, 0.4, 0.8), ("n", 3, 0, 0, 0.5, 0.5, 0.0, 0.0)], "metric string, n_pairs long, wins long, losses long, candidate_mean double, baseline_mean double, absolute_improvement double, relative_improvement double")
    got = A.evaluate_gates(df, ["metric"], {"min_pairs": 5, "min_win_rate": 0.5, "max_p_value": 0.06, "max_losses": 2})
    assert {(r["metric"], r["gate"]) for r in got.where("not passed").collect()} == {("n", "min_pairs"), ("n", "min_win_rate"), ("n", "max_p_value")}
    assert {r["metric"]: (r["failed"], r["admitted"]) for r in A.decisions(got, ["metric"]).collect()} == {"m": ("", True), "n": ("max_p_value,min_pairs,min_win_rate", False)}
    with pytest.raises(ValueError):
        A.evaluate_gates(df, ["metric"], {"unheard_of": 1})


def test_issues_verdict_and_ranges(spark):
    df = spark.createDataFrame([(1, "", None), (2, "a", 5), (3, None, 7)], "k int, t string, n int")
    found = A.issues(df, ["k"], {"empty": (A.ERROR, F.coalesce("t", F.lit("")) == ""), "large": (A.WARNING, F.col("n") > 6)})
    assert {tuple(r) for r in found.collect()} == {(1, "error", "empty"), (3, "error", "empty"), (3, "warning", "large")}
    assert tuple(A.verdict(found).first()) == (2, 1, False) and tuple(A.verdict(found.limit(0)).first()) == (0, 0, True)
    points = spark.sql("select array('U+0041-U+0043', 'U+0061', 'none', 'U+0043', 'U+0050-U+0041') as r").select(A.codepoint_ranges(F.col("r"))).first()[0]
    assert points == [0x41, 0x42, 0x43, 0x61]


def test_replay_and_rules(spark):
    df = spark.createDataFrame([(1, 3, "abc"), (2, 9, "abc"), (3, None, None)], "k int, n int, t string")
    assert [tuple(r) for r in A.replay(df, ["k"], {"n": F.length("t")}).collect()] == [(2, "n", "9", "3")]
    rules = spark.createDataFrame([(1, "a", "b"), (2, "a", "c"), (3, "b", "b"), (4, " ", "x")], "no int, s string, t string")
    assert {(r["no"], r["code"]) for r in A.rule_issues(rules, "no", "s", "t").collect()} == {(2, "shadowed"), (3, "no_change"), (1, "chained"), (4, "empty_source")}


def test_group_split_and_lists(spark):
    df = spark.createDataFrame([(i, f"g{i % 40}", "ab"[i % 2]) for i in range(400)], "k int, g string, s string")
    got = M.group_split(df, "g", "s", 0.2)
    assert got.groupBy("g").agg(F.countDistinct("is_held").alias("n")).where("n > 1").count() == 0
    assert {r["s"]: r["n"] for r in got.where("is_held").groupBy("s").agg(F.countDistinct("g").alias("n")).collect()} == {"a": 4, "b": 4}
    held = M.first_by_hash(df.select("k", F.sha2(F.col("k").cast("string"), 256).alias("h")), "h", 0.05, 30)
    assert held.where("is_held").count() == 30
    left = M.without_listed(df, "g", spark.createDataFrame([("g1",), ("",), (None,)], "t string"), "t")
    assert left.count() == 390


def test_bundles(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "")], "k int, g string, t string")
    back = spark.createDataFrame([(1, " ok "), (1, "ok"), (2, "p"), (2, "q"), (3, " ")], "k int, text string")
    assert {r["k"]: (r["status"], r["text"]) for r in U.verification(rows.unionByName(spark.createDataFrame([(4, "b", "")], rows.schema)), back, ["k"], "text").collect()} == {1: ("verified", "ok"), 2: ("conflicting", None), 3: ("empty", None), 4: ("open", None)}
    assert U.open_rows(rows, back.where("k = 1"), ["k"]).count() == 2
    assert U.sidecars(rows, ["g"], ["k"], ["t"]).where("g = 'a'").first()["payload"] == '[{"t":"x"},{"t":"y"}]'
    assert {(r["k"], r["order_index"]) for r in U.review_rows(rows, ["k"], [], ["t"], ["note"], ["g"]).collect()} == {(1, 1), (2, 2), (3, 1)}
