"""Training-data operators on small fixtures, against brute force, round trips or held-out rows.

Every operator is given nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns with clashing names.
"""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import p1_sample as p1
from foliant.llm import p2_language as p2
from foliant.llm import p3_visual as p3
from foliant.llm import p4_groups as p4
from foliant.llm import p5_ocr as p5
from foliant.llm import p6_overlap as p6
from foliant.llm import p7_garbled as p7
from foliant.llm import p8_tokens as p8
from foliant.llm import p9_mix as p9
from foliant.llm import p10_content as p10

# 1 -------------------------------------------------------------------------

REQUEST = "dataset string, category string, target_share double, min_rows int, sample_fraction double"


def test_p1_shares_floors_and_shortfalls(spark):
    rows = [("d", f"s{i}", "a" if i < 600 else "b" if i < 990 else "c") for i in range(1000)] + [("d", "s0", "a"), ("d", "n1", None), ("d", None, "a"), (None, "x", "a")]
    frame = spark.createDataFrame(rows, "dataset string, sample_id string, category string").withColumn("w", F.lit(1)).withColumn("u", F.lit("clash"))
    request = spark.createDataFrame([("d", "a", 0.5, 5, 0.2), ("d", "b", 0.4, 5, 0.2), ("d", "c", 0.1, 12, 0.2), ("d", "none", 0.0, 3, 0.2)], REQUEST)
    sample, report = p1.sample_to_targets(frame.select("dataset", "sample_id", "category"), request)
    got = {r["category"]: r for r in report.collect()}
    assert {c: got[c]["supply"] for c in got} == {"a": 600, "b": 390, "c": 10, "none": 0}
    assert {c for c in got if got[c]["short"]} == {"c", "none"}
    n = {r["category"]: r["count"] for r in sample.groupBy("category").count().collect()}
    assert abs(n["a"] - 100.1) < 1 and abs(n["b"] - 80.08) < 1 and n["c"] == 10
    assert sample.count() == sample.distinct().count() == sum(got[c]["drawn"] for c in got)
    assert all(got[c]["drawn"] >= min(got[c]["min_rows"], got[c]["supply"]) for c in got)


def test_p1_fill():
    assert p1.fill([50, 40, 10], [0, 0, 0], [100, 100, 100]) == pytest.approx([50, 40, 10])
    short = p1.fill([50, 40, 10], [0, 0, 0], [20, 100, 100])
    assert short == pytest.approx([20, 64, 16]) and sum(short) == pytest.approx(100)
    floor = p1.fill([90, 9, 1], [0, 0, 10], [500, 500, 500])
    assert floor[2] == 10 and floor[0] / floor[1] == pytest.approx(10) and sum(floor) == pytest.approx(100)
    assert p1.fill([50, 50], [5, 5], [3, 10]) == [3, 10] and p1.fill([0, 0], [0, 0], [5, 5]) == [0, 0] and p1.fill([0, 10], [3, 0], [1, 100]) == pytest.approx([1, 9])


def test_p1_keeps_the_planned_size(spark):
    frame = spark.createDataFrame([("d", f"s{i}", "a" if i < 600 else "b" if i < 990 else "c") for i in range(1000)], "dataset string, sample_id string, category string")
    request = spark.createDataFrame([("d", "a", 0.5, 5, 0.2), ("d", "b", 0.4, 5, 0.2), ("d", "c", 0.1, 12, 0.2)], REQUEST)
    sample, report = p1.sample_to_targets(frame, request, keep_size=True)
    n = {r["category"]: r["count"] for r in sample.groupBy("category").count().collect()}
    assert n["c"] == 10 and abs(n["a"] - 190 * 5 / 9) < 1.01 and abs(sum(n.values()) - 200) <= 1
    assert {r["category"] for r in report.where("short").collect()} == {"c"}


def test_p1_empty(spark):
    frame = spark.createDataFrame([], "dataset string, sample_id string, category string")
    sample, report = p1.sample_to_targets(frame, spark.createDataFrame([("d", "a", 1.0, 2, 0.5)], REQUEST))
    assert sample.count() == 0 and report.first()["short"] and report.first()["supply"] == 0


# 2 -------------------------------------------------------------------------

WORDS = {"eng": "the ledger was brought from school and printed by teachers after rains".split(), "nep": "यो पुस्तक पुरानो भए पनि विद्यालयका शिक्षकहरूले छापे र बाँडिएको छ".split(), "lif": "ᤓᤥᤍᤥ ᤒᤡᤈ ᤌᤠᤸ ᤔᤥᤇᤣ ᤃᤫ ᤁᤠᤸᤔᤡ".split()}
LANGS = sorted(WORDS)
SCRIPTS = {"eng": {"Latin"}, "nep": {"Devanagari", "Latin"}, "lif": {"Limbu"}}


@pytest.fixture(scope="module")
def field():
    rng = random.Random(1)
    texts = [[rng.choice(WORDS[x]) for _ in range(rng.randint(8, 25))] for x in LANGS for _ in range(60)]
    labels = [i for i in range(3) for _ in range(60)]
    labels[5], labels[70] = 2, 0  # wrong labels
    return p2.fit(texts, labels, LANGS, SCRIPTS)


def _text(x, n, seed=3):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[x]) for _ in range(n))


def test_p2_segments(field):
    own = p2.Labeller(field)
    mixed = _text("eng", 15) + " 12, " + _text("nep", 12) + " " + _text("eng", 10)
    brief = _text("eng", 10) + " " + _text("nep", 3) + " " + _text("eng", 10)
    segs = own.label([mixed, brief, None, "", " 12 34 ", _text("lif", 4), _text("nep", 5000)])
    name = lambda s: [LANGS[x[0]] for x in s]
    assert name(segs[0]) == ["eng", "nep", "eng"] and segs[0][-1][2] == len(mixed.split()) - 1
    assert {LANGS[x] for x in p2.written(segs[0])} == {"eng", "nep"}
    assert name(segs[1]) == ["eng"] and segs[2:5] == [[], [], []]
    assert name(segs[5]) == ["lif"] and name(segs[6]) == ["nep"]
    assert all(0 <= s[3] <= 1 for x in segs for s in x)


def test_p2_forward_backward_is_that_of_all_paths(field):
    rng = np.random.RandomState(0)
    e = rng.randn(1, 4, 3)
    got = field.posteriors(e, np.array([4]))[:, 0]
    total = np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        s = np.exp(field.first[path[0]] + sum(e[0, i, k] for i, k in enumerate(path)) + sum(field.transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
        for i, k in enumerate(path):
            total[i, k] += s
    assert got == pytest.approx(total / total.sum(1, keepdims=True), abs=1e-4)


def test_p2_frame(spark, field):
    df = spark.createDataFrame([(1, _text("nep", 12), "x"), (2, None, "y"), (2, "", "y")], "id int, text string, segments2 string")
    got = {(r["id"], len(r["segments"])) for r in p2.label_languages(df, "text", field).collect()}
    assert got == {(1, 1), (2, 0)}
    assert p2.label_languages(df.limit(0), "text", field).count() == 0


# 3 -------------------------------------------------------------------------

SAME = [
    ("the map", "thе map"), ("abc", "ａｂｃ"), ("a b", "a b"), ("a​b", "ab"), ("é", "é"), ("long-lost", "long‐lost"), ("कड़ी", "कड़ी"), ("छन्", "छन्‌"), ("आज", "अाज"), ("𑒏𑒼", "𑒏𑒼"), ("Notice", "Νotice"), ("co­op", "coop"), ("x，y", "x,y"),
]
OTHER = [("the", "The"), ("a b", "a  b"), ("गर्‍यो", "गर्यो"), ("ab", "a.b"), ("mm2", "mm²"), ("क्‌ष", "क्ष")]


@pytest.fixture(scope="module")
def canon():
    seen = {}
    plain, words = p3._Plain(), p3.Counter({"the": 5, "map": 3, "notice": 2, "Notice": 1, "abc": 1})
    counts = p3.Counter()
    p3._add(counts, words, plain)
    seen.update(counts)
    return p3.Canonical(seen)


def test_p3_forms(canon):
    assert [x for x in SAME if canon.text(x[0]) != canon.text(x[1])] == []
    assert [x for x in OTHER if canon.text(x[0]) == canon.text(x[1])] == []
    assert canon.text("thе") == "the" and canon.text("") == ""
    assert all(canon.text(canon.text(x)) == canon.text(x) for pair in SAME + OTHER for x in pair)


def test_p3_pairs_against_brute_force(spark, canon):
    texts = [t for pair in SAME + OTHER for t in pair] + ["the map", "", None, " ", "x" * 50_000, "х" * 50_000]
    rows = [(("m", "l")[i % 5 == 0], i, t) for i, t in enumerate(texts)]
    got = {tuple(r) for r in p3.same_looking_pairs(spark.createDataFrame(rows, "tbl string, id long, text string")).collect()}
    form = {i: canon.text(t) for _, i, t in rows if t and t.strip()}
    wanted = {(x[0], x[1], y[1]) for x, y in itertools.combinations(rows, 2) if x[0] == y[0] and x[1] in form and y[1] in form and x[2] != y[2] and form[x[1]] == form[y[1]]}
    assert got == wanted
    assert p3.same_looking_pairs(spark.createDataFrame([], "tbl string, id long, text string")).count() == 0


# 4 -------------------------------------------------------------------------


def _components(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, *keys in rows:
        for n, k in enumerate(keys):
            if k is not None:
                a, b = find(("r", i)), find((n, k))
                parent[a] = b
    groups = {}
    for i, *_ in rows:
        groups.setdefault(find(("r", i)), set()).add(i)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("seed", [0, 1])
def test_p4_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    pick = lambda n: rng.choice([None, *(f"k{j}" for j in range(n))])
    rows = [(i, pick(60), pick(60), "hot" if rng.random() < 0.3 else pick(80)) for i in range(150)]
    rows += [(200 + i, f"c{i}", f"c{i + 1}", None) for i in range(0, 40)]  # a long chain
    df = spark.createDataFrame(rows, "row_id long, a string, b string, c string").withColumn("component", F.lit("clash"))
    got = {}
    for r in p4.group_records(df, "row_id", {k: F.col(k) for k in "abc"}).collect():
        got.setdefault(r["component"] or ("alone", r["record"]), set()).add(r["record"])
    assert {frozenset(g) for g in got.values()} == _components([(i, a, b, c) for i, a, b, c in rows])


def test_p4_values_across_fields(spark):
    df = spark.createDataFrame([(1, "ent-1", None), (2, None, "ent-1"), (3, "aut-1", "ent-2"), (4, None, None)], "row_id long, author string, entity string")
    keys = {k: F.col(k) for k in ("author", "entity")}
    got = {r["record"]: r["component"] for r in p4.group_records(df, "row_id", keys, across=True).collect()}
    assert got[1] == got[2] != got[3] and got[4] is None
    apart = {r["record"]: r["component"] for r in p4.group_records(df, "row_id", keys).collect()}
    assert apart[1] != apart[2]


def test_p4_splits_keep_groups_whole_and_meet_shares(spark):
    df = spark.range(6000).select(F.col("id").alias("record"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("g"), (F.col("id") % 1500).cast("string"))).alias("component"))
    got = p4.assign_splits(df, [("train", 0.8), ("validation", 0.1), ("test", 0.1)])
    assert got.where("component is not null").groupBy("component").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    share = {r["split"]: r["count"] / 6000 for r in got.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.05 and abs(share["test"] - 0.1) < 0.04
    assert p4.group_records(spark.createDataFrame([], "row_id long, a string"), "row_id", {"a": F.col("a")}).count() == 0


def test_p4_placeholders():
    from foliant.llm.common import PLACEHOLDERS

    assert {"", "n/a", "unknown", "अज्ञात", "?", "-"} <= set(PLACEHOLDERS)


# 5 -------------------------------------------------------------------------


def test_p5_page_parts():
    page = "Hill Courier    Page 78\nthe farmer of the village shared the well-\nknown ledger with every teacher of the pub-\nlic school today and read it\n57344\nto all of them again.\n— 101 —"
    p = p5.Page(page)
    assert p.numbers == {6} and list(p.titles) == [0] and p.titles[0] == ("hill courier", True)
    assert [(i, w) for i, _, w, cut in p.words(set(p.titles)) if cut] == [(1, "-well\nknown"), (2, "-pub\nlic")]
    assert p5.Page("").titles == {} and p5.Page("one line").numbers == set()
    assert p5.is_page_number("पृ. 21") and p5.is_page_number("[२३]") and not p5.is_page_number("12 boxes") and not p5.is_page_number("57344")


def test_p5_pages_of_two_lines(spark):
    assert p5.Page("the farmer of the village shared the ledger.\n— 101 —").numbers == {1}
    assert p5.Page("12\n\nthe farmer of the village shared the ledger.").numbers == {0}
    assert p5.Page("Hill Courier    Page 78\nthe farmer of the village shared the ledger.").titles == {0: ("hill courier", True)}
    assert p5.Page("Hill Courier\nthe farmer of the village shared the ledger.").titles == {0: ("hill courier", False)}
    rows = [("p", n, f"Hill Courier\nthe farmer number {n} of the village shared the ledger.") for n in range(3)] + [("p", 9, "My entry\nis what stands here, only once and with its meaning.")]
    df = spark.createDataFrame(rows, "tbl string, id long, text string").withColumn("page", F.lit(True))
    assert {(r["id"], r["line_no"], r["kind"]) for r in p5.find_noise(df, df.select("text", "page")).collect()} == {(n, 0, "header") for n in range(3)}


def test_p5_noise(spark):
    clean = "the teacher read the ledger and the farmer kept the letter of the school"
    rows = [("m", i, clean) for i in range(60)]
    words = ["teacher", "ledger", "farmer", "letter", "kept", "the"]
    for n, w in enumerate(words):
        rows.append(("p", 100 + n, "Hill Courier\n" + clean + "\n" + clean.replace(w, w.replace("e", "c", 1), 1) + "\n" + clean + " scho-\nol is old.\n[12]"))
    rows += [("p", 900, None), ("p", 901, ""), ("p", 902, "y\n" * 3000)]
    df = spark.createDataFrame(rows, "tbl string, id long, text string").withColumn("page", F.col("text").contains("\n"))
    got = p5.find_noise(df.where("page"), df.select("text", "page")).collect()
    assert {(r["id"], r["line_no"]) for r in got if r["kind"] == "header"} == {(100 + n, 0) for n in range(6)}
    assert {(r["id"], r["line_no"]) for r in got if r["kind"] == "page_number"} == {(100 + n, 5) for n in range(6)}
    assert {(r["id"], r["line_no"]) for r in got if r["kind"] == "hyphen"} == {(100 + n, 3) for n in range(6)}
    assert {(r["id"], r["line_no"], r["variant"]) for r in got if r["kind"] == "misread" and r["id"] < 105} == {(100 + n, 2, w) for n, w in enumerate(words[:5])}
    noise = [r.asDict() for r in got if r["id"] == 100]
    assert p5.rebuild(rows[60][2], noise).startswith(clean + " " + clean) and "Courier" not in p5.rebuild(rows[60][2], noise)


def _wide(first, k):
    body = "\n".join(f"line {w} of a page that speaks of {k} things" for w in ("one", "two", "three"))
    return first + "\n" + body + "\nand ends here."


def test_p5_a_title_recurs_on_different_pages(spark):
    copied, evaluated, title = "because schoolhouse roofs were leaking", "since teachers considered letters", "the valley courier and newspaper"
    rows = [("m", i, "s1", _wide(copied, "copied")) for i in range(5)]
    rows += [("e", i, "s2", _wide(evaluated, f"read{i}")) for i in range(5)]
    rows += [("m", 10 + i, f"t{i}", _wide(copied, "copied")) for i in range(3)]
    rows += [("m", 20 + i, f"u{i}", _wide(title, f"other{i}")) for i in range(2)]
    df = spark.createDataFrame(rows, "tbl string, id long, sample string, text string").withColumn("page", F.lit(True))
    got = p5.find_noise(df, df.select("text", "page")).where("kind = 'header'").collect()
    assert {(r["tbl"], r["id"], r["line_no"]) for r in got} == {("m", 20, 0), ("m", 21, 0)}


def test_p5_titles_needed_grow_with_the_pages(spark):
    rows = [("m", i, f"s{i}", _wide("by chance schoolhouse roofs leaked" if i < 2 else "the valley courier and newspaper" if i < 10 else f"{i} is how this page begins here", f"t{i}")) for i in range(6000)]
    df = spark.createDataFrame(rows, "tbl string, id long, sample string, text string").withColumn("page", F.lit(True))
    got = p5.find_noise(df, df.select("text", "page")).where("kind = 'header'").collect()
    assert {r["id"] for r in got} == set(range(2, 10))


def test_p5_copies_are_no_evidence(spark):
    clean = "the teacher read the ledger and the farmer kept the letter of the school"
    rows = [("m", i, f"{clean} {i}") for i in range(60)]
    words = ["teacher", "ledger", "farmer", "letter", "kept", "the"]
    for n, w in enumerate(words):
        page = "\n".join([clean, clean.replace(w, w.replace("e", "c", 1), 1), clean + " is old."])
        rows += [("p", 1000 * n + k, page) for k in range(1 if n else 200)]
    df = spark.createDataFrame(rows, "tbl string, id long, text string").withColumn("page", F.col("text").contains("\n"))
    got = p5.find_noise(df.where("page"), df.select("text", "page")).where("kind = 'misread'").collect()
    assert {(r["id"], r["line_no"], r["variant"]) for r in got} == {(1000 * n + k, 1, w) for n, w in enumerate(words) for k in range(1 if n else 200)}


def test_p5_lines_of_rejected_titles_are_body(spark):
    clean = "the teacher read the ledger and the farmer kept the letter of the school"
    rows = [("m", i, f"{clean} {i}") for i in range(60)]
    words = ["teacher", "ledger", "farmer", "letter"]
    for n, w in enumerate(words):
        rows.append(("p", 100 + n, "\n".join(["governmental " + w.replace("e", "c", 1) + " considerations everywhere nowadays", clean, clean + " is old."])))
    rows.append(("p", 200, "\n".join([clean, clean, "and it is for the letter of the govern-", "ments considered unconditionally everywhere nowadays"])))
    df = spark.createDataFrame(rows, "tbl string, id long, text string").withColumn("page", F.col("text").contains("\n"))
    assert p5.Page(rows[60][2]).unsure() == [0] and p5.Page(rows[-1][2]).unsure() == [3]
    got = p5.find_noise(df.where("page"), df.select("text", "page")).collect()
    wanted = {(100 + n, 0, "misread", w) for n, w in enumerate(words)} | {(200, 2, "hyphen", "governments")}
    assert {(r["id"], r["line_no"], r["kind"], r["variant"]) for r in got} == wanted


# 6 -------------------------------------------------------------------------


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _edit(rng, t, n):
    b = list(t)
    for _ in range(n):
        i, o = rng.randrange(len(b) + 1), rng.random()
        if o < 0.4:
            b[i % len(b)] = rng.choice("abc")
        elif o < 0.7:
            b.insert(i, rng.choice("abc"))
        elif len(b) > 1:
            del b[i % len(b)]
    return "".join(b)


@pytest.mark.parametrize("alphabet", ["ab ", "abcdefgh "])
def test_p6_segment_join_is_complete(alphabet):
    rng = random.Random(len(alphabet))
    held = ["".join(rng.choice(alphabet) for _ in range(rng.randint(9, 200))) for _ in range(120)]
    train = [_edit(rng, t, rng.randint(0, int(len(t) * 0.13) + 1)) for t in held]
    train = [t for t in train if len(t) >= 9]
    got = {(i, j): d for i, j, d in p6.Block(held).match(train)}
    wanted = {(i, j): d for i, a in enumerate(held) for j, b in enumerate(train) if abs(len(a) - len(b)) <= max(len(a), len(b)) // 10 and (d := _distance(a, b)) <= max(len(a), len(b)) // 10}
    assert got == wanted


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "कखगघ ङ"])
def test_p6_long_texts_are_cut_piecewise(alphabet):
    rng = random.Random(len(alphabet))
    held = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1100, 2600))) for _ in range(6)]
    train = [_edit(rng, t, len(t) // 12) for t in held] + ["".join(rng.choice(alphabet) for _ in range(1500))]
    for others in (None, train, held[:1]):  # what the segments are chosen by does not alter what is found
        got = {(i, j) for i, j, _ in p6.Block(held, others).match(train)}
        assert {(i, i) for i in range(6)} <= got


def test_p6_like_texts_are_told_apart_before_they_are_aligned():
    held = ["ab " * 20 + "cd " * 10, "the book of the village was brought here two days later"]
    train = ["ab " * 10 + "cd " * 20, held[1][:30] + held[1][32:]]
    t, e = p6.Block(held, train).partners(train)
    assert list(zip(t.tolist(), e.tolist(), strict=True)) == [(1, 1)]


def test_p6_texts_of_few_patterns_are_complete():
    rng = random.Random(6)
    opening, end = ("the old ", "the new ", "a small "), (" was read aloud by the teacher", " was brought from the village", " was lost two days later")
    word = ("book", "letter", "map of the river", "list")
    held, train = ([rng.choice(opening) + rng.choice(word) + rng.choice((" ", " and a ")) + rng.choice(word) + rng.choice(end) + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 5))) for _ in range(150)] for _ in range(2))
    train += [_edit(rng, t, rng.randint(0, len(t) // 9)) for t in held]
    got = {(i, j): d for i, j, d in p6.Block(held, train).match(train)}
    assert got == {(i, j): d for i, a in enumerate(held) for j, b in enumerate(train) if abs(len(a) - len(b)) <= (k := max(len(a), len(b)) // 10) and (d := int(p6.within([a], [b], np.array([k]))[0])) >= 0}
    assert len(got) > 300


def test_p6_counts_of_characters_bound_the_edits():
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    edits = [rng.randint(0, 12) for _ in texts]
    a, b = (p6._counts(flat, lengths, 256) for flat, _, lengths in map(p6._codes, (texts, [_edit(rng, t, n) for t, n in zip(texts, edits, strict=True)])))
    assert (np.bitwise_count(a ^ b).sum(1) <= 2 * np.array(edits)).all()


def test_p6_rarest_segments_are_disjoint_and_cheapest():
    rng = np.random.RandomState(0)
    cost = rng.randint(1, 9, (9, 5)).astype(np.float32)
    weights = np.array([1, 3, 1], dtype=np.float32)
    got = p6.rarest(cost, 3, 2, weights)
    assert (np.diff(got, axis=1) >= 2).all()
    for n in range(5):
        best = min(sum(w * cost[i, n] for w, i in zip(weights, c, strict=True)) for c in itertools.combinations(range(9), 3) if c[1] - c[0] >= 2 and c[2] - c[1] >= 2)
        assert sum(w * cost[i, n] for w, i in zip(weights, got[n], strict=True)) == best


@pytest.mark.parametrize("queries", [1, 300, 10**6])
def test_p6_blocks_cover_all_pairs_in_reach(queries):
    rng = random.Random(queries)
    held, train = ({(z, rng.randint(9, 400)): rng.randint(1, 5) for z in "DL" for _ in range(40)} for _ in range(2))
    e, t, cells = p6.plan_blocks(held, train, queries, 500)
    assert len({(z, n) for z, n, *_ in e}) == len(e)
    first = {(z, n): f for z, n, f, _, _ in e}
    visits = {(z, n, f) for z, n, f, _, _ in t}
    for z, a in held:
        for y, b in train:
            if z == y and abs(a - b) <= max(a, b) // 10:
                assert (y, b, first[z, a]) in visits
    assert all(f + s * p <= cells for _, _, f, s, p in e + t)


def test_p6_banded_distance():
    rng = random.Random(5)
    a = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    b = [_edit(rng, t, rng.randint(0, 6)) for t in a]
    k = np.array([rng.randint(0, 6) for _ in a])
    assert p6.within(a, b, k).tolist() == [d if (d := _distance(x, y)) <= m else -1 for x, y, m in zip(a, b, k, strict=True)]


def test_p6_rows(spark):
    t = "the farmer of the village shared the ledger with every teacher"
    h = "ab" * 32
    rows = [(1, t, False, h), (2, t.replace("farmer", "fаrmer"), True, None), (3, t.replace("ledger", "ledge"), True, None), (4, "", True, h), (5, None, False, None), (6, t[:20], True, None), (7, t, True, None), (8, t, None, h), (9, "short", True, None), (10, "short", False, None)]
    df = spark.createDataFrame(rows, "id long, text string, held_out boolean, image string").withColumn("form", F.lit("clash"))
    got = {(r["held"], r["train"]): r["distance"] for r in p6.find_overlaps(df).collect()}
    assert got == {(2, 1): 0, (3, 1): 1, (7, 1): 0, (4, 1): None, (9, 10): 0}
    assert p6.find_overlaps(df.limit(0)).count() == 0


def test_p6_image_hash(spark):
    df = spark.createDataFrame([("AB" * 32,), ("sha256:" + "ab" * 32,), (" " + "ab" * 32,), ("",), (None,), ("n/a",)], "h string")
    assert [r[0] for r in df.select(p6.image_hash(F.col("h"))).collect()] == ["ab" * 32] * 3 + [None] * 3


# 7 -------------------------------------------------------------------------

FONT = "bêkê gôjê véd q~wôöb~rabôîp nu±maÁ".split()


@pytest.mark.parametrize(("stored", "read"), [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("mac_roman", "latin-1"), ("utf-16-le", "utf-16-be")])
def test_p7_round_trip(stored, read):
    text = "bêkê gôjê véd q~wôöb~rabôîp caç[afa liy~wê rôåg"
    garbled = text.encode(stored).decode(read, "replace")
    spans, back = p7.repairer(p7.FONT_LETTERS).restore(garbled)
    assert spans and back == text


def test_p7_mixed_and_twice():
    fix = p7.repairer(p7.FONT_LETTERS)
    twice = "bêkê véd".encode().decode("cp1252").encode().decode("cp1252")
    assert fix.restore(twice)[1] == "bêkê véd"
    part = "bêkê " + "véd gôjê".encode().decode("latin-1") + " ₹47 – xômq"
    assert fix.restore(part)[1] == "bêkê véd gôjê ₹47 – xômq"
    assert fix.restore("b�k�")[0] and fix.restore("b�k")[1] == "b�k"


@pytest.mark.parametrize("sound", ["", "bêkê gôjê véd\\", "“véd liy~wê bêkê?”", "± 424 mm bêkê", "16 ° • véd – †", "ᤓᤥᤍᤥ ᤒᤡᤈ ।", "कवि का कहना", "varṇamālā ajhai sthānīy", "Größe 500 ½ À"])
def test_p7_sound_text_is_left_alone(sound):
    assert p7.repairer(p7.FONT_LETTERS).restore(sound) == ([], sound)


def test_p7_frame(spark):
    df = spark.createDataFrame([(1, "bÃªkÃª"), (2, None), (3, ""), (1, "bÃªkÃª")], "id long, t string").withColumn("spans", F.lit("clash"))
    assert [(r["id"], r["restored"], r["whole"]) for r in p7.find_garbled(df, "id", "t").collect()] == [(1, "bêkê", True)] * 2
    assert p7.find_garbled(df.limit(0), "id", "t").count() == 0


# 8 -------------------------------------------------------------------------

HARD = ["", "a", " ", "  a  b ", "a\n\n b", "don't  stop", "x" * 3000, "नेपालको कथा " * 300, "1234567890" * 100, "\u0085a　b", "<|endoftext|> x", " \t\n", "é‍👩‍👩‍👧 ok", "a " * 2000]


def test_p8_ids_and_round_trip(spark):
    rng = random.Random(8)
    texts = [*HARD, *["".join(rng.choice("ab1 \n.नी ") for _ in range(rng.randint(1, 900))) for _ in range(60)], None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1))
    enc = p8.encoding(p8.tokenizer_path())
    for chunk in (8192, 64):
        ids = p8.encode(df, "doc_id", "text", chunk=chunk, overlap=16)
        got = {r["doc_id"]: r["ids"] for r in ids.collect()}
        assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in p8.decode(ids, "doc_id", "ids").collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tok"] for r in p8.count_tokens(df.select("doc_id", "text"), "text").collect()} == {i: len(x) for i, x in got.items()}
    assert p8.encode(df.limit(0), "doc_id", "text").count() == 0


def test_p8_stitch_without_a_common_boundary():
    assert p8.stitch([([0, 5], [1, 1], [7, 8]), ([3, 9], [1, 1], [1, 2])]) is None


# 9 -------------------------------------------------------------------------

TARGET = "source string, weight double, cap int"


def test_p9_shares_caps_and_shortfalls(spark):
    docs = spark.createDataFrame([(i, ("big", "mid", "small", None)[i % 4 if i < 2000 else 0], 20 + i % 90) for i in range(4000)] + [(9999, "small", 0)], "id long, source string, n_tok long").withColumn("lam", F.lit(1))
    targets = spark.createDataFrame([("big", 0.3, 2), ("mid", 0.25, 4), ("small", 0.4, 3), ("lost", 0.05, 2)], TARGET)
    copies, report = p9.mix_to_weights(docs, targets)
    got = {r["source"]: r for r in report.collect()}
    assert {s for s in got if got[s]["short"]} == {"small", "lost"}
    assert got["big"]["actual_tokens"] == pytest.approx(got["big"]["target_tokens"], rel=0.05) and got["mid"]["actual_tokens"] == pytest.approx(got["mid"]["target_tokens"], rel=0.05)
    assert got["small"]["actual_tokens"] == got["small"]["capacity_tokens"] and got["lost"]["actual_tokens"] == 0
    most = {r["source"]: r["m"] for r in copies.groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert most["big"] <= 2 and most["mid"] <= 4 and most["small"] == 3


def test_p9_rates_meet_the_dual(spark):
    hist = spark.createDataFrame([("a", 100, 50), ("a", 1000, 20), ("b", 10, 5)], "source string, n_tok long, n long")
    lam = p9.solve_rates(hist, {"a": (9000.0, 3.0), "b": (500.0, 2.0)})
    total = sum(n * t * min(3.0, np.exp(lam["a"] * t / p9.SCALE)) for t, n in ((100, 50), (1000, 20)))
    assert total == pytest.approx(9000, rel=1e-3) and lam["b"] is None


def test_p9_empty(spark):
    _, report = p9.mix_to_weights(spark.createDataFrame([], "id long, source string, n_tok long"), spark.createDataFrame([("a", 1.0, 2)], TARGET))
    assert not report.first()["short"] and report.first()["actual_tokens"] == 0


# 10 ------------------------------------------------------------------------


def _reviewed(n, seed):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice(["ka", "ti", "mo", "ru", "pe"]) for _ in range(3)) + "gaun"
    plain = ["the teacher of {} read the old ledger", "in {} many people met the printer", "the map of {} was printed last week"]
    bad = ["you stupid worthless pig of {} go rot", "hot wives of {} strip nude tonight", "those people of {} are vermin and must be driven out"]
    hard = ["the court of {} fined the man who called the clerk a stupid worthless pig", "a poster in {} teaches that no people are vermin"]
    out = []
    for i in range(n):
        kind = ("bad", "clean", "hard", "clean")[i % 4]
        s = [rng.choice(plain).format(name()) for _ in range(5)]
        if kind != "clean":
            s.insert(rng.randrange(5), rng.choice(bad if kind == "bad" else hard).format(name()))
        out.append((". ".join(s) + ".", kind == "bad"))
    return out


def test_p10_held_out():
    rows = _reviewed(400, 1)
    texts = [t for t, _ in rows]
    grades = [[2 if b else 0] for _, b in rows]
    grades[4], grades[5] = [0], [2]  # wrong ratings
    held = p10.candidates(texts, grades)
    w = p10.Words()
    sets = [set().union(*map(p10.features, w.sentences(t))) for t in texts]
    model = p10.fit(texts, grades, 4000, {f: sum(f in s for s in sets) for f in held})
    severity = lambda t: 0.0 if (z := model.worst(w.sentences(t))) is None else model.severity(z)
    got = [(severity(t) >= p10.FOUND_AT, b) for t, b in _reviewed(200, 2)]
    assert sum(a == b for a, b in got) / len(got) > 0.97
    hidden = "the map was printed. y0u stuuupid w.o.r.t.h.l.e.s.s p*g of katigaun go rot."
    assert severity(hidden) > severity("the map of katigaun was printed.")
    assert severity("") == 0.0 and severity("   ") == 0.0


def test_p10_one_spelling():
    w = p10.Words()
    assert w.one("फोहोर") == w.one("phohora") or w.one("फोहोर") == "phohor"
    assert w.one("𑒏𑒢") == w.one("कन") == "kan"
    assert w.one("n*ालायक") and w.one("sh1t") == "shit" and w.one("nuuuude") == "nude"


def test_p10_frame(spark):
    df = spark.createDataFrame([(1, "a", "you stupid pig"), (2, None, None), (3, "b", "")], "doc_id long, source string, text string")
    model = p10.Model({"stupid": 5.0}, (2.0, 3.0), {"stupid"})
    got = {r["doc_id"]: r["severity"] for r in p10.score(df, "doc_id", "text", model).collect()}
    assert got[1] > 1.5 and got[2] == got[3] == 0.0
    assert p10.score(df.limit(0), "doc_id", "text", model).count() == 0
    none = p10.learn(df, spark.createDataFrame([], "doc_id long, rating string"))
    assert p10.score(df, "doc_id", "text", none).agg(F.max("severity")).first()[0] == 0.0
