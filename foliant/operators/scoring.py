"""Scores of recognised documents against references: graphemes, tables, figures, reading order, whole documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.geometry import iou_py
from foliant.functions.text import cer, let, normalize_py, token_distance, wer
from foliant.operators.layout import concordant_pairs

#: A cell of a table: row, column, rowspan, colspan, text.
Cell = tuple[int, int, int, int, str]
CELLS = "array<struct<row:int,col:int,rowspan:int,colspan:int,text:string>>"
FIGURES = "array<struct<page:int,x:double,y:double,w:double,h:double,caption:string,line_ids:array<string>>>"

def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


_TABLE = _doubles("precision", "recall", "f1", "exact", "structure", "tree", "tree_text")

# From which on a figure's box or caption tells its partner, and the score of a shared line.
FIGURE_IOU, CAPTION_CER, SHARED_LINE = 0.5, 0.25, 0.75


def alignment(a: Sequence, b: Sequence, drop: Callable, change: Callable) -> int:
    """Least cost of an ordered alignment: ``drop(x)`` for an item without a partner, ``change(x, y)`` for a pair."""
    row = [0]
    for y in b:
        row.append(row[-1] + drop(y))
    for x in a:
        last, row[0] = row[0], row[0] + drop(x)
        for j, y in enumerate(b):
            best = min(last + change(x, y), row[j + 1] + drop(x), row[j] + drop(y))
            last, row[j + 1] = row[j + 1], best
    return row[-1]


def table_rows(cells: Sequence[Cell], with_text: bool) -> list[list[tuple]]:
    """The cells of each row from left to right as what tells them apart: their spans, and their text if asked."""
    rows: list[list] = [[] for _ in range(max((c[0] + c[2] for c in cells), default=0))]
    for c in sorted(cells, key=lambda c: c[1]):
        rows[c[0]].append((c[2], c[3], normalize_py(c[4]) if with_text else ""))
    return rows


def table_distance(a: list[list[tuple]], b: list[list[tuple]]) -> int:
    """Rows are aligned with each other and, within a pair of rows, cells: a cell costs 1, a row 1 and its cells."""
    return alignment(a, b, lambda r: 1 + len(r), lambda r, s: alignment(r, s, lambda _: 1, lambda x, y: int(x != y)))


def table_similarity(predicted: Sequence[Cell], reference: Sequence[Cell], with_text: bool) -> float:
    a, b = table_rows(predicted, with_text), table_rows(reference, with_text)
    return 1 - table_distance(a, b) / (1 + max(sum(1 + len(r) for r in t) for t in (a, b)))


def structure_tokens(cells: Sequence[Cell]) -> list[tuple]:
    """Number of rows and of columns, then place and spans of the cells that hold text."""
    if not cells:
        return []
    held = sorted((c[:4] for c in cells if normalize_py(c[4])))
    return [("rows", max(c[0] + c[2] for c in cells)), ("cols", max(c[1] + c[3] for c in cells)), *held]


def structure_similarity(predicted: Sequence[Cell], reference: Sequence[Cell]) -> float:
    a, b = structure_tokens(predicted), structure_tokens(reference)
    return max(0.0, 1 - token_distance(a, b) / len(b)) if b else float(not a)


def cell_signature(cells: Sequence[Cell]) -> list[Cell]:
    return sorted((*c[:4], normalize_py(c[4])) for c in cells)


def cell_bag(cells: Sequence[Cell]) -> Counter:
    """Place and text of every place of the grid; a place without a cell is empty, a later cell wins."""
    if not cells:
        return Counter()
    height, width = max(c[0] for c in cells) + 1, max(c[1] for c in cells) + 1
    grid = {(c[0], c[1]): normalize_py(c[4]) for c in cells}
    return Counter((i, j, grid.get((i, j), "")) for i in range(height) for j in range(width))


def bag_rates(matched: int, predicted: int, reference: int) -> tuple[float, float, float]:
    """Precision, recall and their harmonic mean; 1 where both sides are empty."""
    p = matched / predicted if predicted else float(not reference)
    r = matched / reference if reference else float(not predicted)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def cell_rates(predicted: Sequence[Cell], reference: Sequence[Cell]) -> tuple[float, float, float]:
    a, b = cell_bag(predicted), cell_bag(reference)
    return bag_rates((a & b).total(), a.total(), b.total())


def greedy_pairs(reference: Sequence, predicted: Sequence, score: Callable) -> list[tuple[int, int | None]]:
    """Each reference in turn takes the free prediction of the best score; the first of equals; none where the score is None."""
    free = list(range(len(predicted)))
    out = []
    for i, r in enumerate(reference):
        rated = [(s, -j) for j in free if (s := score(predicted[j], r)) is not None]
        best = -max(rated)[1] if rated else None
        if best is not None:
            free.remove(best)
        out.append((i, best))
    return out


def match_tables(predicted: Sequence[Sequence[Cell]], reference: Sequence[Sequence[Cell]]) -> list[tuple[int, int | None]]:
    """By similarity with text, then without, then by cells; a reference stays alone only when no table is left."""
    return greedy_pairs(reference, predicted, lambda p, r: (table_similarity(p, r, True), table_similarity(p, r, False), cell_rates(p, r)[2]))


def match_figures(predicted: Sequence[dict], reference: Sequence[dict]) -> list[tuple[int, int | None]]:
    """On one page, by box, else by caption, else by a shared line."""
    def score(p: dict, r: dict) -> float | None:
        if p["page"] != r["page"]:
            return None
        if r["w"] is not None and (iou := iou_py(*[(f["x"], f["y"], f["w"], f["h"]) for f in (p, r)])) >= FIGURE_IOU:
            return iou
        if r["caption"] and p["caption"] and (e := text_error(p["caption"], r["caption"])) <= CAPTION_CER:
            return 1 - e
        return SHARED_LINE if set(r["line_ids"] if r["line_ids"] is not None else ()) & set(p["line_ids"] if p["line_ids"] is not None else ()) else None

    return greedy_pairs(reference, predicted, score)


def text_error(prediction: str, reference: str) -> float:
    """Character error rate of short texts in normal form."""
    p, r = normalize_py(prediction), normalize_py(reference)
    return token_distance(p, r) / len(r) if r else float(bool(p))


def order_rate(predicted: Sequence[str], reference: Sequence[str]) -> float:
    """Share of the pairs of the reference that stand in its order in the prediction; a pair that lacks an item does not."""
    n = len(reference)
    if n < 2:
        return 1.0
    place = {x: i for i, x in enumerate(predicted)}
    return concordant_pairs([place[x] for x in reference if x in place]) / (n * (n - 1) / 2)


def _cells(value) -> list[Cell]:
    return [(c["row"], c["col"], c["rowspan"], c["colspan"], c["text"] or "") for c in value] if value is not None else []


@F.pandas_udf(_TABLE)
def table_scores(predicted: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Scores of the cells of one table (type CELLS) against another's; null counts as a table without cells."""
    out = []
    for p, r in zip(predicted, reference, strict=True):
        p, r = _cells(p), _cells(r)
        out.append((*cell_rates(p, r), float(cell_signature(p) == cell_signature(r)), structure_similarity(p, r), table_similarity(p, r, False), table_similarity(p, r, True)))
    return pd.DataFrame(out, columns=_TABLE.names)


@F.pandas_udf(_TABLE)
def document_table_scores(predicted: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Means over the reference tables (arrays of CELLS), each with its partner; null without reference tables."""
    out = []
    for p, r in zip(predicted, reference, strict=True):
        ps, rs = [_cells(t) for t in (p if p is not None else [])], [_cells(t) for t in (r if r is not None else [])]
        rows = []
        for i, j in match_tables(ps, rs):
            a, b = ps[j] if j is not None else [], rs[i]
            rows.append((*cell_rates(a, b), float(cell_signature(a) == cell_signature(b)), structure_similarity(a, b), table_similarity(a, b, False), table_similarity(a, b, True)))
        out.append([sum(x) / len(rows) for x in zip(*rows, strict=True)] if rows else [None] * len(_TABLE))
    return pd.DataFrame(out, columns=_TABLE.names, dtype="float64")


@F.pandas_udf(_doubles("precision", "recall", "f1", "caption_cer"))
def figure_scores(predicted: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Detection rates of figures and the mean error of the matched captions; null where there is nothing to rate."""
    out = []
    for p, r in zip(predicted, reference, strict=True):
        p, r = (list(x) if x is not None else [] for x in (p, r))
        pairs = [(p[j], r[i]) for i, j in match_figures(p, r) if j is not None]
        errors = [text_error(a["caption"] or "", b["caption"]) for a, b in pairs if b["caption"] is not None]
        out.append((*(bag_rates(len(pairs), len(p), len(r)) if r else [None] * 3), sum(errors) / len(errors) if errors else None))
    return pd.DataFrame(out, columns=["precision", "recall", "f1", "caption_cer"], dtype="float64")


@F.pandas_udf(T.DoubleType())
def order_scores(predicted: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([order_rate(list(p) if p is not None else [], list(r)) if r is not None else None for p, r in zip(predicted, reference, strict=True)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("edits", T.LongType()), T.StructField("n_reference", T.LongType())]))
def grapheme_edits(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Edits and length over extended grapheme clusters in NFC; null counts as empty."""
    from unicodedata import normalize

    import regex

    def one(p: str | None, r: str | None) -> tuple[int, int]:
        a, b = (regex.findall(r"\X", normalize("NFC", t or "")) for t in (p, r))
        return cluster_distance(a, b), len(b)

    return pd.DataFrame([one(p, r) for p, r in zip(prediction, reference, strict=True)], columns=["edits", "n_reference"])


def cluster_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences, bit-parallel (Hyyrö): a whole column is one integer."""
    if not a:
        return len(b)
    at: dict = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    vp, vn, score = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
        score += bool(hp & top) - bool(hn & top)
        hp, hn = hp << 1 | 1, hn << 1
        vp, vn = (hn | ~(d0 | hp)) & full, hp & d0 & full
    return score


def score_documents(predicted: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """(key, metrics): the map of all metrics for which a document's reference holds what they need.

    predicted: key, text, markdown, reading_order (ids), tables (array of CELLS), figures (FIGURES).
    reference: the same columns, null where the reference lacks the field. One row for each key on
    either side; a reference without a prediction is scored against nothing. Texts are trimmed.
    The reconstruction similarity is the least of its components.
    """
    p, r = predicted.alias("p"), reference.alias("r")
    joined = r.join(p, F.col(f"r.{key}") == F.col(f"p.{key}"), "left")
    text = {s: F.trim(F.coalesce(F.col(f"{s}.text"), F.lit(""))) for s in "pr"}
    mark = {s: F.trim(F.coalesce(F.col(f"{s}.markdown"), F.lit(""))) for s in "pr"}
    has_tables, has_figures, has_order = (F.coalesce(F.size(F.col(f"r.{c}")) > 0, F.lit(False)) for c in ("tables", "figures", "reading_order"))
    # Python sees only the documents whose reference holds the field
    got = joined.select(
        F.col(f"r.{key}").alias(key), F.col("r.text").isNotNull().alias("has_text"), F.col("r.markdown").isNotNull().alias("has_markdown"),
        cer(text["p"], text["r"]).alias("cer"), wer(text["p"], text["r"]).alias("wer"), cer(mark["p"], mark["r"]).alias("m_cer"), wer(mark["p"], mark["r"]).alias("m_wer"),
        F.when(has_order, order_scores(F.col("p.reading_order"), F.col("r.reading_order"))).alias("order"),
        F.when(has_tables, document_table_scores(F.col("p.tables"), F.col("r.tables"))).alias("t"),
        F.when(has_figures, figure_scores(F.col("p.figures"), F.col("r.figures"))).alias("f"))

    def all_metrics(v: Column) -> Column:
        similar = F.when(v["has_markdown"], F.greatest(F.lit(0.0), 1 - v["m_cer"]))
        t, f = v["t"], v["f"]
        whole = F.when(v["has_markdown"], F.least(similar, v["order"], F.least(t["f1"], t["tree_text"]), f["f1"], F.greatest(F.lit(0.0), 1 - f["caption_cer"])))
        metrics: dict[str, Column] = {
            "cer": F.when(v["has_text"], v["cer"]), "wer": F.when(v["has_text"], v["wer"]), "reading_order_pair_accuracy": v["order"],
            "document_reconstruction_cer": F.when(v["has_markdown"], v["m_cer"]), "document_reconstruction_wer": F.when(v["has_markdown"], v["m_wer"]),
            "document_reconstruction_text_similarity": similar, "document_reconstruction_similarity": whole,
            "table_cell_precision": t["precision"], "table_cell_recall": t["recall"], "table_cell_f1": t["f1"], "table_exact_match": t["exact"],
            "table_structure_similarity": t["structure"], "table_teds_structure": t["tree"], "table_teds_text": t["tree_text"],
            "figure_detection_precision": f["precision"], "figure_detection_recall": f["recall"], "figure_detection_f1": f["f1"], "figure_caption_cer": f["caption_cer"]}
        entries = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in metrics.items()])
        return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))

    # every score is computed once, however often the metrics name it
    return got.select(key, let(F.struct(*[c for c in got.columns if c != key]), all_metrics).alias("metrics"))


def cell_comparison(reference: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """Per cell of the reference: whether it is missing, exact, and its error rate. Cells are keyed by ``key`` (table and place), text."""
    r, p = reference.select(*key, F.col("text").alias("expected")), predicted.select(*key, F.col("text").alias("got"), F.lit(True).alias("is_there"))
    j = r.join(p, key, "left")
    return j.select(*key, F.col("is_there").isNull().alias("is_missing"), (F.col("got") == F.col("expected")).eqNullSafe(True).alias("is_exact"), cer(F.coalesce("got", F.lit("")), F.coalesce("expected", F.lit(""))).alias("cer"))


def cell_summary(compared: DataFrame, by: list[str]) -> DataFrame:
    return compared.groupBy(*by).agg(F.count("*").alias("n_cells"), F.count_if("is_missing").alias("n_missing"), F.count_if("is_exact").alias("n_exact"), F.avg("cer").alias("mean_cer"))
