"""Queries on document scores, reading orders and outputs of several systems, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import composite as C
from foliant.operators import layout as L
from foliant.operators import orders as O
from foliant.operators import scoring as S
from foliant.operators import tables as B
from foliant.plans.registry import query
from foliant.runtime import read_table


@query()
def q_grapheme_cer(spark, sf_dir):
    """Edits and length over grapheme clusters of every page."""
    e = read_table(spark, sf_dir, "page_eval").select("eval_id", S.grapheme_edits("prediction_text", "reference_text").alias("g"))
    return e.select("eval_id", "g.edits", "g.n_reference", (F.col("g.edits") / F.greatest(F.col("g.n_reference"), F.lit(1))).alias("cer"))


@query()
def q_micro_graphemes(spark, sf_dir):
    """Micro grapheme rate by system: sums are combined before the shuffle."""
    e = read_table(spark, sf_dir, "page_eval").select("ocr_output_kind", S.grapheme_edits("prediction_text", "reference_text").alias("g"))
    return e.groupBy("ocr_output_kind").agg(F.count("*").alias("n_pages"), F.sum("g.edits").alias("edits"), F.sum("g.n_reference").alias("n_reference"), (F.sum("g.edits") / F.greatest(F.sum("g.n_reference"), F.lit(1))).alias("cer"))


def _grids(spark, sf_dir):
    """The table lines of each document as cells with spans of one, rows counted from 0; bounded by the document."""
    d = read_table(spark, sf_dir, "documents").where("text is not null")
    rows = F.filter(F.split("text", "\n"), lambda t: (F.trim(t) != "") & X.looks_like_table_line(t) & ~t.rlike(r"^[\s|:\-+]+$"))
    cell = lambda r, c, t: F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), t.alias("text"))
    cells = F.flatten(F.transform(rows, lambda line, i: F.transform(X.split_row(line), lambda t, j: cell(i, j, t))))
    return d.select("doc_id", cells.alias("cells")).where("size(cells) > 0")


@query()
def q_table_scores(spark, sf_dir):
    """Scores of each document's table against the same without its last column."""
    g = _grids(spark, sf_dir)
    last = F.array_max(F.transform("cells", lambda c: c["col"]))
    return g.select("doc_id", S.table_scores(F.filter("cells", lambda c: c["col"] < last), F.col("cells")).alias("s")).select("doc_id", "s.*")


@query(r"""
with l0 as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as n from documents where text is not null),
l as (select doc_id, n, t from l0 where trim(t, ' ') <> '' and (contains(t, chr(9)) or regexp_matches(t, '^\s*\|.*\|\s*$') or len(regexp_split_to_array(trim(t, ' '), ' {2,}')) >= 3) and not regexp_matches(t, '^[\s|:\-+]+$')),
c as (select doc_id, n, case when contains(t, chr(9)) then list_transform(string_split(t, chr(9)), lambda x: trim(x, ' ')) when contains(t, '|') then list_transform(list_filter(string_split(t, '|'), lambda x: trim(x, ' ') <> ''), lambda x: trim(x, ' ')) else regexp_split_to_array(trim(t, ' '), ' {2,}') end as cells from l),
d as (select doc_id, count(*)::int as n_rows, max(len(cells)) as n_cols, sum(len(cells))::bigint as n_cells, sum(len(list_filter(cells, lambda x: x <> '')))::bigint as n_held from c group by 1)
select doc_id, n_rows, n_cols::int as n_cols, n_cells, n_held from d where n_cells > 0
""")
def q_table_shapes(spark, sf_dir):
    """Rows, columns, cells and cells with text of each document's table."""
    g = _grids(spark, sf_dir)
    return g.select("doc_id", (F.array_max(F.transform("cells", lambda c: c["row"])) + 1).alias("n_rows"), (F.array_max(F.transform("cells", lambda c: c["col"])) + 1).alias("n_cols"),
                    F.size("cells").cast("long").alias("n_cells"), F.size(F.filter("cells", lambda c: c["text"] != "")).cast("long").alias("n_held"))


@query()
def q_document_scores(spark, sf_dir):
    """All metrics of each evaluated page as a document: text, order of the lines by their content, figures as marked."""
    e = read_table(spark, sf_dir, "page_eval")

    def side(c):
        lines = F.filter(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), lambda t: F.trim(t) != "")
        figure = lambda t, i: F.struct(F.lit(0).alias("page"), F.lit(0.0).alias("x"), (i * L.LINE_STEP).alias("y"), (F.length(t) * L.CHAR_WIDTH).alias("w"), F.lit(L.LINE_HEIGHT).alias("h"), t.alias("caption"), F.array(t).alias("line_ids"))
        placed = F.transform(lines, lambda t, i: F.struct(C.is_caption(t).alias("is_caption"), figure(t, i).alias("f")))
        return e.select(
            "eval_id", F.col(c).alias("text"), F.when(F.col(c).isNotNull(), F.array_join(lines, "\n\n")).alias("markdown"), lines.alias("reading_order"),
            F.lit(None).cast(f"array<{S.CELLS}>").alias("tables"), F.transform(F.filter(placed, lambda p: p["is_caption"]), lambda p: p["f"]).cast(S.FIGURES).alias("figures"))

    got = S.score_documents(side("prediction_text"), side("reference_text"), "eval_id")
    return got.select("eval_id", F.explode("metrics").alias("metric", "value"))


@query(r"""
with c as (select l_orderkey as t, l_linenumber as r, max(l_returnflag || l_linestatus) as x from lineitem group by 1, 2), p as (select t, r, x as p from c where r % 2 = 1), q as (select t, r, x as q from c)
select q.r::int as line, count(*) as n_cells, count_if(p.p is null) as n_missing, count(*) filter (where p.p = q.q) as n_exact from q left join p on p.t = q.t and p.r = q.r group by 1
""")
def q_cell_summary(spark, sf_dir):
    """Cells of a prediction that holds every other row of its reference, on the largest table."""
    li = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.concat("l_returnflag", "l_linestatus")).alias("text"))
    got = S.cell_comparison(li, li.where("l_linenumber % 2 = 1"), ["l_orderkey", "l_linenumber"])
    return S.cell_summary(got, ["l_linenumber"]).select(F.col("l_linenumber").cast("int").alias("line"), "n_cells", "n_missing", "n_exact")


_BOXES = r"""
with l0 as (select eval_id, unnest(string_split(reference_text, chr(10))) as text, generate_subscripts(string_split(reference_text, chr(10)), 1) - 1 as line_no from page_eval where reference_text is not null),
b as (select eval_id, line_no::int as line_no, (line_no % 2) * 1000.0 as x, (line_no // 2) * 28.0 as y, greatest(50.0, length(text) * 9.0)::double as w, 22.0 as h, 2000.0 as page_width from l0 where trim(text, ' ') <> '')
"""


def _boxes(spark, sf_dir):
    """The reference's lines set into two columns."""
    lines = L.text_lines(read_table(spark, sf_dir, "page_eval").where("reference_text is not null"), "eval_id", "reference_text")
    return lines.select("eval_id", "line_no", ((F.col("line_no") % 2) * 1000.0).alias("x"), (F.floor(F.col("line_no") / 2) * 28.0).alias("y"), "w", "h", F.lit(2000.0).alias("page_width"))


@query(_BOXES + """, c as (select eval_id, count(*) as n, count_if(x + w / 2 < 1000) as l, count_if(x + w / 2 >= 1000) as r, quantile_cont(x + w / 2, 0.5) filter (where x + w / 2 < 1000) as ml, quantile_cont(x + w / 2, 0.5) filter (where x + w / 2 >= 1000) as mr from b group by 1)
select eval_id, coalesce(n >= 8 and l >= 3 and r >= 3 and mr - ml >= 440, false) as is_two_column from c""")
def q_two_columns(spark, sf_dir):
    return O.two_columns(_boxes(spark, sf_dir), ["eval_id"], "page_width")


@query(_BOXES + """select eval_id, count(*) as n_lines, round(max(x + w / 2) - min(x + w / 2), 6) as x_span, quantile_cont(w, 0.5) as median_width, quantile_cont(w, 0.75) - quantile_cont(w, 0.25) as width_iqr from b group by 1""")
def q_layout_features(spark, sf_dir):
    got = O.layout_features(_boxes(spark, sf_dir), ["eval_id"], "page_width")
    return got.select("eval_id", "n_lines", F.round("x_span", 6).alias("x_span"), "median_width", "width_iqr")


def _order_sql(first: str, second: str, third: str) -> str:
    return _BOXES + f"select eval_id, line_no, row_number() over (partition by eval_id order by {first}, {second}, {third}, line_no) - 1 as position from b"


@query(_order_sql("case when x + w / 2 >= 1000 then 1 else 0 end", "y + h / 2", "x + w / 2"))
def q_order_columns(spark, sf_dir):
    return O.ordered(_boxes(spark, sf_dir), ["eval_id"], "columns_ltr", "page_width").select("eval_id", "line_no", F.col("position").cast("long").alias("position"))


@query(_order_sql("floor((y + h / 2) / 24.0)", "-(x + w / 2)", "y + h / 2"))
def q_order_rows_rtl(spark, sf_dir):
    return O.ordered(_boxes(spark, sf_dir), ["eval_id"], "rows_rtl", "page_width").select("eval_id", "line_no", F.col("position").cast("long").alias("position"))


@query(_order_sql("-floor((x + w / 2) / 900.0)", "y", "-x"))
def q_order_wide(spark, sf_dir):
    return O.ordered(_boxes(spark, sf_dir), ["eval_id"], "wide_rtl", "page_width").select("eval_id", "line_no", F.col("position").cast("long").alias("position"))


@query()
def q_order_anchored(spark, sf_dir):
    """Rows around the running mean of their tops: a map over pages, no shuffle."""
    e = read_table(spark, sf_dir, "page_eval").where("reference_text is not null")
    box = lambda t, i: F.struct(((i % 2) * 1000.0).alias("x"), (i * 10.0).alias("y"), (F.length(t) * 9.0).alias("w"), F.lit(22.0).alias("h"))
    return O.page_order(e.select("eval_id", F.transform(F.split("reference_text", "\n"), box).alias("boxes")), "eval_id", "boxes", "anchored_ltr", 2000.0)


@query(r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as t from documents where text is not null)
select doc_id, count_if(regexp_matches(t, '(?i)^\s*(?:\[(?:figure|chart|image|चित्र)[^\]]*\]|(?:figure|fig\.?|chart|चित्र)\s*[:：]?)')) as n_figures,
  count_if(regexp_matches(t, '(?i)^\s*(?:caption|figure|fig\.?|चित्र|तालिका)\s*[\s\d०-९IVXivx.-]*[:：]')) as n_captions from l group by 1
""")
def q_figure_markers(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").where("text is not null")
    lines = F.split("text", "\n")
    return d.select("doc_id", F.size(F.filter(lines, C.is_figure_marker)).cast("long").alias("n_figures"), F.size(F.filter(lines, C.is_caption)).cast("long").alias("n_captions"))


@query("""
with a as (select sample_id, eval_id, ocr_output_kind from page_eval where ocr_output_kind = 'recognizer_a'), b as (select sample_id, eval_id, ocr_output_kind from page_eval where ocr_output_kind = 'recognizer_b')
select * from a union all select * from b where sample_id not in (select sample_id from a)
""")
def q_backfill(spark, sf_dir):
    """Pages of one system, filled by another's where it has none."""
    e = read_table(spark, sf_dir, "page_eval").select("sample_id", "eval_id", "ocr_output_kind")
    a, b = (e.where(F.col("ocr_output_kind") == k) for k in ("recognizer_a", "recognizer_b"))
    return C.backfill(a, b, ["sample_id"])


@query("""
with r as (select sample_id, span_index, max(unicode_text) as n, max(replacement_count)::double as nc from limbu_conversion where conversion_id % 3 = 0 group by 1, 2),
j as (select c.conversion_id, c.unicode_text as o, c.limbu_char_count::double as oc, r.n, r.nc from limbu_conversion c left join r on r.sample_id = c.sample_id and r.span_index = c.span_index)
select conversion_id, case when n is null then 'no_reading' when trim(coalesce(o, ''), ' ') = '' then null when n = o then 'same_text' when nc is null then 'missing_replacement_confidence'
  when oc is null then 'missing_existing_confidence' when nc < oc + 1 then 'replacement_confidence_not_higher' end as reason from j
""")
def q_refine_cells(spark, sf_dir):
    """Texts after a second reading that replaces where its confidence is higher by one; why the others stay."""
    c = read_table(spark, sf_dir, "limbu_conversion")
    again = c.where("conversion_id % 3 = 0").groupBy("sample_id", "span_index").agg(F.max("unicode_text").alias("text"), F.max("replacement_count").cast("double").alias("confidence"))
    cells = c.select("conversion_id", "sample_id", "span_index", F.col("unicode_text").alias("text"), F.col("limbu_char_count").cast("double").alias("confidence"))
    spread = cells.select("conversion_id", "sample_id", "span_index").join(again, ["sample_id", "span_index"]).drop("sample_id", "span_index")
    return C.refine(cells.drop("sample_id", "span_index"), spread, ["conversion_id"], "confidence", 1.0).select("conversion_id", "reason")


@query("""
with s as (select sample_id, ocr_output_kind as system, eval_id, metrics['line_detection_f1'] + 0.25 * (case when script = 'Devanagari' then 1.0 else 0.0 end) as score, metrics['line_detection_f1'] as f from page_eval where isfinite(metrics['line_detection_f1']))
select sample_id, system from (select *, row_number() over (partition by sample_id order by -score, -f, eval_id) as rn from s) where rn = 1
""")
def q_route_lines(spark, sf_dir):
    """The system of each sample by detection score plus a share for the script."""
    e = read_table(spark, sf_dir, "page_eval").select("sample_id", F.col("ocr_output_kind").alias("system"), F.col("eval_id").alias("system_no"), F.lit("").alias("text"), F.col("metrics")["line_detection_f1"].alias("confidence"), "script")
    e = e.where(F.col("confidence").isNotNull() & ~F.isnan("confidence") & (F.abs("confidence") != float("inf")))
    return C.route_line(e, ["sample_id"], F.when(F.col("script") == "Devanagari", 1.0).otherwise(0.0)).select("sample_id", "system")


@query()
def q_transfer_text(spark, sf_dir):
    """Boxes of the reference's lines with the texts of the prediction's nearest lines."""
    e = read_table(spark, sf_dir, "page_eval")
    line = lambda t, i: F.struct(t.alias("text"), F.lit(0.0).alias("x"), (i * L.LINE_STEP).alias("y"), F.greatest(F.lit(L.LEAST_WIDTH), F.length(t) * L.CHAR_WIDTH).alias("w"), F.lit(L.LINE_HEIGHT).alias("h"), F.lit(1.0).alias("confidence"))
    lines = lambda c: F.transform(F.split(F.col(c), "\n"), line)
    got = C.transfer_text(e.select("eval_id", lines("prediction_text").alias("p"), lines("reference_text").alias("r")), "eval_id", "p", "r", keep_unmatched=True)
    return got.select("eval_id", "n_matched", F.array_join(F.transform("lines", lambda v: v["text"]), "\n").alias("text"))


@query("""
with p as (select p_partkey, p_size, (p_size % 7)::int as row, (p_partkey % 5)::int as col from part)
select p_partkey, round(10 + (500.0 / 5) * col, 6) as x, round(20 + (140.0 / 7) * row, 6) as y, round((500.0 / 5) * 2, 6) as w, round(140.0 / 7, 6) as h from p
""")
def q_cell_boxes(spark, sf_dir):
    """Boxes of cells in a table of seven even rows and five columns."""
    p = read_table(spark, sf_dir, "part")
    table = {n: F.lit(v) for n, v in zip("xywh", (10.0, 20.0, 500.0, 140.0), strict=True)}
    made = C.cell_box(table, F.col("p_size") % 7, F.col("p_partkey") % 5, F.lit(1), F.lit(2), F.lit(7), F.lit(5))
    return p.select("p_partkey", *[F.round(c, 6).alias(n) for c, n in zip(made, "xywh", strict=True)])


@query()
def q_normalized_tables(spark, sf_dir):
    """Shape of each document's table before and after its empty, separator and repeated columns go and list rows join."""
    def shapes(pdf_iter):
        import pandas as pd

        for pdf in pdf_iter:
            rows = []
            for k, cells in zip(pdf["doc_id"], pdf["cells"], strict=True):
                g = B.grid([(c["row"], c["col"], c["text"]) for c in cells])
                n = B.normalize_grid(g)
                rows.append((k, len(g), len(g[0]), len(n), len(n[0])))
            yield pd.DataFrame(rows, columns=["doc_id", "rows", "cols", "rows_after", "cols_after"])

    return _grids(spark, sf_dir).mapInPandas(shapes, "doc_id long, rows int, cols int, rows_after int, cols_after int")
