"""Queries on routing, conflicts, blocklists and further audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliant.functions import text as X
from foliant.operators import corpus as C
from foliant.operators import layout as L
from foliant.operators import results as M
from foliant.operators import review as R
from foliant.operators import routing as O
from foliant.plans.registry import query
from foliant.runtime import read_table
from foliant.sources import sinks as K


@query("""
with b as (select text from synthesis_text union all select text from documents where doc_id % 50 = 0)
select source, count(*) as n from documents where text is not null and sha256(text) in (select sha256(text) from b where text <> '') group by 1
""")
def q_blocklist_overlap(spark, sf_dir):
    """Documents on a blocklist of the synthesis texts and some of the documents themselves, copies included."""
    d = read_table(spark, sf_dir, "documents")
    return O.blocked(d, "text", read_table(spark, sf_dir, "synthesis_text").select("text").unionByName(d.where("doc_id % 50 = 0").select("text")), "text", ["source"])


@query("""
select sample_id from page_eval where ocr_output_kind in ('recognizer_a', 'recognizer_b', 'text_pdf_layer') group by 1 having count(distinct ocr_output_kind) = 3
""")
def q_complete_samples(spark, sf_dir):
    return O.complete_keys(read_table(spark, sf_dir, "page_eval"), "sample_id", "ocr_output_kind", ["recognizer_a", "recognizer_b", "text_pdf_layer"])


@query("""
with v as (select sample_id, ocr_output_kind, metrics['line_mean_iou'] as v from page_eval where isfinite(metrics['line_mean_iou']))
select sample_id, ocr_output_kind, count(*) as n, min(v) as low, max(v) as high from v group by 1, 2 having max(v) - min(v) > 1e-9
""")
def q_metric_conflicts(spark, sf_dir):
    """Samples that one system was scored on with different results."""
    e = read_table(spark, sf_dir, "page_eval").select("sample_id", "ocr_output_kind", F.col("metrics")["line_mean_iou"].alias("v")).where(M.finite(F.col("v")))
    return O.conflicts(e, ["sample_id", "ocr_output_kind"], "v")


@query("""
select eval_id, case when metrics['line_detection_f1'] > 0.95 and script = 'Devanagari' and not isnan(metrics['line_detection_f1']) then 'prediction' else 'reference' end as chosen from page_eval
""")
def q_route_pages(spark, sf_dir):
    """Pages routed by a score and a guard script."""
    e, f1 = read_table(spark, sf_dir, "page_eval"), F.col("metrics")["line_detection_f1"]
    return e.select("eval_id", O.route(F.lit("prediction"), F.lit("reference"), F.when(~F.isnan(f1), f1), 0.95, F.col("script") == "Devanagari").alias("chosen"))


@query(r"""
with s as (select conversion_id, legacy_text, unicode_text, len(regexp_extract_all(coalesce(legacy_text, ''), '[\x{1900}-\x{194F}]')) as a, len(regexp_extract_all(coalesce(unicode_text, ''), '[\x{1900}-\x{194F}]')) as b from limbu_conversion)
select conversion_id, case when b > a then unicode_text else legacy_text end as text from s
""")
def q_best_reading(spark, sf_dir):
    """Of two readings of a span, the one with more letters of the target script; the first wins ties."""
    n = lambda c: X.char_count(F.col(c), X.LIMBU)
    return read_table(spark, sf_dir, "limbu_conversion").select("conversion_id", O.best_of([(F.col("legacy_text"), n("legacy_text")), (F.col("unicode_text"), n("unicode_text"))]).alias("text"))


@query(r"""
with l as (select eval_id, unnest(string_split(prediction_text, chr(10))) as text, generate_subscripts(string_split(prediction_text, chr(10)), 1) - 1 as line_no from page_eval where prediction_text is not null),
k as (select eval_id, line_no, text, 28.0 * line_no as y, max(28.0 * line_no) over (partition by eval_id) + 22 as h from l where trim(text, ' ') <> ''),
r as (select *, case when regexp_matches(text, '^\s*[0-9\x{0966}-\x{096F}]{1,3}\s*$') then 0 when y >= 0.8 * h and regexp_matches(text, '^\s*[0-9\x{0966}-\x{096F}]') then 1 else 2 end as rank from k)
select eval_id, line_no::int as line_no, rank::int as rank, (row_number() over (partition by eval_id order by rank, y, line_no))::int as position from r
""")
def q_block_order(spark, sf_dir):
    """Final order of a page's lines: markers first, then low lines that begin with a digit, then the rest."""
    lines = L.text_lines(read_table(spark, sf_dir, "page_eval").where("prediction_text is not null"), "eval_id", "prediction_text")
    ranked = lines.withColumn("page_height", F.max(F.col("y") + F.col("h")).over(W.partitionBy("eval_id"))).withColumn("rank", O.block_rank(F.col("text"), F.col("y"), F.col("page_height")))
    return ranked.select("eval_id", "line_no", "rank", F.row_number().over(W.partitionBy("eval_id").orderBy("rank", "y", "line_no")).alias("position"))


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null)
select doc_id, string_agg(case when i = 1 and length(t) <= 120 then '# ' || t else t end, chr(10) || chr(10) order by i) || chr(10) as markdown from l where trim(t, ' ') <> '' group by 1
""")
def q_page_markdown(spark, sf_dir):
    """Markdown of documents whose lines are blocks, a short first line being the title; a page is one row throughout."""
    d = read_table(spark, sf_dir, "documents").where("text is not null")
    kind = lambda v: F.when((v["line_no"] == 0) & (F.length(v["text"]) <= 120), "title").otherwise("text")
    blocks = F.transform(L.line_array(F.col("text")), lambda v: F.struct(v["line_no"].alias("order"), kind(v).alias("block_type"), v["text"].alias("text")))
    return d.select("doc_id", blocks.alias("b")).where("size(b) > 0").select("doc_id", K.page_markdown(F.col("b")).alias("markdown"))


@query("""
select sample_id, min(row_id) as row_id, arg_min(dataset, row_id) as dataset from manifest where sample_id is not null group by 1
""")
def q_keep_first(spark, sf_dir):
    m = read_table(spark, sf_dir, "manifest").where("sample_id is not null").select("sample_id", "row_id", "dataset")
    return C.keep_first(m, ["sample_id"], "row_id").select("sample_id", "row_id", "dataset")


@query()
def q_noise_pairs(spark, sf_dir):
    """Seeded noise on every text of the corpus, with its clean form."""
    return O.noise_pairs(read_table(spark, sf_dir, "synthesis_text"), "row_id", "text")


@query(r"""
select row_id, array_to_string(list_filter([
  case when script = 'Limbu' and not regexp_matches(text, '[\x{1900}-\x{194F}]') then 'no_limbu' end, case when script = 'Devanagari' and not regexp_matches(text, '[\x{0900}-\x{097F}]') then 'no_devanagari' end,
  case when script = 'Latin' and not regexp_matches(text, '[A-Za-z]') then 'no_latin' end, case when coalesce(trim(source_path, ' '), '') = '' then 'no_source' end,
  case when coalesce(metadata['license_status'], '') = '' then 'no_license' end], lambda x: x is not null), ',') as codes from synthesis_text
""")
def q_row_audit(spark, sf_dir):
    """Contradictions and gaps of each row."""
    t = F.col("text")
    tests = {"no_limbu": (F.col("script") == "Limbu") & ~t.rlike(X.LIMBU), "no_devanagari": (F.col("script") == "Devanagari") & ~t.rlike(r"[\x{0900}-\x{097F}]"), "no_latin": (F.col("script") == "Latin") & ~t.rlike(X.LATIN),
             "no_source": F.coalesce(F.trim("source_path"), F.lit("")) == "", "no_license": F.coalesce(F.col("metadata")["license_status"], F.lit("")) == ""}
    return read_table(spark, sf_dir, "synthesis_text").select("row_id", F.array_join(R.reasons(tests), ",").alias("codes"))


@query("""
with s as (select conversion_id, case when coalesce(trim(unicode_text, ' '), '') = '' then 'dropped' when len(unmapped_codepoints) > 0 then 'blocked' when count(*) over (partition by sample_id, span_index) > 1 then 'duplicate' else 'ready' end as status, font from limbu_conversion)
select font, status, count(*) as n from s group by 1, 2
""")
def q_status_counts(spark, sf_dir):
    """Spans by the state that their text and their copies put them in."""
    c = read_table(spark, sf_dir, "limbu_conversion")
    copies = c.groupBy("sample_id", "span_index").agg(F.count("*").alias("copies"))
    status = F.when(F.coalesce(F.trim("unicode_text"), F.lit("")) == "", "dropped").when(F.size("unmapped_codepoints") > 0, "blocked").when(F.col("copies") > 1, "duplicate").otherwise("ready")
    joined = c.join(copies, c["sample_id"].eqNullSafe(copies["sample_id"]) & c["span_index"].eqNullSafe(copies["span_index"]))
    return joined.groupBy("font", status.alias("status")).agg(F.count("*").alias("n"))


@query(r"""
with b as (select row_id, [struct_pack(n := 'Latin', v := len(regexp_extract_all(text, '[A-Za-z]'))), struct_pack(n := 'Devanagari', v := len(regexp_extract_all(text, '[\x{0900}-\x{097F}]'))),
  struct_pack(n := 'Limbu', v := len(regexp_extract_all(text, '[\x{1900}-\x{194F}]'))), struct_pack(n := 'Lepcha', v := len(regexp_extract_all(text, '[\x{1C00}-\x{1C4F}]'))),
  struct_pack(n := 'Ol Chiki', v := len(regexp_extract_all(text, '[\x{1C50}-\x{1C7F}]')))] as c from synthesis_text where text is not null),
m as (select row_id, c, list_max(list_transform(c, lambda x: x.v)) as top from b)
select row_id, case when top > 0 then list_filter(c, lambda x: x.v = top)[1].n end as dominant from m
""")
def q_dominant_script(spark, sf_dir):
    """The block with most letters; the first listed wins ties, none without any."""
    t = F.col("text")
    blocks = {"Latin": X.LATIN, "Devanagari": r"[\x{0900}-\x{097F}]", "Limbu": X.LIMBU, "Lepcha": r"[\x{1C00}-\x{1C4F}]", "Ol Chiki": r"[\x{1C50}-\x{1C7F}]"}
    options = [(F.lit(n), X.char_count(t, p)) for n, p in blocks.items()]
    most = F.greatest(*[s for _, s in options])
    return read_table(spark, sf_dir, "synthesis_text").where("text is not null").select("row_id", F.when(most > 0, O.best_of(options)).alias("dominant"))


@query("""
with b as (select doc_id, unnest(list_filter([case when contains(text, '|') then 'tables' end, case when starts_with(text, '#') then 'titled' end, case when length(text) > 2000 then 'long' end], lambda x: x is not null)) as bucket from documents),
s as (select bucket, count(*) as n from b group by 1)
select b.bucket, b.doc_id, unnest(range(0, greatest(1, ceil(500.0 / s.n))::int))::int as copy_no from b join s on s.bucket = b.bucket
""")
def q_bucket_top_up(spark, sf_dir):
    t = F.col("text")
    return O.bucket_top_up(read_table(spark, sf_dir, "documents"), "doc_id", {"tables": t.contains("|"), "titled": t.startswith("#"), "long": F.length(t) > 2000}, 500)


@query("""
with f as (select e.sample_id, min(e.eval_id) as eval_id from page_eval e where not isnan(metrics['line_detection_f1']) and metrics['line_detection_f1'] < 0.93 group by 1),
m as (select sample_id, min(row_id) as row_id, count(*) as copies from manifest group by 1)
select f.sample_id, f.eval_id, m.row_id, coalesce(m.copies, 0) as copies from f left join m on m.sample_id = f.sample_id
""")
def q_failure_manifest(spark, sf_dir):
    """Failed samples with their manifest row, the first of copies; missing ones stay visible."""
    f1 = F.col("metrics")["line_detection_f1"]
    failed = read_table(spark, sf_dir, "page_eval").where(~F.isnan(f1) & (f1 < 0.93)).groupBy("sample_id").agg(F.min("eval_id").alias("eval_id"))
    rows = read_table(spark, sf_dir, "manifest").groupBy("sample_id").agg(F.min("row_id").alias("row_id"), F.count("*").alias("copies"))
    return failed.join(rows, "sample_id", "left").select("sample_id", "eval_id", "row_id", F.coalesce("copies", F.lit(0)).alias("copies"))


@query("""
with x as (select list(distinct c order by c) as held from (select unnest(string_split(unicode_text, '')) as c from limbu_conversion) where c <> ''),
r as (select distinct chr(('0x' || substr(t, 3))::int) as c from (select unnest(string_split(target_codepoints, ' ')) as t from legacy_rule))
select c as ch, list_contains((select held from x), c) as seen from r
""")
def q_rule_coverage(spark, sf_dir):
    """Characters that the rules can make, and whether the converted corpus holds them."""
    rules = read_table(spark, sf_dir, "legacy_rule").select(F.explode(F.split("target_codepoints", " ")).alias("t")).select(F.expr("decode(unhex(lpad(substring(t, 3), 8, '0')), 'UTF-32')").alias("ch")).distinct()
    held = read_table(spark, sf_dir, "limbu_conversion").where("unicode_text is not null").select(F.explode(F.array_distinct(F.split("unicode_text", ""))).alias("ch")).distinct().withColumn("seen", F.lit(True))
    return rules.join(held, "ch", "left").select("ch", F.coalesce("seen", F.lit(False)).alias("seen"))


@query(r"""
with k as (select p_partkey, p_name, 'P' || substr(p_type, 2) as label, p_type from part),
d as (select p_partkey, label, p_type, levenshtein(label, p_type) as d from k)
select p_partkey, case when d <= 2 then p_type else label end as repaired from d
""")
def q_label_repair(spark, sf_dir):
    """Labels put right where they are within two edits of the known one."""
    p = read_table(spark, sf_dir, "part").withColumn("label", F.concat(F.lit("P"), F.expr("substring(p_type, 2)")))
    return p.select("p_partkey", F.when(F.levenshtein("label", "p_type") <= 2, F.col("p_type")).otherwise(F.col("label")).alias("repaired"))
