"""Queries on evaluation results, layout, tables and review, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliant.functions import text as X
from foliant.operators import layout as L
from foliant.operators import orders as O
from foliant.operators import results as M
from foliant.operators import review as R
from foliant.operators import tables as B
from foliant.plans.registry import query
from foliant.runtime import read_table

_LONG = """
with e as (select eval_id, sample_id, ocr_output_kind, slices, unnest(map_entries(metrics)) as m from page_eval),
l as (select eval_id, sample_id, ocr_output_kind, slices, m.key as metric, m.value as value from e where m.value is not null and isfinite(m.value))
"""


def _long(spark, sf_dir):
    return M.long_metrics(read_table(spark, sf_dir, "page_eval"), ["eval_id", "sample_id", "ocr_output_kind", "slices"])


@query(_LONG + ", s as (select *, unnest(list_distinct(list_concat(coalesce(slices, []), ['all']))) as slice from l) select ocr_output_kind, slice, metric, count(*) as n, round(avg(value), 6) as mean from s where slice is not null group by 1, 2, 3")
def q_metric_means(spark, sf_dir):
    """Mean of each finite metric by system and slice, with the roll-up slice."""
    got = M.slice_means(_long(spark, sf_dir), "ocr_output_kind", "slices").where("slice is not null")
    return got.withColumn("mean", F.round("mean", 6))


@query(_LONG + "select sample_id, ocr_output_kind, metric, arg_max(value, eval_id) as value from l group by 1, 2, 3")
def q_last_row_wins(spark, sf_dir):
    return M.last_row_wins(_long(spark, sf_dir), ["sample_id", "ocr_output_kind", "metric"], "value", "eval_id")


@query(_LONG + """, w as (select sample_id, ocr_output_kind as k, metric, arg_max(value, eval_id) as v from l group by 1, 2, 3),
p as (select c.metric, c.v as c, b.v as b from w c join w b on c.sample_id = b.sample_id and c.metric = b.metric and c.k = 'recognizer_b' and b.k = 'recognizer_a')
select metric, count(*) as n_pairs, count_if(c > b) as wins, count_if(c < b) as losses, count_if(c = b) as ties, round(avg(c), 6) as candidate_mean, round(avg(b), 6) as baseline_mean from p group by 1""")
def q_paired_compare(spark, sf_dir):
    """Two systems on the samples both have, per metric: one pivoting aggregation."""
    one = M.last_row_wins(_long(spark, sf_dir), ["sample_id", "ocr_output_kind", "metric"], "value", "eval_id")
    keyed = one.withColumn("key", F.struct("sample_id", "metric"))
    pairs = M.paired(keyed, "key", "ocr_output_kind", "value", "recognizer_b", "recognizer_a").withColumn("metric", F.col("key.metric"))
    got = M.outcomes(pairs, lower_is_better=False, by=["metric"])
    return got.select("metric", "n_pairs", "wins", "losses", "ties", F.round("candidate_mean", 6).alias("candidate_mean"), F.round("baseline_mean", 6).alias("baseline_mean"))


@query("""
with w as (select l_orderkey, l_returnflag as k, arg_max(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_quantity)) as v from lineitem group by 1, 2),
p as (select c.v as c, b.v as b from w c join w b on c.l_orderkey = b.l_orderkey and c.k = 'A' and b.k = 'R')
select count(*) as n_pairs, count_if(c < b) as wins, count_if(c > b) as losses, count_if(c = b) as ties, sum(c)::bigint as c_sum, sum(b)::bigint as b_sum from p
""")
def q_paired_large(spark, sf_dir):
    """The paired comparison on the largest fact table."""
    one = M.last_row_wins(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], "l_quantity", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    pairs = M.paired(one, "l_orderkey", "l_returnflag", "l_quantity", "A", "R")
    return pairs.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("candidate") < F.col("baseline")).alias("wins"),
                     F.count_if(F.col("candidate") > F.col("baseline")).alias("losses"), F.count_if(F.col("candidate") == F.col("baseline")).alias("ties"),
                     F.sum("candidate").cast("long").alias("c_sum"), F.sum("baseline").cast("long").alias("b_sum"))


@query("""
with k as (select unnest(['recognizer_a','recognizer_b','text_pdf_layer']) as system), s as (select distinct sample_id from page_eval),
h as (select distinct sample_id, ocr_output_kind as system from page_eval)
select k.system, count(*) as n_missing from s, k where not exists (select 1 from h where h.sample_id = s.sample_id and h.system = k.system) group by 1
""")
def q_coverage_missing(spark, sf_dir):
    """Samples that each required system lacks; one aggregation, no anti-join."""
    need = ("recognizer_a", "recognizer_b", "text_pdf_layer")
    held = read_table(spark, sf_dir, "page_eval").groupBy("sample_id").agg(F.collect_set("ocr_output_kind").alias("held"))
    missing = F.array_except(F.array(*[F.lit(k) for k in need]), "held")
    return held.select(F.explode(missing).alias("system")).groupBy("system").agg(F.count("*").alias("n_missing"))


@query("""
select sample_id, ocr_output_kind, value from (
  select sample_id, ocr_output_kind, metrics['latency_seconds'] as value, row_number() over (partition by sample_id order by metrics['latency_seconds'], -metrics['line_detection_f1'], eval_id, ocr_output_kind) as rn
  from page_eval where isfinite(metrics['latency_seconds']) and isfinite(metrics['line_detection_f1'])) where rn = 1
""")
def q_oracle_best(spark, sf_dir):
    """The fastest system of each sample; ties by detection score, then by order."""
    e = read_table(spark, sf_dir, "page_eval").select("sample_id", "ocr_output_kind", "eval_id", F.col("metrics")["latency_seconds"].alias("value"), F.col("metrics")["line_detection_f1"].alias("quality"))
    e = e.where(M.finite(F.col("value")) & M.finite(F.col("quality")))
    return M.best_system(e, "sample_id", "ocr_output_kind", "value", "quality", "eval_id")


_PAIRS = """
with p as (select l_orderkey as k, max(case when l_returnflag = 'A' then l_extendedprice end) as candidate, max(case when l_returnflag = 'R' then l_extendedprice end) as baseline, max(l_discount) as signal
  from lineitem where l_returnflag in ('A', 'R') group by 1),
g as (select round(i * 0.01, 10) as threshold from range(0, 11) t(i)),
t as (select threshold, count_if(signal > threshold) as picks, round(avg(case when signal > threshold then candidate else baseline end), 4) as mean
  from p, g where candidate is not null and baseline is not null group by 1)
"""


def _threshold_table(spark, sf_dir):
    side = lambda s: F.max(F.when(F.col("l_returnflag") == s, F.col("l_extendedprice")))
    pairs = read_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy("l_orderkey").agg(side("A").alias("candidate"), side("R").alias("baseline"), F.max("l_discount").alias("signal"))
    return M.threshold_means(pairs.where("candidate is not null and baseline is not null"), "signal", 0.0, 0.1, 0.01).withColumn("mean", F.round("mean", 4))


@query(_PAIRS + "select * from t")
def q_threshold_grid(spark, sf_dir):
    return _threshold_table(spark, sf_dir)


@query(_PAIRS + "select * from t order by mean, picks, -threshold limit 1")
def q_best_threshold(spark, sf_dir):
    return M.top_failures(_threshold_table(spark, sf_dir), [F.col("mean"), F.col("picks"), -F.col("threshold")], 1)


@query("""
with p as (select l_orderkey, max(case when l_returnflag = 'A' then l_extendedprice end) as c, max(case when l_returnflag = 'R' then l_extendedprice end) as b from lineitem group by 1)
select l_orderkey, round(c - b, 2) as gap from p where c is not null and b is not null order by c - b desc, l_orderkey limit 25
""")
def q_top_failures(spark, sf_dir):
    """The 25 samples on which the candidate is furthest behind."""
    side = lambda s: F.max(F.when(F.col("l_returnflag") == s, F.col("l_extendedprice")))
    p = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(side("A").alias("c"), side("R").alias("b")).where("c is not null and b is not null")
    return M.top_failures(p, [(F.col("c") - F.col("b")).desc(), F.col("l_orderkey")], 25).select("l_orderkey", F.round(F.col("c") - F.col("b"), 2).alias("gap"))


@query(_LONG + """select ocr_output_kind, round(avg(value) filter (where metric = 'line_detection_f1'), 6) as line_detection_f1,
round(avg(value) filter (where metric = 'line_mean_iou'), 6) as line_mean_iou, round(avg(value) filter (where metric = 'latency_seconds'), 6) as latency_seconds from l group by 1""")
def q_pivot_metrics(spark, sf_dir):
    names = ["line_detection_f1", "line_mean_iou", "latency_seconds"]
    got = _long(spark, sf_dir).groupBy("ocr_output_kind").pivot("metric", names).agg(F.avg("value"))
    return got.select("ocr_output_kind", *[F.round(n, 6).alias(n) for n in names])


@query("""
select language, script, domain, gt_status, split, count(*) as n_pages, sum(text_codepoint_ref_len)::bigint as n_codepoints, count_if(text_exact) as n_exact from page_eval
group by grouping sets ((language, script, domain, gt_status, split), ())
""")
def q_slice_rollup(spark, sf_dir):
    """Counts by five keys and over all, in one grouping."""
    read_table(spark, sf_dir, "page_eval").createOrReplaceTempView("foliant_page_eval")
    return spark.sql("""
        select language, script, domain, gt_status, split, count(*) as n_pages, sum(text_codepoint_ref_len) as n_codepoints, count_if(text_exact) as n_exact
        from foliant_page_eval group by grouping sets ((language, script, domain, gt_status, split), ())""")


@query("""
select count(*) as n, count(language) as language, count(script) as script, count(input_sha256) as input_sha256, count(document_sha256) as document_sha256, count(source_document) as source_document,
  count(nullif(reference_text, '')) as reference_text, count(nullif(prediction_text, '')) as prediction_text, count_if(claim_eligible) as claim_eligible from page_eval
""")
def q_field_coverage(spark, sf_dir):
    e = read_table(spark, sf_dir, "page_eval")
    held = ["language", "script", "input_sha256", "document_sha256", "source_document"]
    return e.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in held], *[F.count(F.nullif(c, F.lit(""))).alias(c) for c in ("reference_text", "prediction_text")], F.count_if("claim_eligible").alias("claim_eligible"))


_CER = r"""
with f as (select eval_id, ocr_output_kind, trim(regexp_replace(nfc_normalize(coalesce(prediction_text, '')), '\s+', ' ', 'g'), ' ') as p, trim(regexp_replace(nfc_normalize(coalesce(reference_text, '')), '\s+', ' ', 'g'), ' ') as r from page_eval),
s as (select *, array_to_string(list_distinct(string_split(p || r, '')), '') as cs from f), a as (select array_to_string(list_transform(range(1, 127), lambda i: chr(i::int)), '') as al),
d as (select s.eval_id, ocr_output_kind, length(r) as n, levenshtein(translate(p, cs, substr(al, 1, length(cs))), translate(r, cs, substr(al, 1, length(cs)))) as e from s, a),
c as (select eval_id, ocr_output_kind, n, e, case when n = 0 then case when e = 0 then 0.0 else 1.0 end else e / n end as cer from d)
"""


@query(_CER + "select eval_id, n::int as n_reference, e::int as edits, cer::double as cer from c")
def q_page_cer(spark, sf_dir):
    """Character error rate of every page, over normalised texts."""
    e = read_table(spark, sf_dir, "page_eval")
    flat = lambda c: F.trim(F.regexp_replace(X.nfc(F.coalesce(F.col(c), F.lit(""))), r"\s+", " "))
    e = e.select("eval_id", flat("prediction_text").alias("p"), flat("reference_text").alias("r"))
    return e.select("eval_id", F.length("r").alias("n_reference"), X.edits(F.col("p"), F.col("r")).alias("edits"), X.cer(F.col("p"), F.col("r")).alias("cer"))


@query(_CER + "select ocr_output_kind, count(*) as n_pages, sum(e)::double / greatest(sum(n), 1) as micro_cer, avg(cer)::double as macro_cer from c group by 1")
def q_micro_cer(spark, sf_dir):
    """Micro rate (edits over lengths) beside the macro mean, per system."""
    e = read_table(spark, sf_dir, "page_eval").select("eval_id", "ocr_output_kind")
    return q_page_cer(spark, sf_dir).join(e, "eval_id").groupBy("ocr_output_kind").agg(
        F.count("*").alias("n_pages"), (F.sum("edits") / F.greatest(F.sum("n_reference"), F.lit(1))).alias("micro_cer"), F.avg("cer").alias("macro_cer"))


@query()
def q_page_wer(spark, sf_dir):
    return read_table(spark, sf_dir, "page_eval").select("eval_id", X.wer("prediction_text", "reference_text").alias("wer"))


@query("""
with z as (select eval_id, string_split(coalesce(prediction_text, ''), chr(10)) as p, string_split(coalesce(reference_text, ''), chr(10)) as r from page_eval)
select eval_id, len(list_filter(range(1, least(len(p), len(r)) + 1), lambda i: p[i] = r[i]))::int as n_equal, len(r)::int as n_reference from z
""")
def q_exact_lines(spark, sf_dir):
    """Lines equal to the reference line of the same number."""
    e = read_table(spark, sf_dir, "page_eval")
    p, r = [F.split(F.coalesce(F.col(c), F.lit("")), "\n") for c in ("prediction_text", "reference_text")]
    equal = F.filter(F.zip_with(p, r, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)
    return e.select("eval_id", F.size(equal).alias("n_equal"), F.size(r).alias("n_reference"))


@query(r"""
with p as (select eval_id, unnest(regexp_extract_all(coalesce(prediction_text, ''), '[^ \n]+')) as w from page_eval), r as (select eval_id, unnest(regexp_extract_all(coalesce(reference_text, ''), '[^ \n]+')) as w from page_eval),
a as (select eval_id, w, count(*) as n from p group by 1, 2), b as (select eval_id, w, count(*) as n from r group by 1, 2),
j as (select coalesce(a.eval_id, b.eval_id) as eval_id, coalesce(a.n, 0) as x, coalesce(b.n, 0) as y from a full join b on a.eval_id = b.eval_id and a.w = b.w)
select eval_id, sum(least(x, y))::bigint as matched, sum(x)::bigint as n_predicted, sum(y)::bigint as n_reference, round(2.0 * sum(least(x, y)) / (sum(x) + sum(y)), 6) as f1 from j group by 1
""")
def q_bag_scores(spark, sf_dir):
    """Precision and recall of two bags of items per page."""
    e = read_table(spark, sf_dir, "page_eval")
    bag = lambda c: e.select("eval_id", F.explode(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit("[^ \n]+"), F.lit(0))).alias("w"))
    got = B.multiset_scores(bag("prediction_text"), bag("reference_text"), "eval_id", ["w"])
    return got.select("eval_id", "matched", "n_predicted", "n_reference", F.round("f1", 6).alias("f1"))


@query(_LONG + """, w as (select sample_id, ocr_output_kind as k, metric, arg_max(value, eval_id) as v from l group by 1, 2, 3),
p as (select c.metric, c.v as c, b.v as b from w c join w b on c.sample_id = b.sample_id and c.metric = b.metric and c.k = 'recognizer_b' and b.k = 'recognizer_a'),
o as (select metric, count(*) as n_pairs, count_if(c > b)::bigint as wins, count_if(c < b)::bigint as losses, avg(c) - avg(b) as gain from p group by 1)
select metric, n_pairs, wins, losses, array_to_string(list_filter([case when n_pairs < 30 then 'min_pairs' end, case when gain < 0 then 'min_absolute' end, case when not coalesce(wins / (wins + losses) >= 0.5, false) then 'min_win_rate' end], lambda x: x is not null), ',') as failed,
  n_pairs >= 30 and gain >= 0 and coalesce(wins / (wins + losses) >= 0.5, false) as passed,
  round(case when wins + losses > 0 then list_sum(list_transform(range(wins, wins + losses + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2)))) end, 6) as p_value from o""")
def q_gates(spark, sf_dir):
    """Gates over every metric of the paired comparison, with the sign test."""
    one = M.last_row_wins(_long(spark, sf_dir), ["sample_id", "ocr_output_kind", "metric"], "value", "eval_id").withColumn("key", F.struct("sample_id", "metric"))
    pairs = M.paired(one, "key", "ocr_output_kind", "value", "recognizer_b", "recognizer_a").withColumn("metric", F.col("key.metric"))
    got = M.gates(M.outcomes(pairs, False, ["metric"]), min_pairs=30, min_absolute=0.0, min_win_rate=0.5)
    return got.select("metric", "n_pairs", "wins", "losses", "passed", "failed", F.round(M.sign_test("wins", "losses"), 6).alias("p_value"))


@query()
def q_bootstrap(spark, sf_dir):
    """Interval of the mean detection score, with pages drawn."""
    e = read_table(spark, sf_dir, "page_eval").select("eval_id", F.col("metrics")["line_detection_f1"].alias("v")).where(M.finite(F.col("v")))
    return M.bootstrap_ci(e, "eval_id", "v", replicates=200)


@query("""
select event_type as family, count(*) as n, count_if(value < 10) as rejected, count_if(value >= 90) as wins, count_if(value < 10) >= 3 and count_if(value >= 90) = 0 as stopped from events group by 1
""")
def q_family_stop(spark, sf_dir):
    """Families whose runs were rejected too often without a win."""
    return read_table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("family")).agg(
        F.count("*").alias("n"), F.count_if(F.col("value") < 10).alias("rejected"), F.count_if(F.col("value") >= 90).alias("wins")).withColumn("stopped", (F.col("rejected") >= 3) & (F.col("wins") == 0))


@query("""
with l as (select conversion_id, array_to_string(list_filter([case when coalesce(trim(unicode_text, ' '), '') = '' then 'empty_text' end, case when len(unmapped_codepoints) > 0 then 'unmapped' end,
  case when replacement_count < 20 then 'short' end], lambda x: x is not null), ',') as reasons from limbu_conversion)
select conversion_id, reasons from l where reasons <> ''
""")
def q_review_queue(spark, sf_dir):
    c = read_table(spark, sf_dir, "limbu_conversion")
    why = R.reasons({"empty_text": F.coalesce(F.trim("unicode_text"), F.lit("")) == "", "unmapped": F.size("unmapped_codepoints") > 0, "short": F.col("replacement_count") < 20})
    return c.select("conversion_id", F.array_join(why, ",").alias("reasons")).where("reasons <> ''")


@query("""
with r as (select eval_id, domain, row_number() over (partition by domain, split order by eval_id) as n from page_eval)
select eval_id, ceil(n / 20.0)::bigint as batch_no, (['ana', 'bir', 'chime'])[((ceil(n / 20.0)::bigint - 1) % 3 + 1)::int] as reviewer from r
""")
def q_review_batches(spark, sf_dir):
    e = read_table(spark, sf_dir, "page_eval").select("eval_id", "domain", "split")
    return R.batches(e, ["domain", "split"], ["eval_id"], 20, ["ana", "bir", "chime"]).select("eval_id", "batch_no", "reviewer")


@query("""
with r as (select sample_id, span_index, max(unicode_text) as corrected, count(*) as n from limbu_conversion where replacement_count > 50 group by 1, 2),
s as (select sample_id, span_index, corrected from r where n = 1 and coalesce(trim(corrected, ' '), '') <> '')
select c.conversion_id, coalesce(s.corrected, c.legacy_text) as text, s.corrected is not null as is_corrected from limbu_conversion c left join s on s.sample_id = c.sample_id and s.span_index = c.span_index
""")
def q_apply_corrections(spark, sf_dir):
    """Reviewed texts put in the place of their spans; spans reviewed twice stay as they were."""
    c = read_table(spark, sf_dir, "limbu_conversion")
    lines = c.select("conversion_id", "sample_id", "span_index", F.col("legacy_text").alias("text"))
    reviews = c.where("replacement_count > 50").select(F.col("sample_id"), F.col("span_index"), F.col("unicode_text").alias("corrected_text"), F.lit("corrected").alias("review_status"))
    return R.apply_corrections(lines, reviews, ["sample_id", "span_index"])[0].select("conversion_id", "text", "is_corrected")


@query("""
with a as (select distinct sample_id from manifest), b as (select sample_id, count(*) as n from page_eval group by 1)
select coalesce(a.sample_id, b.sample_id) as sample_id, case when a.sample_id is null then 'unknown' when b.n is null then 'missing' when b.n > 1 then 'duplicate' else 'ready' end as status from a full join b on a.sample_id = b.sample_id
""")
def q_merge_batches(spark, sf_dir):
    return R.merge_batches(read_table(spark, sf_dir, "manifest"), read_table(spark, sf_dir, "page_eval"), ["sample_id"])


@query("""
with l as (select sample_id, conversion_id, row_number() over (partition by sample_id order by block_index, line_index, span_index, conversion_id) as pos from limbu_conversion)
select a.sample_id, count(*) as n_items, (select count(*) from l x join l y on x.sample_id = y.sample_id and x.pos < y.pos and x.conversion_id < y.conversion_id where x.sample_id = a.sample_id) as concordant from l a group by 1
""")
def q_order_accuracy(spark, sf_dir):
    """Pairs of spans of a sample whose record order agrees with their place; counted without emitting pairs."""
    return L.order_accuracy(read_table(spark, sf_dir, "limbu_conversion"), "sample_id", ["block_index", "line_index", "span_index"], "conversion_id").select("sample_id", "n_items", "concordant")


def _document_blocks(spark, sf_dir):
    """doc_id and the blocks of each document, from one scan and without a shuffle.

    Explode them by the outer form: the inner one infers a filter on their number, which would compute the lines again for each line.
    """
    d = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", L.line_array(F.col("text")).alias("_lines"))
    return L.block_arrays(d.select("doc_id", L.order_array(F.col("_lines")).alias("lines")), "lines", "blocks")


_LINES = r"""
with l0 as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null),
l as (select doc_id, line_no, text, 28.0 * line_no as y, row_number() over (partition by doc_id order by line_no) - 1 as order_no,
  contains(text, chr(9)) or regexp_matches(text, '^\s*\|.*\|\s*$') or len(regexp_split_to_array(trim(text, ' '), ' {2,}')) >= 3 as is_table from l0 where trim(text, ' ') <> ''),
s as (select *, case when lag(is_table) over w is null or lag(is_table) over w <> is_table or (not is_table and y - (lag(y) over w + 22) > 36) then 1 else 0 end as starts from l window w as (partition by doc_id order by order_no)),
b as (select *, sum(starts) over (partition by doc_id order by order_no) - 1 as block_no from s)
"""


@query(_LINES + "select doc_id, line_no::int as line_no, order_no::int as order_no, block_no::bigint as block_no from b")
def q_segment_blocks(spark, sf_dir):
    got = _document_blocks(spark, sf_dir).select("doc_id", F.posexplode_outer(F.flatten(F.transform("blocks", lambda b, k: F.transform(b, lambda v: F.struct(v["line_no"].alias("line_no"), k.cast("long").alias("block_no")))))).alias("order_no", "v"))
    return got.where("v is not null").select("doc_id", "v.line_no", "order_no", "v.block_no")


@query(_LINES + """, k as (select doc_id, block_no, count(*) as n_lines, string_agg(text, chr(10) order by order_no) as text, bool_and(is_table) as is_table from b group by 1, 2)
select doc_id, block_no::bigint as block_no, case when is_table then 'table' when block_no = 0 and n_lines = 1 and length(text) <= 120 then 'title' else 'text' end as block_type, n_lines, text from k""")
def q_blocks(spark, sf_dir):
    got = _document_blocks(spark, sf_dir).select("doc_id", F.posexplode_outer("blocks").alias("block_no", "b")).where("b is not null")
    return got.select(
        "doc_id", F.col("block_no").cast("long").alias("block_no"), L.block_kind(F.col("b"), F.col("block_no")).alias("block_type"), F.size("b").cast("long").alias("n_lines"),
        F.array_join(F.transform("b", lambda v: v["text"]), "\n").alias("text"))


@query(_LINES + r""", f0 as (select doc_id, block_no, bool_and(is_table) as is_table, bool_and(regexp_matches(text, '^[\s|:\-+]+$')) as bare from b group by 1, 2), f as (select doc_id, count_if(is_table and bare) as n_bare from f0 group by 1),
c as (select doc_id, text, case when length(text) % 7 = 0 then null when length(text) % 5 = 0 then 0.3 else 1.0 end::double as conf from l0),
q as (select doc_id, count(*) as n_lines, count_if(conf < 0.5) as n_low, count_if(conf is null) as n_missing, count_if(trim(text, ' ') = '') as n_empty, coalesce(avg(conf), 0) as avg_confidence from c group by 1)
select q.doc_id, n_lines, round(avg_confidence, 6) as avg_confidence, round(greatest(0, least(1, 1 - (0.35 * coalesce(n_low, 0) / n_lines + 0.2 * n_missing / n_lines + 0.2 * n_empty / n_lines + 0.2 * greatest(0.0, 0.95 - avg_confidence) + least(0.15, 0.05 * coalesce(f.n_bare, 0))))), 6) as quality_score
from q left join f on f.doc_id = q.doc_id""")
def q_doc_quality(spark, sf_dir):
    """Quality of documents whose lines, blank ones included, have confidences that vary or lack."""
    d = read_table(spark, sf_dir, "documents").where("text is not null")
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    lines = lines.withColumn("confidence", F.when(F.length("text") % 7 == 0, None).when(F.length("text") % 5 == 0, 0.3).otherwise(1.0))
    faults = _document_blocks(spark, sf_dir).select("doc_id", L.tables_without_cells(F.col("blocks")).alias("tables_without_cells"), F.lit(0).alias("blocks_without_lines"))
    got = L.page_quality(lines, ["doc_id"], faults=faults)
    return got.select("doc_id", "n_lines", F.round("avg_confidence", 6).alias("avg_confidence"), "quality_score")


@query()
def q_line_match(spark, sf_dir):
    """Lines of prediction and reference matched one to one by their boxes, per page."""
    e = read_table(spark, sf_dir, "page_eval")
    return L.match_pages(e.select("eval_id", L.line_array(F.col("reference_text")).alias("r"), L.line_array(F.col("prediction_text")).alias("p")), "eval_id", "r", "p")


@query()
def q_column_major(spark, sf_dir):
    """Lines in column-major order, with every other line set into a second column; a map over pages."""
    e = read_table(spark, sf_dir, "page_eval").where("prediction_text is not null").select("eval_id", L.line_array(F.col("prediction_text")).alias("lines"))
    boxes = F.transform("lines", lambda v: F.struct(((v["line_no"] % 2) * 2000.0).alias("x"), v["y"].alias("y"), v["w"].alias("w"), v["h"].alias("h"), v["line_no"].alias("line_no")))
    got = O.page_order(e.select("eval_id", boxes.alias("boxes")), "eval_id", "boxes", "column_bands", 4000.0, keep=True)
    return got.select("eval_id", F.posexplode(F.transform("order", lambda i: F.get("boxes", i)["line_no"])).alias("position", "line_no"))


@query()
def q_table_similarity(spark, sf_dir):
    """Tree similarity of each document's table and its normalised form, with and without text."""
    got = B.cells(L.text_lines(read_table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text"), "doc_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = B.grid([(int(r), int(c), t) for r, c, t in zip(pdf.line_no.rank(method="dense") - 1, pdf["col"], pdf.text, strict=True)])
        other = B.normalize_grid(rows)
        return pd.DataFrame({"doc_id": [pdf.doc_id.iloc[0]], "n_rows": [len(rows)], "structure": [B.tree_similarity(other, rows, False)], "text": [B.tree_similarity(other, rows, True)]})

    return got.groupBy("doc_id").applyInPandas(run, "doc_id long, n_rows int, structure double, text double")


@query("""
with s as (select s_suppkey, 'x' || substr(n_name, 2) as label from supplier join nation on s_nationkey = n_nationkey),
d as (select distinct s.label, n.n_name, levenshtein(s.label, n.n_name) as d from (select distinct label from s) s, nation n),
b as (select label, min(d) as d from d group by 1), u as (select d.label, max(d.n_name) as nearest from d join b on d.label = b.label and d.d = b.d group by 1 having count(*) = 1)
select s.s_suppkey, u.nearest from s left join u on u.label = s.label
""")
def q_lexicon_nearest(spark, sf_dir):
    """The one nearest entry of a lexicon within two edits; ties give none."""
    nation = read_table(spark, sf_dir, "nation")
    labels = read_table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("x"), F.substring("n_name", 2, 100)).alias("label"))
    lexicon = nation.agg(F.collect_list("n_name").alias("names"))  # a fixed lexicon of 25
    near = labels.select("label").distinct().join(lexicon).select("label", F.transform("names", lambda n: F.struct(F.levenshtein("label", n).alias("d"), n.alias("n"))).alias("c"))
    best = F.filter("c", lambda x: x["d"] == F.array_min(F.col("c"))["d"])
    near = near.select("label", F.when((F.size(best) == 1) & (F.get(best, F.lit(0))["d"] <= 2), F.get(best, F.lit(0))["n"]).alias("nearest"))
    return labels.join(near, "label", "left").select("s_suppkey", "nearest")


@query("select event_type, date_trunc('hour', ts) as hour, count(*) as n from events group by 1, 2")
def q_event_rates(spark, sf_dir):
    """The batch form of the windowed rates."""
    return read_table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))


@query()
def q_confusions(spark, sf_dir):
    """The 200 most frequent edits (a in the prediction, b in the reference, <eps> for nothing) of the aligned pages in NFC; of equal ones those seen first."""
    e = read_table(spark, sf_dir, "page_eval").where("prediction_text is not null and reference_text is not null")
    return M.confusions(e, "eval_id", "prediction_text", "reference_text", 200)


@query("""
select sample_id, array_to_string(list(v order by o), ' ') as versions from (
  select sample_id, row_id as o, dataset || ':' || split as v from manifest where sample_id is not null) group by 1 having count(*) > 1
""")
def q_sent_again(spark, sf_dir):
    """Samples sent more than once, with where each copy went, in order."""
    m = read_table(spark, sf_dir, "manifest").where("sample_id is not null")
    held = F.array_sort(F.collect_list(F.struct("row_id", F.concat("dataset", F.lit(":"), "split").alias("v"))))
    return m.groupBy("sample_id").agg(held.alias("h")).where(F.size("h") > 1).select("sample_id", F.array_join(F.transform("h", lambda x: x["v"]), " ").alias("versions"))


@query("""
select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity)::bigint as quantity, rank() over (order by count(*) desc, l_returnflag, l_linestatus)::int as rank from lineitem group by 1, 2
""")
def q_group_ranks(spark, sf_dir):
    got = read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))
    return got.withColumn("rank", F.rank().over(W.orderBy(F.desc("n"), "l_returnflag", "l_linestatus")))  # of the few groups
