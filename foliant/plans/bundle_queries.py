"""Queries on review bundles, work orders, splits with groups and pair packs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import bundles as U
from foliant.operators import corpus as C
from foliant.operators import layout as L
from foliant.plans.registry import query
from foliant.runtime import read_table
from foliant.sources import readers as S


@query("""
select language, eval_id, row_number() over (partition by language order by source_page, eval_id) as order_index, source_page, '' as decision, '' as reviewer from page_eval where prediction_text is not null
""")
def q_review_rows(spark, sf_dir):
    """Rows to review, numbered within each language, with empty fields to fill in."""
    e = read_table(spark, sf_dir, "page_eval").where("prediction_text is not null")
    return U.review_rows(e, ["eval_id"], ["source_page"], ["source_page"], ["decision", "reviewer"], ["language"])


@query("select eval_id, sample_id from page_eval e where not exists (select 1 from limbu_conversion c where c.sample_id = e.sample_id)")
def q_work_order(spark, sf_dir):
    """Pages for which no transcription has come back."""
    return U.open_rows(read_table(spark, sf_dir, "page_eval").select("eval_id", "sample_id"), read_table(spark, sf_dir, "limbu_conversion"), ["sample_id"])


@query("""select s_suppkey, to_json({'name': s_name, 'nation': s_nationkey, 'reading_order': [s_name], 'text': null::varchar}) as payload from supplier""")
def q_templates(spark, sf_dir):
    """One JSON reference for each entry."""
    s = read_table(spark, sf_dir, "supplier")
    return U.templates(s, "s_suppkey", {"name": F.col("s_name"), "nation": F.col("s_nationkey"), "reading_order": F.array("s_name"), "text": F.lit(None).cast("string")})


@query("""
with r as (select eval_id, domain, row_number() over (partition by domain order by eval_id) as n from page_eval where domain is not null), b as (select *, ceil(n / 25.0)::bigint as batch_no from r)
select eval_id, batch_no, concat('review-', domain, '-', lpad(batch_no::varchar, 4, '0'), '-', (['ana', 'bir'])[((batch_no - 1) % 2 + 1)::int]) as bundle from b
""")
def q_reviewer_bundle(spark, sf_dir):
    e = read_table(spark, sf_dir, "page_eval").where("domain is not null").select("eval_id", "domain")
    return U.reviewer_bundle(e, ["domain"], ["eval_id"], 25, ["ana", "bir"], "review").select("eval_id", "batch_no", "bundle")


@query("""
with s as (select sample_id, unicode_text as t, replacement_count as r from limbu_conversion where trim(unicode_text, ' ') <> '' and replacement_count is not null), b as (select sample_id, count(*) as n, arg_max(t, (r, t)) as t from s group by 1)
select e.eval_id, b.t as suggested, coalesce(b.n, 0) as n_suggestions from page_eval e left join b on b.sample_id = e.sample_id
""")
def q_assisted(spark, sf_dir):
    """Pages with the suggestion of most replaced characters."""
    c = read_table(spark, sf_dir, "limbu_conversion").where("replacement_count is not null").select("sample_id", "unicode_text", "replacement_count", F.col("font").alias("source"))
    return U.assisted(read_table(spark, sf_dir, "page_eval").select("eval_id", "sample_id"), c, ["sample_id"], "unicode_text", "replacement_count").select("eval_id", "suggested", "n_suggestions")


@query("""
select l_orderkey, count(*)::int as n_lines, to_json(list({'l_linenumber': l_linenumber, 'l_returnflag': l_returnflag} order by l_linenumber, l_returnflag)) as payload from lineitem group by 1
""")
def q_sidecars(spark, sf_dir):
    """The lines of each order as one JSON array, on the largest table."""
    return U.sidecars(read_table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber"], ["l_linenumber", "l_returnflag"])


@query("""
select sample_id, count(*)::int as n_lines, round(avg(case when len(unmapped_codepoints) = 0 then 1.0 else 0.0 end), 6) as sound_share,
  case when avg(case when len(unmapped_codepoints) = 0 then 1.0 else 0.0 end) >= 0.75 then string_agg(unicode_text, chr(10) order by block_index, line_index, span_index, conversion_id) end as text from limbu_conversion group by 1
""")
def q_native_references(spark, sf_dir):
    """Text of the samples three quarters of whose spans convert without unknown signs."""
    c = read_table(spark, sf_dir, "limbu_conversion")
    got = U.native_references(c, ["sample_id"], ["block_index", "line_index", "span_index", "conversion_id"], "unicode_text", F.size("unmapped_codepoints") == 0, 0.75)
    return got.withColumn("sound_share", F.round("sound_share", 6))


@query("""
with r as (select sample_id, count(distinct nullif(trim(reference_text, ' '), '')) as n, max(nullif(trim(reference_text, ' '), '')) as t from page_eval group by 1)
select m.sample_id, case when r.sample_id is null then 'open' when n = 0 then 'empty' when n > 1 then 'conflicting' else 'verified' end as status, case when n = 1 then t end as text from (select distinct sample_id from manifest where sample_id is not null) m left join r on r.sample_id = m.sample_id
""")
def q_verification(spark, sf_dir):
    """What came back for each sample: nothing, empty texts, one text or several."""
    m = read_table(spark, sf_dir, "manifest").where("sample_id is not null")
    return U.verification(m, read_table(spark, sf_dir, "page_eval"), ["sample_id"], "reference_text")


@query(r"""
with l as (select conversion_id, trim(unicode_text, ' ') as text from limbu_conversion) select concat('lines-', conversion_id::varchar) as sample_id, text from l where length(regexp_replace(text, '\s', '', 'g')) >= 5
""")
def q_recognizer_rows(spark, sf_dir):
    c = read_table(spark, sf_dir, "limbu_conversion")
    return U.recognizer_rows(c, "conversion_id", F.col("sample_id"), F.col("unicode_text"), "lines", "eval", 5).select("sample_id", "text")


@query()
def q_external_documents(spark, sf_dir):
    """Markdown of other systems as documents."""
    d = read_table(spark, sf_dir, "documents").where("text is not null")
    return U.documents_from_blocks(S.markdown_blocks(d, "doc_id", "text"), "doc_id")


@query("""
with r as (select ocr_output_kind as system, metrics['line_detection_f1'] as v, unnest(list_distinct(list_concat(coalesce(slices, []), ['all']))) as slice from page_eval where ocr_output_kind in ('recognizer_a', 'recognizer_b') and isfinite(metrics['line_detection_f1']))
select slice, system, count(*) as n, round(avg(v), 6) as mean, min(v) as worst from r where slice is not null group by 1, 2
""")
def q_error_report(spark, sf_dir):
    """Mean and worst detection score of two systems by slice."""
    v = F.col("metrics")["line_detection_f1"]
    e = read_table(spark, sf_dir, "page_eval").select(F.col("ocr_output_kind").alias("system"), F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v).alias("v"), "slices")
    return U.error_report(e, ["recognizer_a", "recognizer_b"], "v", F.col("slices"), lower_is_better=False).where("slice is not null").withColumn("mean", F.round("mean", 6))


@query(r"""
with l0 as (select eval_id, unnest(string_split(reference_text, chr(10))) as t, generate_subscripts(string_split(reference_text, chr(10)), 1) - 1 as line_no from page_eval where reference_text is not null),
l as (select eval_id, line_no::int as line_no, t, 28.0 * line_no as y, greatest(50.0, length(t) * 9.0) as w from l0 where trim(t, ' ') <> '' and length(trim(t, ' ')) >= 3)
select eval_id, line_no, unnest(list_filter(['line', case when contains(t, chr(9)) then 'table_cell' end, case when (w / 2) / 2000.0 between 0.1 and 0.3 and (y + 11) / 1000.0 between 0 and 0.5 then 'upper_left' end], lambda x: x is not null)) as crop_type from l
""")
def q_crops(spark, sf_dir):
    """Lines as crops: all, table rows, and those whose middle lies in a region of the page."""
    lines = L.text_lines(read_table(spark, sf_dir, "page_eval").where("reference_text is not null"), "eval_id", "reference_text")
    region = U.region_filter(*[F.col(c) for c in "xywh"], F.lit(2000.0), F.lit(1000.0), (0.1, 0.0, 0.3, 0.5))
    return U.crop_rows(lines, {"line": F.lit(True), "table_cell": F.contains(F.col("text"), F.lit("\t")), "upper_left": region}, 3).select("eval_id", "line_no", "crop_type")


_GROUP = "coalesce(nullif(trim(source_path, ' '), ''), sample_id)"


@query(f"""
with g as (select row_id, {_GROUP} as grp, language from synthesis_text where {_GROUP} is not null), s as (select grp, min(coalesce(language, '')) as stratum from g group by 1),
r as (select grp, stratum, row_number() over (partition by stratum order by sha256('group' || grp), grp) as n, count(*) over (partition by stratum) as m from s),
h as (select grp, n <= case when m > 1 then greatest(1, round_even(m * 0.2, 0)::bigint) else 0 end as is_held from r)
select g.row_id, h.is_held from g join h on h.grp = g.grp
""")
def q_group_split(spark, sf_dir):
    """Groups kept whole, a fifth of the groups of each stratum held out."""
    t = read_table(spark, sf_dir, "synthesis_text").select("row_id", F.coalesce(F.nullif(F.trim("source_path"), F.lit("")), F.col("sample_id")).alias("grp"), F.coalesce("language", F.lit("")).alias("stratum")).where("grp is not null")
    return C.group_split(t, "grp", "stratum", 0.2, salt="group").select("row_id", "is_held")


@query("""
with x as (select distinct sha256(text) as h from (select text from manifest union all select text from synthesis_text where row_id % 10 = 0) where text is not null and text <> '') select row_id from synthesis_text where text is null or sha256(text) not in (select h from x)
""")
def q_exclusion(spark, sf_dir):
    """Rows whose text is neither in the manifest nor in a tenth of the rows themselves, by hash."""
    s = read_table(spark, sf_dir, "synthesis_text")
    listed = read_table(spark, sf_dir, "manifest").select("text").unionByName(s.where("row_id % 10 = 0").select("text"))
    return C.without_listed(s, "text", listed, "text").select("row_id")


@query("""
with p as (select conversion_id, row_number() over (order by sha256(to_json({'clean': unicode_text, 'id': conversion_id, 'noisy': legacy_text}))) as n, count(*) over () as m from limbu_conversion where legacy_text is not null and unicode_text is not null)
select conversion_id, n <= least(m - 1, greatest(20, ceil(m * 0.05)::bigint)) as is_held from p
""")
def q_pair_pack(spark, sf_dir):
    """Correction pairs whose hashes come first are held out: a twentieth, 20 at least, never all."""
    c = read_table(spark, sf_dir, "limbu_conversion").where("legacy_text is not null and unicode_text is not null")
    key = F.sha2(F.to_json(F.struct(F.col("unicode_text").alias("clean"), F.col("conversion_id").alias("id"), F.col("legacy_text").alias("noisy"))), 256)
    return C.first_by_hash(c.select("conversion_id", key.alias("h")), "h", 0.05, 20).select("conversion_id", "is_held")
