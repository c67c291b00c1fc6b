"""Audits of manifests, results, packs, rules, files and coverage, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import audits as A
from foliant.operators import corpus as C
from foliant.operators import results as M
from foliant.plans.registry import query
from foliant.runtime import read_table

_OUTCOMES = """
with e as (select eval_id, sample_id, ocr_output_kind, unnest(map_entries(metrics)) as m from page_eval),
l as (select sample_id, ocr_output_kind as k, m.key as metric, arg_max(m.value, eval_id) as v from e where m.value is not null and isfinite(m.value) group by 1, 2, 3),
p as (select c.metric, c.v as c, b.v as b from l c join l b on c.sample_id = b.sample_id and c.metric = b.metric and c.k = 'recognizer_b' and b.k = 'recognizer_a'),
o as (select metric, count(*) as n, count_if(c > b) as wins, count_if(c < b) as losses, avg(c) as cm, avg(b) as bm from p group by 1),
g as (select metric, unnest([{'gate': 'min_pairs', 'observed': n::double, 'threshold': 30.0, 'up': true}, {'gate': 'min_absolute_improvement', 'observed': cm - bm, 'threshold': 0.0, 'up': true},
  {'gate': 'min_win_rate', 'observed': case when wins + losses > 0 then wins::double / (wins + losses) end, 'threshold': 0.5, 'up': true}, {'gate': 'max_losses', 'observed': losses::double, 'threshold': 100.0, 'up': false},
  {'gate': 'min_candidate_mean', 'observed': cm, 'threshold': 0.2, 'up': true}]) as g from o),
r as (select metric, g.gate as gate, round(g.observed, 5) as observed, g.threshold::double as threshold, coalesce(case when g.up then g.observed >= g.threshold else g.observed <= g.threshold end, false) as passed from g)
"""
_THRESHOLDS = {"min_pairs": 30, "min_absolute_improvement": 0.0, "min_win_rate": 0.5, "max_losses": 100, "min_candidate_mean": 0.2}


def _gate_rows(spark, sf_dir):
    long = M.long_metrics(read_table(spark, sf_dir, "page_eval"), ["eval_id", "sample_id", "ocr_output_kind"])
    one = M.last_row_wins(long, ["sample_id", "ocr_output_kind", "metric"], "value", "eval_id").withColumn("key", F.struct("sample_id", "metric"))
    pairs = M.paired(one, "key", "ocr_output_kind", "value", "recognizer_b", "recognizer_a").withColumn("metric", F.col("key.metric"))
    return A.evaluate_gates(M.outcomes(pairs, False, ["metric"]), ["metric"], _THRESHOLDS)


@query(_OUTCOMES + "select * from r")
def q_claim_gates(spark, sf_dir):
    """Every gate of every metric of a paired comparison: observed value, threshold and result."""
    return _gate_rows(spark, sf_dir).withColumn("observed", F.round("observed", 5))


@query(_OUTCOMES + "select metric, coalesce(string_agg(gate, ',' order by gate) filter (where not passed), '') as failed, bool_and(passed) as admitted from r group by 1")
def q_admission(spark, sf_dir):
    """Which metrics pass all gates, and the gates that the others fail."""
    return A.decisions(_gate_rows(spark, sf_dir), ["metric"])


@query("""
with w as (select * from (values ('all', 100), ('notice', 5), ('primer', 5), ('nowhere', 1)) t(value, needed)),
s as (select sample_id, unnest(list_distinct(list_concat(coalesce(slices, []), ['all']))) as value from page_eval), n as (select value, count(distinct sample_id) as n from s group by 1)
select w.value, coalesce(n.n, 0) as n, w.needed::bigint as needed, coalesce(n.n, 0) >= w.needed as passed from w left join n on n.value = w.value
""")
def q_required_slices(spark, sf_dir):
    """Samples in each required slice against the least number; a slice that no sample has counts 0."""
    e = read_table(spark, sf_dir, "page_eval")
    spread = e.select("sample_id", F.explode(F.array_distinct(F.concat(F.coalesce("slices", F.array().cast("array<string>")), F.array(F.lit("all"))))).alias("slice"))
    return A.required_counts(spread, F.col("slice"), {"all": 100, "notice": 5, "primer": 5, "nowhere": 1}, of="sample_id")


@query("""
with need as (select * from (values ('recognizer_a', 'latency_seconds'), ('recognizer_b', 'unheard_of'), ('no_system', 'latency_seconds')) t(system, item)),
h as (select distinct ocr_output_kind as system, unnest(map_keys(metrics)) as item from page_eval)
select need.system, need.item from need where not exists (select 1 from h where h.system = need.system and h.item = need.item)
""")
def q_missing_evidence(spark, sf_dir):
    e = read_table(spark, sf_dir, "page_eval").select(F.col("ocr_output_kind").alias("system"), F.explode(F.map_keys("metrics")).alias("item"))
    return A.missing_evidence(e, [("recognizer_a", "latency_seconds"), ("recognizer_b", "unheard_of"), ("no_system", "latency_seconds")], "system", "item")


_MANIFEST_ISSUES = r"""
with s as (select distinct unnest(spellings) as spelling from split_target), d as (select sample_id as k from manifest where sample_id is not null group by 1 having count(*) > 1),
i as (select m.row_id, unnest(list_filter([case when coalesce(trim(sample_id, ' '), '') = '' then 'no_sample_id' end, case when coalesce(trim(text, ' '), '') = '' then 'empty_text' end, case when sha256 is null then 'no_hash' end,
  case when not regexp_full_match(sha256, '[0-9a-f]{64}') then 'hash_form' end, case when s.spelling is null then 'unknown_split' end, case when d.k is not null then 'repeated_sample_id' end,
  case when coalesce(trim(metadata['document_type'], ' '), '') = '' then 'no_document_type' end, case when trim(metadata['script'], ' ') = 'Devanagari' and text is not null and text <> '' and not regexp_matches(text, '[\x{0900}-\x{097F}]') then 'script_contradicted' end], lambda x: x is not null)) as code
  from manifest m left join s on s.spelling = m.split left join d on d.k = m.sample_id)
"""


def _manifest_issues(spark, sf_dir):
    m = read_table(spark, sf_dir, "manifest")
    names = read_table(spark, sf_dir, "split_target").select(F.explode("spellings").alias("split")).distinct().withColumn("_listed", F.lit(True))
    again = C.duplicates(m, F.col("sample_id")).select(F.col("key").alias("sample_id"), F.lit(True).alias("_again"))
    j = m.select("row_id", "sample_id", "split", "text", "sha256", "metadata").join(names, "split", "left").join(again, "sample_id", "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    meta = F.col("metadata")
    return A.issues(j, ["row_id"], {
        "no_sample_id": (A.ERROR, blank("sample_id")), "empty_text": (A.ERROR, blank("text")), "no_hash": (A.WARNING, F.col("sha256").isNull()),
        "hash_form": (A.ERROR, ~F.col("sha256").rlike("^[0-9a-f]{64}$")), "unknown_split": (A.ERROR, F.col("_listed").isNull()), "repeated_sample_id": (A.WARNING, F.col("_again")),
        "no_document_type": (A.WARNING, blank(meta["document_type"])),
        "script_contradicted": (A.WARNING, (F.trim(meta["script"]) == "Devanagari") & (F.col("text") != "") & ~F.col("text").rlike(r"[\x{0900}-\x{097F}]"))})


@query(_MANIFEST_ISSUES + "select row_id, code from i")
def q_manifest_issues(spark, sf_dir):
    """Every rule that a manifest row fails."""
    return _manifest_issues(spark, sf_dir).select("row_id", "code")


@query(_MANIFEST_ISSUES + ", e as (select code in ('no_sample_id', 'empty_text', 'hash_form', 'unknown_split') as is_error from i) select count_if(is_error) as n_errors, count_if(not is_error) as n_warnings, count_if(is_error) = 0 as passed from e")
def q_manifest_verdict(spark, sf_dir):
    return A.verdict(_manifest_issues(spark, sf_dir))


@query("""
select gt_status, count(*) as n, count(nullif(reference_text, '')) as with_text, count_if(len(slices) > 0) as with_slices, count(document_sha256) as with_document, count(source_page) as with_page,
  count_if(nullif(reference_text, '') is not null and coalesce(len(slices), 0) > 0 and document_sha256 is not null and source_page is not null) as complete from page_eval group by 1
""")
def q_reference_audit(spark, sf_dir):
    """How many references hold text, slices, document and page, by status."""
    e = read_table(spark, sf_dir, "page_eval")
    return A.completeness(e, ["gt_status"], {"text": F.col("reference_text") != "", "slices": F.size("slices") > 0, "document": F.col("document_sha256").isNotNull(), "page": F.col("source_page").isNotNull()})


@query(r"""
with c as (select conversion_id, (limbu_char_count + case when conversion_id % 50 = 0 then 1 else 0 end)::int as limbu_char_count, len(regexp_extract_all(coalesce(unicode_text, ''), '[\x{1900}-\x{194F}]'))::int as again from limbu_conversion)
select conversion_id, 'limbu_char_count' as field, limbu_char_count::varchar as stored, again::varchar as computed from c where limbu_char_count is distinct from again
""")
def q_replay_audit(spark, sf_dir):
    """Stored counts, one in fifty of them put wrong, that differ from what is counted again in the stored text."""
    c = read_table(spark, sf_dir, "limbu_conversion").withColumn("limbu_char_count", F.col("limbu_char_count") + F.when(F.col("conversion_id") % 50 == 0, 1).otherwise(0))
    return A.replay(c, ["conversion_id"], {"limbu_char_count": X.char_count(F.col("unicode_text"), X.LIMBU)})


@query("""
with h as (select sample_id, string_agg(distinct ocr_output_kind, ',' order by ocr_output_kind) as arms from page_eval where ocr_output_kind in ('recognizer_a', 'recognizer_b') and sample_id is not null group by 1)
select arms, count(*) as n from h group by 1
""")
def q_arm_differences(spark, sf_dir):
    """Samples that both arms, or one of them, ran over."""
    return A.arm_differences(read_table(spark, sf_dir, "page_eval").where("sample_id is not null"), "ocr_output_kind", "sample_id", ["recognizer_a", "recognizer_b"])


@query("""
with p as (select sample_id, legacy_text as a, unicode_text as b, conversion_id % 10 = 0 as held from limbu_conversion),
b as (select a from p where coalesce(trim(a, ' '), '') <> '' group by 1 having min(held) <> max(held)), r as (select sample_id from p group by 1 having count(*) > 1)
select 'empty_source' as code, count_if(coalesce(trim(a, ' '), '') = '') as n from p union all select 'empty_target', count_if(coalesce(trim(b, ' '), '') = '') from p union all select 'unchanged', count_if(a = b) from p
union all select 'repeated_id', count(*) from r union all select 'source_on_both_sides', count(*) from b
""")
def q_pack_issues(spark, sf_dir):
    """Faults of a pack of correction pairs, a tenth of which is held out."""
    c = read_table(spark, sf_dir, "limbu_conversion").select("sample_id", "legacy_text", "unicode_text", (F.col("conversion_id") % 10 == 0).alias("held"))
    return A.pack_issues(c, "sample_id", "legacy_text", "unicode_text", "held")


@query("""
with t as (select rule_no, source_bytes as s, target_codepoints as t from legacy_rule), f as (select s, min(rule_no) as first from t group by 1)
select rule_no, 'shadowed' as code from t join f on f.s = t.s where rule_no > first union all select rule_no, 'no_change' from t where s = t union all select rule_no, 'empty_source' from t where trim(s, ' ') = ''
union all select rule_no, 'chained' from t where t.t in (select s from t) and s <> t.t
""")
def q_rule_issues(spark, sf_dir):
    """Rules that never apply, or change nothing."""
    return A.rule_issues(read_table(spark, sf_dir, "legacy_rule"), "rule_no", "source_bytes", "target_codepoints").select("rule_no", "code")


@query(r"""
with g as (select id, unnest(scripts) as s from language_registry), r as (select id, s.script as script, unnest(s.unicode_ranges) as rng from g),
e as (select id, script, ('0x' || regexp_extract(upper(rng), '([0-9A-F]{4,6})', 1))::bigint as lo, ('0x' || regexp_extract(upper(rng), '([0-9A-F]{4,6})[^0-9A-F]*$', 1))::bigint as hi from r),
p as (select distinct id, script, unnest(range(lo, hi + 1)) as cp from e), t as (select distinct unicode(unnest(string_split(text, ''))) as cp from synthesis_text where text is not null)
select p.id, p.script, count(*) as n_required, count(t.cp) as n_held from p left join t on t.cp = p.cp group by 1, 2
""")
def q_range_coverage(spark, sf_dir):
    """Code points of each language's scripts that the corpus holds."""
    need = read_table(spark, sf_dir, "language_registry").select("id", F.explode("scripts").alias("s")).select("id", F.col("s.script").alias("script"), A.codepoint_ranges(F.col("s.unicode_ranges")).alias("points"))
    held = read_table(spark, sf_dir, "synthesis_text").where("text is not null").select(F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''").distinct().select(F.expr("conv(hex(encode(c, 'UTF-32')), 16, 10)").cast("int").alias("cp")).withColumn("_held", F.lit(1))
    return need.select("id", "script", F.explode("points").alias("cp")).join(held, "cp", "left").groupBy("id", "script").agg(F.count("*").alias("n_required"), F.count("_held").alias("n_held"))


@query("""
with e as (select input_path as path, max(lower(trim(input_sha256, ' '))) as e from page_eval where input_path is not null group by 1), f as (select image_path as path, max(lower(trim(sha256, ' '))) as f from manifest where image_path is not null and row_id % 2 = 0 group by 1),
j as (select coalesce(e.path, f.path) as path, e.path as pe, f.path as pf, e, f from e full join f on e.path = f.path)
select path, case when pf is null then 'missing' when pe is null then 'unexpected' when e is not distinct from f then 'ok' else 'changed' end as status from j
""")
def q_compare_files(spark, sf_dir):
    """Files that are expected against those found, by path and hash."""
    e = read_table(spark, sf_dir, "page_eval").where("input_path is not null").select(F.col("input_path").alias("path"), F.col("input_sha256").alias("digest"))
    f = read_table(spark, sf_dir, "manifest").where("image_path is not null and row_id % 2 = 0").select(F.col("image_path").alias("path"), F.col("sha256").alias("digest"))
    return A.compare_files(e, f, "path", "digest")


@query("""
with s as (select unnest(['scan', 'photo', 'unseen']) as profile), k as (select distinct t.split as side from manifest m join split_target t on list_contains(t.spellings, m.split)),
n as (select trim(m.metadata['degradation'], ' ') as profile, t.split as side, count(*) as n from manifest m join split_target t on list_contains(t.spellings, m.split) group by 1, 2)
select s.profile, k.side, coalesce(n.n, 0) as n from s cross join k left join n on n.profile = s.profile and n.side = k.side
""")
def q_profile_sides(spark, sf_dir):
    """Rows of each expected degradation on every side of the split."""
    names = read_table(spark, sf_dir, "split_target").select(F.explode("spellings").alias("split"), F.col("split").alias("side"))
    m = read_table(spark, sf_dir, "manifest").join(names, "split")
    return A.profile_sides(m, F.trim(F.col("metadata")["degradation"]), "side", ["scan", "photo", "unseen"])


@query("""
with p as (select l_orderkey as k, max(case when l_returnflag = 'A' then l_extendedprice end) as c, max(case when l_returnflag = 'R' then l_extendedprice end) as b, max(l_discount) as s from lineitem where l_returnflag in ('A', 'R') group by 1),
g as (select round(i * 0.05, 10) as threshold from range(0, 4) t(i)), t as (select threshold, count_if(s > threshold) as picks, count(*) as pairs from p, g where c is not null and b is not null group by 1)
select threshold, picks, pairs, picks = 0 or picks = pairs as collapsed from t
""")
def q_router_collapse(spark, sf_dir):
    """Thresholds at which a router always takes the same side."""
    side = lambda s: F.max(F.when(F.col("l_returnflag") == s, F.col("l_extendedprice")))
    pairs = read_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy("l_orderkey").agg(side("A").alias("candidate"), side("R").alias("baseline"), F.max("l_discount").alias("signal")).where("candidate is not null and baseline is not null")
    grid = F.array(*[F.lit(round(i * 0.05, 10)) for i in range(4)])
    trial = pairs.select(F.explode(grid).alias("threshold"), "signal").groupBy("threshold").agg(F.count_if(F.col("signal") > F.col("threshold")).alias("picks"), F.count("*").alias("pairs"))
    return A.router_collapse(trial, "picks", "pairs")


@query("""
with m as (select row_id, lower(array_to_string(list_sort(map_values(metadata)), ' ')) as t, trim(metadata['degradation'], ' ') as d from manifest where metadata is not null)
select row_id, array_to_string(list_filter([case when contains(t, 'line') and d = 'scan' then 'line_scan' end, case when contains(t, 'page') and d is null then 'page_without_degradation' end], lambda x: x is not null), ',') as claims from m
where (contains(t, 'line') and d = 'scan') or (contains(t, 'page') and d is null)
""")
def q_contradictions(spark, sf_dir):
    """Rows whose provenance texts speak against a field."""
    m = read_table(spark, sf_dir, "manifest").where("metadata is not null")
    d = F.trim(F.col("metadata")["degradation"])
    found = A.contradictions(F.col("metadata"), {"line_scan": ("line", d == "scan"), "page_without_degradation": ("page", d.isNull())})
    return m.select("row_id", F.array_join(found, ",").alias("claims")).where("claims <> ''")
