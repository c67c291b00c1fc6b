"""Corpus queries: audits, filters, splits, leakage and text profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import corpus as C
from foliant.operators import layout as L
from foliant.operators import review as R
from foliant.operators import tables as B
from foliant.operators import transcode as Z
from foliant.plans.registry import query
from foliant.runtime import read_table
from foliant.sources import readers as S
from foliant.sources.engines import recognise


@query("""
select source, lang, count(*) as n, count(distinct sha256(text)) as n_texts, count(*) - count(text) as n_null
from documents group by 1, 2
""")
def q_audit_manifest(spark, sf_dir):
    """Rows, distinct text hashes and null texts per source and language."""
    d = read_table(spark, sf_dir, "documents")
    return d.groupBy("source", "lang").agg(
        F.count("*").alias("n"), F.countDistinct(F.sha2("text", 256)).alias("n_texts"), F.count_if(F.col("text").isNull()).alias("n_null"))


@query("select sha256(text) as text_sha256, min(doc_id) as doc_id, count(*) as n from documents where text is not null group by 1 having count(*) > 1")
def q_duplicate_signatures(spark, sf_dir):
    """Texts held more than once, with the first document of each."""
    d = read_table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1")


@query("""
with k as (select unnest(['slice','script','document_type','degradation','language','input_format']) as k),
s as (select m.row_id, trim(m.metadata[k.k], ' ') as v from manifest m, k)
select m.row_id, coalesce(string_agg(distinct v, ',' order by v), '') as slices
from manifest m left join s on s.row_id = m.row_id and v <> '' group by 1
""")
def q_entry_slices(spark, sf_dir):
    m = read_table(spark, sf_dir, "manifest")
    return m.select("row_id", F.array_join(C.entry_slices(F.col("metadata")), ",").alias("slices"))


@query("""
select s as slice, count(distinct sample_id) as n from (
  select sample_id, unnest(list_distinct(list_concat(coalesce(slices, []), ['all']))) as s from page_eval) where s is not null group by 1
""")
def q_slice_counts(spark, sf_dir):
    e = read_table(spark, sf_dir, "page_eval")
    spread = F.explode(F.array_distinct(F.concat(F.coalesce("slices", F.array().cast("array<string>")), F.array(F.lit("all")))))
    return e.select("sample_id", spread.alias("slice")).where("slice is not null").groupBy("slice").agg(F.countDistinct("sample_id").alias("n"))


@query("""
select row_id, sample_id from manifest
where trim(metadata['script'], ' ') = 'Devanagari' and trim(metadata['degradation'], ' ') = 'scan' and metadata['document_type'] in ('notice', 'primer')
""")
def q_filter_manifest(spark, sf_dir):
    m = read_table(spark, sf_dir, "manifest")
    kept = C.filter_entries(m, C.entry_slices(F.col("metadata")), all_of=["Devanagari", "scan"], document_types=["notice", "primer"])
    return kept.select("row_id", "sample_id")


@query("""
with u as (select sample_id, text from manifest union all select sample_id, text from synthesis_text)
select sample_id as key, count(*) as n from u where sample_id is not null group by 1 having count(*) > 1
""")
def q_merge_manifest(spark, sf_dir):
    """Ids that would collide when two manifests are merged."""
    parts = [read_table(spark, sf_dir, t).select("sample_id", "text") for t in ("manifest", "synthesis_text")]
    return C.merge(parts, "sample_id")[1]


_SIDES = """
with m as (select m.*, t.split as side from manifest m join split_target t on list_contains(t.spellings, m.split)),
v as (select side = 'train' as is_train, unnest([
  struct_pack(name := 'sample_id', value := sample_id), struct_pack(name := 'image_path', value := image_path),
  struct_pack(name := 'image_sha256', value := lower(sha256)), struct_pack(name := 'text_sha256', value := sha256(text)),
  struct_pack(name := 'sample_signature', value := sha256(coalesce(lower(sha256), '') || chr(10) || sha256(text)))]) as p from m)
"""


@query(_SIDES + """
select n.name, count(o.value) as n from (select unnest(['sample_id','image_path','image_sha256','text_sha256','sample_signature']) as name) n
left join (select p.name as name, p.value as value from v where p.value <> '' group by 1, 2 having count(distinct is_train) = 2) o on o.name = n.name group by 1
""")
def q_leakage_exact(spark, sf_dir):
    """Distinct values that train and the other splits share, for five keys in one pass."""
    names = read_table(spark, sf_dir, "split_target").select(F.explode("spellings").alias("spelling"), F.col("split").alias("side"))
    m = read_table(spark, sf_dir, "manifest").join(names, F.col("split") == F.col("spelling")).drop("split")
    m = m.select("side", "sample_id", "image_path", F.lower("sha256").alias("image_sha256"), F.sha2("text", 256).alias("text_sha256"))
    m = m.withColumn("sample_signature", F.sha2(F.concat(F.coalesce("image_sha256", F.lit("")), F.lit("\n"), F.col("text_sha256")), 256))
    keys = {k: k for k in ("sample_id", "image_path", "image_sha256", "text_sha256", "sample_signature")}
    return C.shared_values(m, F.col("side") == "train", keys)


@query("select doc_id, substr(sha256('split' || doc_id::varchar), 1, 8) < '1999999a' as is_held from documents")
def q_hash_split(spark, sf_dir):
    return C.hash_split(read_table(spark, sf_dir, "documents"), "doc_id", 0.10000000003).select("doc_id", "is_held")


@query("""
with r as (select doc_id, source, row_number() over (partition by source order by sha256('strata' || doc_id::varchar), doc_id) as rn, count(*) over (partition by source) as n from documents)
select doc_id, rn <= case when n > 1 then greatest(1, round_even(n * 0.1, 0)::bigint) else 0 end as is_held from r
""")
def q_stratified_split(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return C.stratified_split(d, "doc_id", "source", 0.1).select("doc_id", "is_held")


@query("""
with s as (select document_type, count(*) as n from documents where document_type is not null group by 1),
r as (select doc_id, document_type, row_number() over (partition by document_type order by doc_id) as rn from documents where document_type is not null),
c as (select r.doc_id, r.document_type, (select max(n) from s) // n + case when rn <= (select max(n) from s) % n then 1 else 0 end as c from r join s using (document_type))
select doc_id, document_type, unnest(range(0, c))::int as copy_no from c
""")
def q_rebalance(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").where("document_type is not null")
    return C.rebalance(d, "doc_id", "document_type")


@query("""
with p as (select sha256(concat_ws(chr(1), doc_id::varchar, coalesce(text, chr(0)))) as h, source from documents)
select source, count(*) as n, sum(('0x' || substr(h, 1, 8))::bigint)::bigint as d0, sum(('0x' || substr(h, 9, 8))::bigint)::bigint as d1, sum(('0x' || substr(h, 17, 8))::bigint)::bigint as d2 from p group by 1
""")
def q_digest(spark, sf_dir):
    """Order-independent digest of the documents of each source."""
    return C.digest(read_table(spark, sf_dir, "documents"), ["doc_id", "text"], ["source"])


@query(r"""
with t as (select coalesce(text, '') as t, source from documents),
c as (select source, regexp_matches(t, '[\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}]') as d, regexp_matches(t, '[A-Za-z]') as l, regexp_matches(t, '[\x{1900}-\x{194F}]') as b from t)
select source, count(*) as n, count_if(d) as contains_devanagari, count_if(l) as contains_latin, count_if(b) as contains_limbu,
  count_if(d and not l and not b) as devanagari_only, count_if(l and not d and not b) as latin_only, count_if(d and l) as mixed, count_if(not d and not l and not b) as other_only
from c group by 1
""")
def q_corpus_profile(spark, sf_dir):
    """Documents of each source by the scripts they hold, in one pass."""
    d = read_table(spark, sf_dir, "documents")
    t = F.coalesce("text", F.lit(""))
    d = d.select("source", t.rlike(X.DEVANAGARI).alias("d"), t.rlike(X.LATIN).alias("l"), t.rlike(X.LIMBU).alias("b"))
    only = lambda a, b, c: F.count_if(F.col(a) & ~F.col(b) & ~F.col(c))
    return d.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if("d").alias("contains_devanagari"), F.count_if("l").alias("contains_latin"), F.count_if("b").alias("contains_limbu"),
        only("d", "l", "b").alias("devanagari_only"), only("l", "d", "b").alias("latin_only"), F.count_if(F.col("d") & F.col("l")).alias("mixed"),
        F.count_if(~F.col("d") & ~F.col("l") & ~F.col("b")).alias("other_only"))


@query(r"""
select row_id, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(replace(text, chr(160), ' ')), '[\x{200C}\x{200D}]', '\0', 'g'), '[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}\x{00AD}\x{0600}-\x{0605}\x{061C}\x{06DD}\x{180E}\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}]', '', 'g'), '[ \t]+', ' ', 'g') as text from manifest
""")
def q_normalize_text(spark, sf_dir):
    m = read_table(spark, sf_dir, "manifest")
    return m.select("row_id", X.normalize(F.col("text")).alias("text"))


@query(r"select row_id, regexp_replace(text, '(\x{094D}) +([\x{0915}-\x{0939}])', '\1\2', 'g') as text from synthesis_text")
def q_devanagari_blanks(spark, sf_dir):
    return read_table(spark, sf_dir, "synthesis_text").select("row_id", X.repair_devanagari_blanks(F.col("text")).alias("text"))


@query(r"""
select row_id, len(regexp_extract_all(text, '[\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}]')) as n_devanagari, len(regexp_extract_all(text, '[A-Za-z]')) as n_latin,
  len(regexp_extract_all(text, '[\x{1900}-\x{194F}]')) as n_limbu, len(regexp_extract_all(text, '[0-9\x{0966}-\x{096F}]')) as n_digit from synthesis_text
""")
def q_script_counts(spark, sf_dir):
    t, n = F.col("text"), lambda p: X.char_count(F.col("text"), p).cast("long")
    d = read_table(spark, sf_dir, "synthesis_text")
    return d.where(t.isNotNull()).select("row_id", n(X.DEVANAGARI).alias("n_devanagari"), n(X.LATIN).alias("n_latin"), n(X.LIMBU).alias("n_limbu"), n(r"[0-9\x{0966}-\x{096F}]").alias("n_digit")).unionByName(
        d.where(t.isNull()).select("row_id", *[F.lit(None).cast("long").alias(c) for c in ("n_devanagari", "n_latin", "n_limbu", "n_digit")]))


@query(r"""
with c as (select conversion_id, len(regexp_extract_all(unicode_text, '[\x{1900}-\x{194F}]')) as n from limbu_conversion)
select conversion_id, coalesce(n, 0)::int as n_limbu from c
""")
def q_limbu_chars(spark, sf_dir):
    return read_table(spark, sf_dir, "limbu_conversion").select("conversion_id", X.char_count(F.col("unicode_text"), X.LIMBU).alias("n_limbu"))


@query("select c as ch, count(*) as n_docs from (select distinct doc_id, unnest(string_split(text, '')) as c from documents) where c <> '' group by 1")
def q_codepoint_inventory(spark, sf_dir):
    """Characters of the corpus and in how many documents each is. Distinct in the row, before the shuffle."""
    d = read_table(spark, sf_dir, "documents").where("text is not null")
    return d.select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n_docs"))


@query("""
with a as (select distinct unnest(string_split(text, '')) as c from documents), b as (select distinct unnest(string_split(text, '')) as c from synthesis_text)
select c as ch from a where c <> '' and c not in (select c from b)
""")
def q_dictionary_coverage(spark, sf_dir):
    """Characters of documents that a dictionary built from the other corpus lacks."""
    chars = lambda t: read_table(spark, sf_dir, t).where("text is not null").select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").distinct()
    return chars("documents").join(chars("synthesis_text"), "ch", "left_anti")


@query(r"""
select doc_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[^\s\x{0020}-\x{007E}\x{0900}-\x{097F}\x{1900}-\x{194F}]'))), ''), '') as unsupported from documents where text is not null
""")
def q_unsupported_characters(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").where("text is not null")
    found = F.regexp_extract_all("text", F.lit(r"[^\s\x{0020}-\x{007E}\x{0900}-\x{097F}\x{1900}-\x{194F}]"), F.lit(0))
    return d.select("doc_id", F.array_join(F.array_sort(F.array_distinct(found)), "").alias("unsupported"))


@query("select row_id, coalesce(length_grapheme(text), 0)::int as n_graphemes from synthesis_text")
def q_grapheme_counts(spark, sf_dir):
    return read_table(spark, sf_dir, "synthesis_text").select("row_id", X.grapheme_count("text").alias("n_graphemes"))


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null)
select doc_id, line_no::int as line_no, (28.0 * line_no)::double as y, greatest(50.0, 9.0 * length(text))::double as w from l where trim(text, ' ') <> ''
""")
def q_sidecar_geometry(spark, sf_dir):
    """Lines of documents with the geometry that a text has by itself."""
    return L.text_lines(read_table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text").select("doc_id", "line_no", "y", "w")


@query("""
with l as (select doc_id::varchar as source, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents)
select source, line_no::int as line_no, text from l where trim(text, ' ') <> ''
""")
def q_engine_lines(spark, sf_dir):
    """The text engine through the recogniser hook."""
    return recognise(read_table(spark, sf_dir, "documents"), "doc_id", "text").select("source", "line_no", "text")


@query(r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null),
t as (select doc_id, line_no::int as line_no, trim(text, ' ') as t from l where trim(text, ' ') <> '')
select doc_id, line_no, case when regexp_matches(t, '^#{1,6} ') then 'heading' when regexp_matches(t, '^\|?[\s:|-]*-{3,}[\s:|-]*\|?$') then 'separator' when regexp_matches(t, '^\|.*\|$') then 'table'
  when regexp_matches(t, '^([-*+] |[0-9]+[.)] )') then 'list' else 'text' end as kind, regexp_replace(t, '^(#{1,6}|[-*+]|[0-9]+[.)]) +', '') as text from t
""")
def q_markdown_blocks(spark, sf_dir):
    return S.markdown_blocks(read_table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")


_ROWS = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null),
t as (select doc_id, line_no::int as line_no, text from l where trim(text, ' ') <> '' and (contains(text, chr(9)) or regexp_matches(text, '^\s*\|.*\|\s*$') or len(regexp_split_to_array(trim(text, ' '), ' {2,}')) >= 3))
"""


@query(_ROWS + "select doc_id, line_no, text from t")
def q_table_lines(spark, sf_dir):
    lines = L.text_lines(read_table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")
    return lines.where(X.looks_like_table_line(F.col("text"))).select("doc_id", "line_no", "text")


@query(_ROWS + r""", r as (select doc_id, line_no, case when contains(text, chr(9)) then list_transform(string_split(text, chr(9)), lambda x: trim(x, ' '))
  when contains(text, '|') then list_transform(list_filter(string_split(text, '|'), lambda x: trim(x, ' ') <> ''), lambda x: trim(x, ' ')) else regexp_split_to_array(trim(text, ' '), ' {2,}') end as c
  from t where not regexp_matches(text, '^[\s|:\-+]+$'))
select doc_id, line_no, (generate_subscripts(c, 1) - 1)::int as col, unnest(c) as text from r
""")
def q_table_cells(spark, sf_dir):
    return B.cells(L.text_lines(read_table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text"), "doc_id")


@query(r"""
select row_id, case when regexp_matches(d, '^\d{4}-\d{2}-\d{2}$') then d when regexp_matches(d, '^\d{1,2}/\d{1,2}/\d{4}$')
  then concat_ws('-', regexp_extract(d, '^(\d{1,2})/(\d{1,2})/(\d{4})$', 3), lpad(regexp_extract(d, '^(\d{1,2})/(\d{1,2})/(\d{4})$', 2), 2, '0'), lpad(regexp_extract(d, '^(\d{1,2})/(\d{1,2})/(\d{4})$', 1), 2, '0')) end as published_on
from (select row_id, trim(translate(metadata['published_on'], '०१२३४५६७८९', '0123456789'), ' ') as d from manifest)
""")
def q_date_keys(spark, sf_dir):
    return read_table(spark, sf_dir, "manifest").select("row_id", X.date_key(F.col("metadata")["published_on"]).alias("published_on"))


@query(r"select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') as slug from part")
def q_slugs(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"))


@query(r"""
select conversion_id, replacement_count as n_replaced, array_to_string(list_sort(unmapped_codepoints), ' ') as unmapped,
  array_to_string(regexp_extract_all(nfc_normalize(unicode_text), '[\x{1900}-\x{194F}]'), '') as limbu from limbu_conversion
""")
def q_transcode(spark, sf_dir):
    """Legacy text converted by the rules: replacements and unknown signs must be those on record, and so must the Limbu letters of the text in their order."""
    rules = [(r[0], r[1], r[2]) for r in read_table(spark, sf_dir, "legacy_rule").select("rule_no", "source_bytes", "target_codepoints").collect()]  # fixed, 42 rows
    got = Z.transcode(read_table(spark, sf_dir, "limbu_conversion"), "legacy_text", Z.compile_rules(rules))
    return got.select("conversion_id", F.col("converted.n_replaced").alias("n_replaced"), F.array_join(F.array_sort("converted.unmapped"), " ").alias("unmapped"), F.array_join(F.regexp_extract_all("converted.text", F.lit(X.LIMBU), F.lit(0)), "").alias("limbu"))


@query("""
with p as (select legacy_text, unicode_text, count(*) as support from limbu_conversion where legacy_text is not null and unicode_text is not null group by 1, 2)
select legacy_text, unicode_text, support, count(*) over (partition by legacy_text) as n_clean, count(*) over (partition by legacy_text) > 1 as conflict from p
""")
def q_pair_profile(spark, sf_dir):
    """Noisy and clean texts of conversions, with those that conflict."""
    return R.pair_profile(read_table(spark, sf_dir, "limbu_conversion"), "legacy_text", "unicode_text").select("legacy_text", "unicode_text", "support", "n_clean", "conflict")


@query("""
select row_id, array_to_string(list_transform(string_split(text, ' '), lambda t: case when (case when t = 'the' then 'The' else t end) = 'The' then 'THE' else t end), ' ') as text from synthesis_text
""")
def q_rule_apply(spark, sf_dir):
    """Ordered token rules, the second on the output of the first."""
    return read_table(spark, sf_dir, "synthesis_text").select("row_id", F.when(F.col("text").isNotNull(), R.apply_rules(F.col("text"), [("the", "The"), ("The", "THE")])).alias("text"))


@query("""
with language_registry as (select id, case when priority % 3 = 0 then ' ' else name end as name, case when priority % 4 = 1 then left(iso_639_3, 2) else iso_639_3 end as iso_639_3,
  case when priority % 5 = 2 then [] else list_filter(aliases, lambda a: priority % 2 = 0 or a <> id) end as aliases, case when priority % 7 = 3 then [] else scripts end as scripts from main.language_registry)
select id as language_id, unnest(list_filter([
  case when coalesce(trim(name), '') = '' then 'missing_name' end, case when length(coalesce(iso_639_3, '')) <> 3 then 'bad_iso' end,
  case when len(list_filter(scripts, lambda s: s.is_primary)) <> 1 then 'primary_scripts' end, case when len(aliases) = 0 then 'no_alias' end,
  case when not list_contains(aliases, id) then 'id_is_no_alias' end], lambda x: x is not null)) as code from language_registry
""")
def q_registry_audit(spark, sf_dir):
    """The registry with defects put into some of its rows, and the codes of what is found."""
    g = read_table(spark, sf_dir, "language_registry")
    n = F.col("priority")
    g = g.select(
        "id", F.when(n % 3 == 0, " ").otherwise(F.col("name")).alias("name"), F.when(n % 4 == 1, F.left("iso_639_3", F.lit(2))).otherwise(F.col("iso_639_3")).alias("iso_639_3"),
        F.when(n % 5 == 2, F.array().cast("array<string>")).otherwise(F.filter("aliases", lambda a: (n % 2 == 0) | (a != F.col("id")))).alias("aliases"), F.when(n % 7 != 3, F.col("scripts")).otherwise(F.slice("scripts", 1, 0)).alias("scripts"))
    return R.issues(g.withColumnRenamed("id", "language_id"), ["language_id"], {
        "missing_name": F.coalesce(F.trim("name"), F.lit("")) == "", "bad_iso": F.length(F.coalesce("iso_639_3", F.lit(""))) != 3,
        "primary_scripts": F.size(F.filter("scripts", lambda s: s["is_primary"])) != 1, "no_alias": F.size("aliases") == 0, "id_is_no_alias": ~F.array_contains("aliases", F.col("language_id"))})


@query("""
select source_format, coalesce(source_schema_verified, false) as verified, count(*) as n, count(text_sha256) as n_hashed,
  count_if(coalesce(text_sha256, '') <> '' and lower(text_sha256) <> sha256(text)) as n_wrong_hash, count_if(coalesce(language, '') = '') as n_unlabelled from synthesis_text group by 1, 2
""")
def q_synthesis_summary(spark, sf_dir):
    s = read_table(spark, sf_dir, "synthesis_text")
    given = F.coalesce("text_sha256", F.lit(""))
    return s.groupBy("source_format", F.coalesce("source_schema_verified", F.lit(False)).alias("verified")).agg(
        F.count("*").alias("n"), F.count("text_sha256").alias("n_hashed"), F.count_if((given != "") & (F.lower(given) != F.sha2("text", 256))).alias("n_wrong_hash"),
        F.count_if(F.coalesce("language", F.lit("")) == "").alias("n_unlabelled"))
