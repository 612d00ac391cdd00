"""Queries of scalar text functions, hashes, dictionaries and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentweave.functions import fuzzy
from talentweave.functions import lexicon as L
from talentweave.functions import text as X
from talentweave.operators import matching as M
from talentweave.plans import catalog as C

_ESCAPED_EMAIL = L.EMAIL.replace("'", "''")


def _docs(spark, sf):
    return C.table(spark, sf, "documents")


def normalize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha1(X.collapse(F.col("text"))).alias("digest"), F.length(X.collapse(F.col("text"))).alias("n"))


def lower_norm(spark, sf):
    return C.table(spark, sf, "part").select("p_partkey", X.plain_norm(F.concat(F.lit("  "), "p_name", F.lit(" \t x "))).alias("name"))


def contacts_extract(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", F.array_join(X.emails(t), ",").alias("emails"), F.size(X.urls(t)).alias("n_urls")).where("emails <> '' or n_urls > 0")


def phone_normalize(spark, sf):
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("+"), F.col("c_custkey") + 91000000000)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("98765-"), F.lpad("c_custkey", 5, "0"))).otherwise(F.concat(F.lit("12 34-56"), F.col("c_custkey") % 100))
    c = C.table(spark, sf, "customer").select("c_custkey", raw.alias("raw"))
    return c.select("c_custkey", X.valid_phone(F.col("raw")).alias("valid"), X.normal_phone(F.col("raw")).alias("phone"))


def phones_of_lines(spark, sf):
    return C.lines(spark, sf).where(F.col("text").rlike("[0-9]{3}")).select("doc_id", "line_no", F.array_join(X.phones(F.col("text")), ",").alias("phones"))


def skills_dictionary(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.array_join(X.skills(F.col("text"), ["and", "tion", "the", "sql", "c", "er"]), ",").alias("skills"))
    return d


def metrics_extract(spark, sf):
    p = C.table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", F.lit("cut cost by"), F.col("p_size").cast("string"), F.lit("% at"), F.concat(F.col("p_size") * 20, F.lit(" QPS")), F.lit("with p99 = 45 ms")).alias("t"))
    m = X.metrics(F.col("t"))
    return p.select("p_partkey", m["percent"].alias("percent"), m["throughput_qps"].alias("qps"), m["latency_p99_ms"].alias("p99"))


def gpa_and_degree(spark, sf):
    s = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "B.Tech in CS ").when(F.col("s_suppkey") % 3 == 1, "M.E. in EE, B.E. before ").otherwise("Diploma "), F.concat(F.lit("CGPA "), F.col("s_suppkey") % 10, F.lit("."), F.col("s_suppkey") % 7, F.lit("/10")))
    t = C.table(spark, sf, "supplier").select("s_suppkey", s.alias("t"))
    return t.select("s_suppkey", X.gpa(F.col("t")).alias("gpa"), X.degree_level(F.col("t")).alias("level"))


def language_levels(spark, sf):
    t = C.table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("English (fluent), "), F.when(F.col("n_nationkey") % 2 == 0, "French").otherwise("Tamil (basic)")).alias("t"))
    return t.select("n_nationkey", F.array_join(F.transform(X.languages(F.col("t")), lambda s: F.concat_ws(":", s["name"], s["level"])), ",").alias("languages"))


def season_to_month(spark, sf):
    o = C.table(spark, sf, "orders")
    name = F.coalesce(*[F.when(F.col("o_orderkey") % 4 == i, F.lit(s)) for i, s in enumerate(("Spring", "Summer", "Fall", "Winter"))])
    t = F.concat(name, F.lit(" '"), F.date_format("o_orderdate", "yy"))
    return o.select("o_orderkey", X.season_to_month(t).alias("month"))


def date_ranges(spark, sf):
    o = C.table(spark, sf, "orders")
    end = F.when(F.col("o_orderkey") % 2 == 0, F.lit("Present")).otherwise(F.date_format(F.col("o_orderdate") + F.expr("interval 400 days"), "MMM yyyy"))
    o = o.select("o_orderkey", X.date_range(F.concat(F.date_format("o_orderdate", "MMM yyyy"), F.lit(" - "), end)).alias("r"))
    return o.select("o_orderkey", F.col("r.start").alias("start_month"), F.col("r.end").alias("end_month"), "r.is_current")


def iso_date_pad(spark, sf):
    o = C.table(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy"))
    return o.select("o_orderkey", F.to_date(X.iso_date(raw)).alias("day"))


def short_hash_ids(spark, sf):
    return C.table(spark, sf, "customer").select("c_custkey", X.short_id("cand", F.col("c_name"), F.lit(None).cast("string"), F.col("c_custkey")).alias("id"))


def document_hashes(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", X.document_hash(F.split("text", "\n")).alias("hash"))


def paths(spark, sf):
    p = F.concat(F.lit("/data/in/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("."), F.lower("p_type"), F.lit(".PDF"))
    t = C.table(spark, sf, "part").select("p_partkey", p.alias("p"))
    return t.select("p_partkey", X.basename(F.col("p")).alias("base"), X.stem(F.col("p")).alias("stem"), X.extension(F.col("p")).alias("extension"))


def json_array_contains(spark, sf):
    e = C.table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["'), "event_type", F.lit('","sql"]'))).otherwise(F.concat("event_type", F.lit(" / git | sql")))
    own = e.select("event_id", X.json_or_raw(raw).alias("items"))
    return own.where(F.array_contains("items", "click")).select("event_id", F.array_join("items", ",").alias("items"))


def json_properties(spark, sf):
    e = C.table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").alias("n"))


def requirements_split(spark, sf):
    p = C.table(spark, sf, "part").select("p_partkey", F.explode(X.requirements(F.concat_ws(" , ", "p_brand", "p_type"))).alias("requirement"))
    return p


def row_rendering(spark, sf):
    n = C.table(spark, sf, "nation")
    return n.select("n_nationkey", X.row_text(F.array(F.col("n_name"), F.lit(None).cast("string"), F.col("n_regionkey").cast("string"))).alias("row"), X.bullet_row(("name", F.col("n_name")), ("none", F.lit(None).cast("string")), ("region", F.col("n_regionkey"))).alias("bullet"))


def score_parse(spark, sf):
    e = C.table(spark, sf, "embeddings")
    return e.select("vec_id", X.score_of(F.concat(F.lit("Score: 0."), F.col("vec_id") % 97, F.lit(" of 1"))).alias("score"))


def years_regex(spark, sf):
    p = C.table(spark, sf, "part")
    return p.select("p_partkey", X.years_of_experience(F.concat(F.lit("needs "), "p_size", F.lit("+ years"))).alias("years"))


def hyphen_unwrap(spark, sf):
    p = C.table(spark, sf, "part")
    return p.select("p_partkey", X.unwrap_hyphens(F.concat(F.col("p_type"), F.lit("-\n"), F.lower("p_brand"))).alias("text"))


def spaced_caps(spark, sf):
    n = C.table(spark, sf, "nation")
    return n.select("n_nationkey", X.join_spaced_caps(F.concat(F.lit("A M A N "), F.substring("n_name", 1, 1), F.lit(" "), F.lit("INGH"))).alias("name"))


def compact_lists(spark, sf):
    o = C.table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("p"))
    return o.select("o_custkey", F.array_join(X.merge_skills(F.col("p"), F.array(F.lit("SQL "), F.lit("c"), F.lit("R"))), ",").alias("merged"))


def nfkc_form(spark, sf):
    p = C.table(spark, sf, "nation")
    return p.select("n_nationkey", fuzzy.normal_form(F.concat(F.lit("ﬁ ①"), "n_name")).alias("text"))


def fuzzy_name_match(spark, sf):
    tokens = spark.createDataFrame([(0, "customer#000000012"), (1, "custmer#000000034"), (2, "000000999")], "pos int, token string")
    c = C.people(spark, sf).select("full_name", F.col("primary_email").alias("email"))
    return M.fuzzy_names(tokens, c, 92)


def fuzzy_name_join(spark, sf):
    """The words of all parts' types, a letter left out, against the words of all texts, by text."""
    words = F.explode(F.split(F.lower("p_type"), " ")).alias("w")
    tokens = C.table(spark, sf, "part").select("p_partkey", words).groupBy("w").agg(F.min("p_partkey").alias("pos")).select("pos", F.concat(F.substring("w", 1, 3), F.substring("w", 5, 100)).alias("token"))
    names = C.words(spark, sf).select("word").distinct().select(F.col("word").alias("full_name"), F.col("word").alias("email"))
    return M.fuzzy_names(tokens, names, 85)


def entity_extract(spark, sf):
    p = C.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", F.lit("pythn developer"), "p_type", "p_name").alias("text"))
    return M.vocabulary_hits(p, L.SKILLS, L.SKILL_CUTOFF, 3).select("id", F.array_join("hits", ",").alias("hits"))


def _misspelt(spark, sf):
    w = C.words(spark, sf).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    return w


def spell_correct(spark, sf):
    """Every word that is not in the dictionary."""
    w = _misspelt(spark, sf)
    dictionary = w.where("freq >= 20").select(F.col("word").alias("term"), "freq")
    return M.spell(w.where("freq < 20"), dictionary)


def name_tokens(spark, sf):
    c = C.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.size(M.name_tokens(F.coalesce("text", F.lit("")))).alias("n"))


def bullets_and_blocks(spark, sf):
    d = _docs(spark, sf)
    text = F.concat(F.lit("• first\n- second part\n"), F.col("text"), F.lit("\n\nnext"))
    return d.select("doc_id", F.size(X.bullets(text)).alias("n_bullets"), F.size(X.blocks(text)).alias("n_blocks"), F.get(X.bullets(text), F.lit(1)).alias("second"))


def query_entities(spark, sf):
    p = C.table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", F.when(F.col("p_partkey") % 2 == 0, "python, spark and aws").otherwise("backend enginer"), F.lit("role with"), "p_size", F.lit("+ years, mtech")).alias("question"))
    return M.query_entities(p).select("p_partkey", F.array_join("skills", ",").alias("skills"), F.array_join("roles", ",").alias("roles"), F.array_join("degrees", ",").alias("degrees"), F.array_join("sections", ",").alias("sections"), "min_years")


def section_hints(spark, sf):
    n = C.table(spark, sf, "nation").select("n_nationkey", F.concat(F.when(F.col("n_nationkey") % 2 == 0, "Projects and awards of ").otherwise("Degree or tech stack of "), "n_name").alias("question"))
    return M.query_entities(n).select("n_nationkey", F.array_join("sections", ",").alias("sections"))


def skill_categories(spark, sf):
    o = C.table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("p"))
    return o.select("o_custkey", F.array_join(X.categories(F.col("p"))["General"], ",").alias("general"))


def project_highlights(spark, sf):
    p = C.table(spark, sf, "part")
    return p.select("p_partkey", F.array_join(X.highlights(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")), F.array(F.col("p_brand"), F.lit(""), F.lit(None).cast("string"))), "|").alias("highlights"))


def stamps_and_follow_ups(spark, sf):
    o = C.table(spark, sf, "orders")
    return o.select("o_orderkey", X.utc_stamp(F.col("o_orderdate")).alias("stamp"), X.compose_follow_up(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("follow_up"), X.first_filled(F.nullif(F.col("o_orderstatus"), F.lit("O")), F.lit(""), F.col("o_orderpriority")).alias("first"), F.substring(F.repeat("o_orderpriority", 3), 1, 20).alias("short"))


QUERIES = {f.__name__: f for f in (query_entities, section_hints, skill_categories, project_highlights, stamps_and_follow_ups, normalize_text, lower_norm, contacts_extract, phone_normalize, phones_of_lines, skills_dictionary, metrics_extract, gpa_and_degree, language_levels, season_to_month, date_ranges, iso_date_pad, short_hash_ids, document_hashes, paths, json_array_contains, json_properties, requirements_split, row_rendering, score_parse, years_regex, hyphen_unwrap, spaced_caps, compact_lists, nfkc_form, fuzzy_name_match, fuzzy_name_join, entity_extract, spell_correct, name_tokens, bullets_and_blocks)}

ORACLES = {
    "nfkc_form": "select n_nationkey, 'fi 1' || n_name as text from nation",
    "name_tokens": r"""select conv_id, turn, len(list_filter(list_transform(regexp_split_to_array(lower(trim(coalesce(text, ''))), '\s+'), lambda w: regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')), lambda w: length(w) >= 3 and w not in ('the', 'and', 'for', 'with', 'who', 'what', 'are')))::int as n from conversations""",
    "section_hints": "select n_nationkey, case when n_nationkey % 2 = 0 then 'achievement,project' else 'education,skills' end as sections from nation",
    "skill_categories": "select o_custkey, array_to_string(list_sort(list(distinct o_orderpriority)), ',') as general from orders group by o_custkey",
    "project_highlights": "select p_partkey, concat_ws('|', case when p_partkey % 2 = 0 then p_name end, p_brand) as highlights from part",
    "stamps_and_follow_ups": "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as stamp, 'Previous question: ' || o_orderstatus || chr(10) || 'Follow-up: ' || o_orderpriority as follow_up, case when o_orderstatus <> 'O' then o_orderstatus else o_orderpriority end as first, substring(repeat(o_orderpriority, 3), 1, 20) as short from orders",
    "normalize_text": r"select doc_id, sha1(t) as digest, length(t)::int as n from (select doc_id, trim(regexp_replace(text, '[\s\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) as t from documents)",
    "lower_norm": "select p_partkey, lower(p_name) || ' x' as name from part",
    "contacts_extract": rf"select doc_id, array_to_string(regexp_extract_all(text, '{_ESCAPED_EMAIL}'), ',') as emails, len(regexp_extract_all(text, '(https?://\S+|www\.\S+)'))::int as n_urls from documents where array_to_string(regexp_extract_all(text, '{_ESCAPED_EMAIL}'), ',') <> '' or len(regexp_extract_all(text, '(https?://\S+|www\.\S+)')) > 0",
    "phone_normalize": """select c_custkey, case c_custkey % 3 when 2 then false else true end as valid,
        case c_custkey % 3 when 0 then '+' || (c_custkey + 91000000000) when 1 then '+91 98765' || lpad(c_custkey::varchar, 5, '0') else '123456' || (c_custkey % 100) end as phone from customer""",
    "skills_dictionary": "select doc_id, array_to_string(list_filter(['and', 'er', 'sql', 'the', 'tion'], lambda s: contains(lower(text), s)), ',') as skills from documents",
    "metrics_extract": "select p_partkey, p_size as percent, case when p_size >= 1 then p_size * 20 end as qps, 45 as p99 from part",
    "gpa_and_degree": "select s_suppkey, (s_suppkey % 10) || '.' || (s_suppkey % 7) || '/10' as gpa, case s_suppkey % 3 when 0 then 'bachelors' when 1 then 'masters' end as level from supplier",
    "language_levels": "select n_nationkey, case when n_nationkey % 2 = 0 then 'English:fluent,French' else 'English:fluent,Tamil:basic' end as languages from nation",
    "season_to_month": "select o_orderkey, '20' || strftime(o_orderdate, '%y') || case o_orderkey % 4 when 0 then '-03' when 1 then '-06' when 2 then '-09' else '-12' end as month from orders",
    "date_ranges": "select o_orderkey, strftime(o_orderdate, '%Y-%m') as start_month, case when o_orderkey % 2 = 1 then strftime(o_orderdate + interval 400 day, '%Y-%m') end as end_month, o_orderkey % 2 = 0 as is_current from orders",
    "iso_date_pad": "select o_orderkey, case o_orderkey % 3 when 0 then o_orderdate::date when 1 then date_trunc('month', o_orderdate)::date end as day from orders",
    "short_hash_ids": "select c_custkey, 'cand_' || substring(sha1(c_name || '||' || c_custkey), 1, 10) as id from customer",
    "document_hashes": "select doc_id, 'sha256:' || sha256(array_to_string(string_split(text, chr(10)), chr(10) || chr(10))) as hash from documents",
    "paths": "select p_partkey, replace(p_brand, '#', '-') || '.' || lower(p_type) || '.PDF' as base, replace(p_brand, '#', '-') || '.' || lower(p_type) as stem, '.pdf' as extension from part",
    "json_array_contains": "select event_id, case when event_id % 2 = 0 then 'click,sql' else 'click,git,sql' end as items from events where event_type = 'click'",
    "json_properties": "select event_id, json_extract_string(props, '$.k') as k, length(props)::int as n from events",
    "requirements_split": "select p_partkey, unnest([p_brand, p_type]) as requirement from part",
    "row_rendering": "select n_nationkey, '| ' || n_name || ' |  | ' || n_regionkey || ' |' as row, '- name: ' || n_name || ', region: ' || n_regionkey as bullet from nation",
    "score_parse": "select vec_id, ('0.' || (vec_id % 97))::double as score from embeddings",
    "years_regex": "select p_partkey, p_size as years from part",
    "hyphen_unwrap": "select p_partkey, p_type || lower(p_brand) as text from part",
    "spaced_caps": "select n_nationkey, case when substring(n_name, 1, 1) = upper(substring(n_name, 1, 1)) then 'AMAN' || substring(n_name, 1, 1) || ' INGH' else 'AMAN ' || substring(n_name, 1, 1) || ' INGH' end as name from nation",
    "compact_lists": "select o_custkey, array_to_string(list_sort(list_distinct(list_concat(list(lower(trim(o_orderpriority))), ['sql', 'r']))), ',') as merged from orders group by o_custkey",
}
