"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm import bpe, decontaminate, fingerprints, hard_negatives, html_extract, licenses, merkle, pii, quality, sharding, simhash, topk_search, toxicity
from talentweave.llm.common import cut, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return bpe.encode(docs, tokenizer_path(), decoded="decoded", drop=("text",)).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.col("hit_items").cast("array<string>"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


OP3_SQL = r"""
with words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), items as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
), starts as (
    select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from items where len(w) > 0
), windows as (
    select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as g from starts
), places as (
    select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, (select distinct n from windows) where len(w) >= n
), grams as (
    select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g from places
), hits as (
    select doc_id, i, n, item_id from grams join windows using (n, g)
), hit_words as (
    select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id
), hit_items as (
    select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as s from (select distinct doc_id, item_id::varchar as s from hits) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join hit_words using (doc_id) left join hit_items using (doc_id)
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.train(spark))
    counts = [F.expr(f"size(filter(spans, s -> s.rank = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(pii.BASE)]
    return found.select("doc_id", *counts, F.sha2(pii.as_text(base_only=True), 256).alias("base_sha256"), pii.as_text().alias("spans"))


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.train(docs, table(spark, sf_dir, "labels").where(_remainder(3) != 1))
    scored = quality.score(docs, field, drop=("text",))
    return scored.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.edited(table(spark, sf_dir, "documents"))
    sized = pairs.withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)})
    signed = fingerprints.fingerprint(fingerprints.fingerprint(sized, "text", "a", drop=("text",)), "edited", "b", drop=("edited",))
    own = cut(signed)
    # Of rows that share an id the least signature counts.
    after = own.groupBy(F.col("doc_id").alias("next")).agg(F.min("a").alias("c"))
    return own.join(after, "next", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.as_text("a").alias("fingerprint"),
        fingerprints.as_text("b").alias("edited_fingerprint"),
        fingerprints.likeness("a", "b").alias("near_edited"),
        fingerprints.likeness("a", "c").alias("near_next"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.train())
    spans = F.expr("array_join(transform(licenses, s -> concat_ws(':', s.paragraph, s.family, if(s.confirmed, 'confirmed', 'open'))), ',')")
    return found.select("doc_id", "license", F.size("licenses").cast("long").alias("n_paragraphs"), spans.alias("paragraphs"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    examples = toxicity.train(docs, table(spark, sf_dir, "labels").where(_remainder(5) != 0))
    scored = toxicity.score(docs, examples, drop=("text",))
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.array_join("neighbours", ",").alias("evidence"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


INTEGERS_SQL = """rows_ as (
    select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)"""

OP11_SQL = f"""
with {INTEGERS_SQL}, marked as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, v from rows_ where label is not null
), scored as (
    select a.vec_id as anchor_id, a.label = x.label as same, x.vec_id as id, list_dot_product(a.v, x.v)::bigint as score
    from marked a join marked x on a.vec_id % 50 = 0 and a.vec_id <> x.vec_id
), positives as (
    select anchor_id, id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, id))::int as rank,
    id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 3
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id are leaves like others and are never tampered with."""
    docs = table(spark, sf_dir, "documents")
    rest = ("doc_id", "source", "lang", "n_chars")
    lower = F.translate("text", UPPER, UPPER.lower())
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaf = merkle.digest(*rest, "text")
    tampered = F.when(hit, merkle.digest(*rest, lower)).otherwise(leaf)
    made = merkle.manifest(docs, leaf, key="doc_id", group="source", tampered=tampered)
    return made.withColumn("folded_root", merkle.folded("tampered")).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_FIELDS = ", ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-') as f{i + 1}" for i, c in enumerate(("doc_id", "source", "lang", "n_chars", "text", "lower_text")))
#: CRC-32 of a number's decimal digits.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(l.doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
            lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, k: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)))"""

OP12_SQL = f"""
with recursive docs as (
    select doc_id, source, lang, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_text from documents
), leaves as (
    select doc_id, source, sha256(f1 || f2 || f3 || f4 || f5) as leaf, sha256(f1 || f2 || f3 || f4 || f6) as lowered
    from (select doc_id, source, {_FIELDS} from docs)
), numbered as (
    select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from leaves
), nodes as (
    select source, 0 as lvl, i, n, leaf as node from numbered
    union all
    select source, lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(node, '' order by i)) from nodes where n > 1 group by source, lvl, i // 16, n
), subroots as (
    select source, lvl as h, node as subroot, row_number() over (order by source nulls first) - 1 as j, count(*) over () as m from nodes where n = 1
), tops as (
    select 0 as lvl, j as i, m as n, subroot as node from subroots
    union all
    select lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(node, '' order by i)) from tops where n > 1 group by lvl, i // 16, n
), runs as (
    select source, lvl, i, (select coalesce(string_agg(b.node, '' order by b.i), '') from nodes b where b.source is not distinct from a.source and b.lvl = a.lvl and b.i // 16 = a.i // 16 and b.i < a.i) as before,
        (select coalesce(string_agg(b.node, '' order by b.i), '') from nodes b where b.source is not distinct from a.source and b.lvl = a.lvl and b.i // 16 = a.i // 16 and b.i > a.i) as after
    from nodes a where n > 1
), top_runs as (
    select lvl, i, (select coalesce(string_agg(b.node, '' order by b.i), '') from tops b where b.lvl = a.lvl and b.i // 16 = a.i // 16 and b.i < a.i) as before,
        (select coalesce(string_agg(b.node, '' order by b.i), '') from tops b where b.lvl = a.lvl and b.i // 16 = a.i // 16 and b.i > a.i) as after
    from tops a where n > 1
), walk as (
    select l.doc_id, l.source, l.i as first, l.leaf, s.subroot, s.h, s.j, 0 as lvl, l.i as i, false as up, '' as proof,
        case when l.doc_id is not null and {_CRC} % 5 = 0 then l.lowered else l.leaf end as folded
    from numbered l join subroots s on s.source is not distinct from l.source
    union all
    select w.doc_id, w.source, w.first, w.leaf, w.subroot, w.h, w.j, case when w.up or w.lvl < w.h then w.lvl + 1 else 0 end,
        case when w.up or w.lvl < w.h then w.i // 16 else w.j end, w.up or w.lvl >= w.h,
        w.proof || coalesce(r.before || r.after, t.before || t.after, ''), case when r.before is not null then sha256(r.before || w.folded || r.after) when t.before is not null then sha256(t.before || w.folded || t.after) else w.folded end
    from walk w left join runs r on not w.up and w.lvl < w.h and r.source is not distinct from w.source and r.lvl = w.lvl and r.i = w.i
        left join top_runs t on w.up and t.lvl = w.lvl and t.i = w.i
    where not w.up or exists (select 1 from tops x where x.lvl = w.lvl and x.n > 1)
)
select doc_id, leaf, subroot, (select node from tops where n = 1) as root, sha256(proof) as proof_sha256, folded as folded_root, folded = (select node from tops where n = 1) as verified
from walk w where up and not exists (select 1 from tops x where x.lvl = w.lvl and x.n > 1)
"""


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = topk_search.search(topk_search.build(rows), rows.where("vec_id % 50 = 0"), k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP13_SQL = f"""
with {INTEGERS_SQL}
select q.vec_id as query_id, (row_number() over w)::int as rank, x.vec_id, list_dot_product(q.v, x.v)::bigint as score
from rows_ q join rows_ x on q.vec_id % 50 = 0 and q.vec_id <> x.vec_id
window w as (partition by q.vec_id order by list_dot_product(q.v, x.v) desc, x.vec_id)
qualify rank <= 5
"""


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_html": op2_html,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash": op4_simhash,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_fingerprints": op7_fingerprints,
    "op8_shards": op8_shards,
    "op9_licenses": op9_licenses,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle": op12_merkle,
    "op13_topk": op13_topk,
}
ORACLES = {"op3_decontaminate": OP3_SQL, "op11_hard_negatives": OP11_SQL, "op12_merkle": OP12_SQL, "op13_topk": OP13_SQL}
