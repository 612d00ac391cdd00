"""Queries of vector retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentweave.functions import lexicon as L
from talentweave.operators import retrieval as R
from talentweave.operators import vector_index as VI
from talentweave.plans import catalog as C
from talentweave.sources import scratch

PAIRS = """queries as (
    select vec_id as qid, embedding::double[] as q, case vec_id when 0 then 1.7 when 7 then 1.15 else 1.0 end::double as weight from embeddings where vec_id in (0, 7, 13, 21)
), pairs as (
    select qid, weight, vec_id as id, round(1 - list_cosine_similarity(q, embedding::double[]), 6) as dist from embeddings, queries
), hits as (
    select *, row_number() over (partition by qid order by dist, id) as rank from pairs qualify rank <= 30
), fused as (
    select id, round(sum(weight / (60 + rank)), 8) as score, min(rank)::int as first_rank, min(dist) as dist from hits group by id
), pool as (select * from fused order by score desc, first_rank, id limit 50
), ranked as (
    select pool.id, first_rank, dist, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as score
    from pool join embeddings e on e.vec_id = pool.id, (select embedding from embeddings where vec_id = 0) q
)"""


MANY = """many as (
    select q.vec_id as qid, e.vec_id as id, e.label, round(1 - list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as dist from embeddings q, embeddings e where q.vec_id % 50 = 0
)"""


def _store(spark: SparkSession, sf: str) -> DataFrame:
    return C.table(spark, sf, "embeddings")


def _one(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, sf).where("vec_id = 0").select("embedding")


def knn_topk(spark, sf):
    return R.knn(_store(spark, sf), C.query_vectors(spark, sf), id_col="vec_id").select("qid", "id", "dist", "rank")


def knn_filtered(spark, sf):
    store = R.metadata_filter(_store(spark, sf), {"label": [1, 2, 3], "vec_id": None})
    return R.knn(store, C.query_vectors(spark, sf), 5, id_col="vec_id").select("qid", "id", "dist", "rank")


def _index(spark, sf):
    return VI.build(_store(spark, sf), scratch.folder(spark), id_col="vec_id")


def _many(spark, sf):
    return _store(spark, sf).where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding", F.lit(1.0).alias("weight"))


def vector_index_topk(spark, sf):
    return VI.search(_index(spark, sf), _many(spark, sf)).select("qid", "id", "dist", "rank")


def vector_index_filtered(spark, sf):
    return VI.search(_index(spark, sf), _many(spark, sf), 5, where={"label": [1, 2, 3]}).select("qid", "id", "dist", "rank")


def vector_index_cells(spark, sf):
    """How many cells and vectors each query visits and what share of the store it leaves unread."""
    index = _index(spark, sf)
    n = sum(c[1] for c in index.cells)
    visits = VI.plan(index, _many(spark, sf), 5)[0]
    return visits.groupBy("qid").agg(F.count(F.lit(1)).alias("cells"), F.sum("vectors").alias("vectors"), F.round(1 - F.sum("vectors") / F.lit(n), 6).alias("pruned"))


def rrf_weighted(spark, sf):
    return R.fuse(R.knn(_store(spark, sf), C.query_vectors(spark, sf), id_col="vec_id"))


def rrf_unweighted(spark, sf):
    return R.fuse(R.knn(_store(spark, sf), C.query_vectors(spark, sf), id_col="vec_id"), pool=L.SIMPLE_POOL, weighted=False)


def _ranked(spark, sf):
    return R.rerank(rrf_weighted(spark, sf), _store(spark, sf), _one(spark, sf), id_col="vec_id", bounded=True)


def rerank_cosine(spark, sf):
    return _ranked(spark, sf).select("id", "first_rank", "score")


def semantic_search_pipeline(spark, sf):
    return R.semantic_search(_store(spark, sf), C.query_vectors(spark, sf), _one(spark, sf), id_col="vec_id").select("id", "first_rank", "score")


def filtered_search_pipeline(spark, sf):
    return R.filtered_search(_store(spark, sf), C.query_vectors(spark, sf), _one(spark, sf), {"label": [1, 2, 3]}, id_col="vec_id").select("id", "first_rank", "dist", "score")


def mmr_select(spark, sf):
    pool = _ranked(spark, sf).select(F.lit(0).alias("qid"), "id", "score")
    return R.mmr(pool.join(_store(spark, sf).select(F.col("vec_id").alias("id"), "embedding"), "id"))


def fallback_nearest(spark, sf):
    ranked = _ranked(spark, sf).select("id", "dist", "score")
    return R.with_fallback(ranked.where("score > 2"), ranked, 10)


def fallback_not_needed(spark, sf):
    ranked = _ranked(spark, sf).select("id", "dist", "score")
    return R.with_fallback(ranked.where(F.col("dist") <= L.KEEP_DISTANCE), ranked, 10)


def _hits(spark, sf):
    e = _store(spark, sf).select(F.col("vec_id").alias("id"), F.concat(F.lit("file"), F.col("label")).alias("source"), (F.col("vec_id") % 9).cast("int").alias("page"))
    return R.distances(_store(spark, sf), C.query_vectors(spark, sf).where("qid = 0"), id_col="vec_id").select("id", F.round(1 - F.col("dist"), 6).alias("score")).join(e, "id").where("score > 0")


HITS = PAIRS + """, sources as (
    select id, round(1 - dist, 6) as score, 'file' || label as source, (id % 9)::int as page from pairs join embeddings on vec_id = id where qid = 0 and round(1 - dist, 6) > 0)"""


def source_rollup(spark, sf):
    return R.top_source(_hits(spark, sf)).select("source", "best", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


def top_source(spark, sf):
    return _hits(spark, sf).groupBy().agg(F.max_by("source", F.struct("score", "source")).alias("source"), F.max("score").alias("best"))


def lateral_topk_per_scope(spark, sf):
    hits = _hits(spark, sf)
    order = Window.partitionBy("source").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("source", "id", "score", "rank")


def context_by_person(spark, sf):
    d = C.table(spark, sf, "documents")
    chunks = d.select(F.col("source").alias("email"), F.col("doc_id").alias("id"), "text", (F.col("n_chars") % 1000).alias("score"))
    return R.context_by_person(chunks, 3)


def skill_post_filter(spark, sf):
    e = C.table(spark, sf, "events").select("event_id", F.from_json(F.concat(F.lit('["'), "event_type", F.lit('"]')), "array<string>").alias("m"), F.split(F.lit("SQL, Git"), ", ").alias("s"))
    return R.skill_filter(e, F.col("m"), F.col("s"), ["Click", "python"]).select("event_id")


def query_variants(spark, sf):
    q = C.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_type", F.when(F.col("p_partkey") % 3 == 0, " developer and Engineer with ").when(F.col("p_partkey") % 3 == 1, " engineer ").otherwise(""), "p_brand").alias("question"))
    return R.variants(q)


def distinct_ignoring_case(spark, sf):
    """Of each customer the first order of each priority, whatever its case."""
    o = C.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("priority"))
    return R.distinct_texts(o, "priority", ["o_custkey"], ["o_orderkey"])


def rerank_model(spark, sf):
    """The pool with scores of a model: a number that some rows' labels stand for."""
    scores = _store(spark, sf).where("label <> 3").select(F.col("vec_id").alias("id"), ((F.col("label") - 1) / F.lit(7.0)).alias("score"))
    return R.rerank_by(rrf_weighted(spark, sf), scores, 40).select("id", "first_rank", F.round("score", 6).alias("score"))


def chunk_recursive(spark, sf):
    return R.chunk_texts(C.table(spark, sf, "documents"))


def chunk_dedupe_sha1(spark, sf):
    d = C.table(spark, sf, "documents").select("doc_id", F.lit(0).alias("chunk_no"), F.col("text").alias("chunk"))
    return R.distinct_chunks(d).select("sha1", "doc_id")


def min_length_filter(spark, sf):
    return C.table(spark, sf, "documents").where(F.length(F.trim("text")) >= L.LEAST_CHUNK).select("doc_id", "n_chars")


QUERIES = {f.__name__: f for f in (knn_topk, knn_filtered, vector_index_topk, vector_index_filtered, vector_index_cells, rrf_weighted, rrf_unweighted, rerank_cosine, semantic_search_pipeline, filtered_search_pipeline, mmr_select, fallback_nearest, fallback_not_needed, source_rollup, top_source, lateral_topk_per_scope, context_by_person, skill_post_filter, query_variants, distinct_ignoring_case, rerank_model, chunk_recursive, chunk_dedupe_sha1, min_length_filter)}

ORACLES = {
    "filtered_search_pipeline": f"""with {PAIRS}, fh as (select p.qid, p.id, row_number() over (partition by qid order by dist, id) as rank from pairs p join embeddings e on e.vec_id = p.id where label in (1, 2, 3) qualify rank <= 30),
        ff as (select id, round(sum(1.0::double / (60 + rank)), 8) as s, min(rank)::int as first_rank from fh group by id order by s desc, first_rank, id limit 30),
        fr as (select ff.id, first_rank, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as score from ff join embeddings e on e.vec_id = ff.id, (select embedding from embeddings where vec_id = 0) q),
        top as (select id, first_rank, round(1 - score, 6) as dist, score from fr order by score desc, first_rank, id limit 10) select * from top where dist <= 0.9""",
    "knn_topk": f"with {PAIRS} select qid, id, dist, rank::int as rank from hits",
    "knn_filtered": f"with {PAIRS} select qid, id, dist, row_number() over (partition by qid order by dist, id)::int as rank from pairs join embeddings on vec_id = id where label in (1, 2, 3) qualify rank <= 5",
    "vector_index_topk": f"with {MANY} select qid, id, dist, row_number() over (partition by qid order by dist, id)::int as rank from many qualify rank <= 30",
    "vector_index_filtered": f"with {MANY} select qid, id, dist, row_number() over (partition by qid order by dist, id)::int as rank from many where label in (1, 2, 3) qualify rank <= 5",
    "rrf_weighted": f"with {PAIRS} select id, score, first_rank, dist from pool",
    "rrf_unweighted": f"with {PAIRS} select id, round(sum(1.0::double / (60 + rank)), 8) as score, min(rank)::int as first_rank, min(dist) as dist from hits group by id order by score desc, first_rank, id limit 30",
    "rerank_cosine": f"with {PAIRS} select id, first_rank, score from ranked",
    "semantic_search_pipeline": f"with {PAIRS} select id, first_rank, score from ranked where score > 0.15 order by score desc, first_rank, id limit 10",
    "fallback_nearest": f"with {PAIRS} select id, dist, score from ranked order by dist, id limit 10",
    "fallback_not_needed": f"with {PAIRS} select id, dist, score from ranked where dist <= 0.95",
    "source_rollup": f"with {HITS} select source, max(score) as best, array_to_string(list_sort(list_distinct(list(page))), ',') as pages from sources group by source",
    "top_source": f"with {HITS} select source, score as best from sources order by score desc, source desc limit 1",
    "lateral_topk_per_scope": f"with {HITS} select source, id, score, row_number() over (partition by source order by score desc, id)::int as rank from sources qualify rank <= 3",
    "context_by_person": "select email, string_agg(text, chr(10) order by rank) as context from (select source as email, text, row_number() over (partition by source order by n_chars % 1000 desc, doc_id) as rank from documents qualify rank <= 3) group by email",
    "skill_post_filter": "select event_id from events where event_type = 'click'",
    "query_variants": """with q as (select p_partkey as id, trim(p_type || case p_partkey % 3 when 0 then ' developer and Engineer with ' when 1 then ' engineer ' else '' end || p_brand) as q from part),
        m as (select id, q, unnest([q, replace(q, 'developer', 'engineer'), replace(q, 'engineer', 'developer'), q || ' projects', q || ' experience', q || ' resume', q || ' skills', replace(q, ' and ', ' & '), replace(q, ' with ', ' using ')]) as variant, unnest(range(9)) as p from q),
        f as (select * from m qualify row_number() over (partition by id, lower(variant) order by p) = 1), k as (select id, q, variant, row_number() over (partition by id order by p)::int as pos from f qualify pos <= 5)
        select id, pos, variant from k union all select id, (max(pos) + 1)::int, q from k group by id, q having lower(arg_max(variant, pos)) <> lower(q)""",
    "distinct_ignoring_case": "select o_custkey, o_orderkey, case when o_orderkey % 2 = 0 then lower(o_orderpriority) else o_orderpriority end as priority from orders qualify row_number() over (partition by o_custkey, lower(o_orderpriority) order by o_orderkey) = 1",
    "rerank_model": f"with {PAIRS} select id, first_rank, round(coalesce(case when label <> 3 then greatest(0, least(1, (label - 1) / 7.0::double)) end, 0), 6) as score from (select * from pool order by score desc, first_rank, id limit 40) p join embeddings on vec_id = id",
    "chunk_dedupe_sha1": "select sha1(text) as sha1, min(doc_id) as doc_id from documents where length(trim(text)) >= 60 group by 1",
    "min_length_filter": "select doc_id, n_chars from documents where length(trim(text)) >= 60",
}
