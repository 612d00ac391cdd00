"""The driver's tables, and the domain's tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Query vectors of the retrieval queries, with their weights.
QUERY_VECTORS = ((0, 1.7), (7, 1.15), (13, 1.0), (21, 1.0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> None:
    """All tables as temporary views."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, embedding, weight) of the stated query vectors."""
    weight = F.coalesce(*[F.when(F.col("vec_id") == i, F.lit(w)) for i, w in QUERY_VECTORS])
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin([i for i, _ in QUERY_VECTORS])).select(F.col("vec_id").alias("qid"), "embedding", weight.alias("weight"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidates: the segment is the stage, the balance the score (null below zero)."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("full_name"), F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@example.com")).alias("primary_email"),
        F.col("c_mktsegment").alias("stage_of_process"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("job_score"), F.col("c_nationkey").alias("job_id"),
    )


PEOPLE_SQL = """people as (
    select c_custkey as candidate_id, c_name as full_name, lower(replace(c_name, '#', '')) || '@example.com' as primary_email,
        c_mktsegment as stage_of_process, case when c_acctbal >= 0 then c_acctbal end as job_score, c_nationkey as job_id from customer)"""


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as availability: an hour from ts, of one of fifty interviewers; clicks are free."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("interviewer_id"), F.col("ts").alias("start_ts"), F.expr("ts + interval 60 minutes").alias("end_ts"),
        F.when(F.col("event_type") == "click", F.lit("free")).otherwise(F.lit("booked")).alias("status"),
    )


SLOTS_SQL = """slots as (
    select event_id as id, user_id % 50 as interviewer_id, ts as start_ts, ts + interval 60 minute as end_ts,
        case when event_type = 'click' then 'free' else 'booked' end as status from events)"""


def interviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("interviewer_id"), F.col("s_name").alias("full_name"), F.lit("1").alias("job_id"), (F.col("s_acctbal") > 0).alias("is_active"))


INTERVIEWERS_SQL = "interviewers as (select s_suppkey as interviewer_id, s_name as full_name, '1' as job_id, s_acctbal > 0 as is_active from supplier)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents in order, with a page of forty lines and a made-up size."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return d.select("doc_id", "line_no", (F.floor(F.col("line_no") / 40) + 1).cast("int").alias("page"), "text", (8 + F.length("text") % 7).cast("double").alias("font_size"))


LINES_SQL = """lines as (
    select doc_id, line_no::int as line_no, (line_no // 40 + 1)::int as page, text, (8 + length(text) % 7)::double as font_size
    from (select doc_id, unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10))))) as line_no from documents))"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, word): the distinct words of a document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-z]+"))).alias("word")).where("word <> ''")


WORDS_SQL = """words as (
    select doc_id, lang, source, word from (select doc_id, lang, source, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+'))) as word from documents) where word <> '')"""
