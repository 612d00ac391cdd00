"""A training-data pipeline: quality, near-duplicates, benchmark contamination, personal data, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents. Nulls,
empty tables, repeated rows and extra columns are handled as each operator says.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from talentweave.llm import bpe, decontaminate, pii, quality, simhash
from talentweave.llm.common import cut, table, unused
from talentweave.llm.queries import tokenizer_path


def own(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def has_no_order(field: StructField) -> bool:
    return bool(re.search(r"\b(map<|variant\b)", field.dataType.simpleString()))


def in_order(docs: DataFrame) -> list[Column]:
    """The columns of docs as values that have an order: those that have none, such as maps, as JSON."""
    return [F.to_json(F.struct(c)) if has_no_order(f) else c for c, f in zip(own(docs), docs.schema, strict=True)]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality field scores 0.5 or more; it learns from the labels outside of the held-out third.
    Null and empty texts are scored like others, very long ones in full."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    field = quality.train(table(spark, sf_dir, "documents"), labels)
    out = unused(docs, "score")
    return quality.score(docs, field, out=out).where(F.col(out) >= 0.5).select(own(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: that with the smallest id (a null id comes last), then the smallest hash
    of its text; of rows equal in both the smallest in its columns' order (of maps by their JSON). Rows that share an id
    without being near duplicates all stay. Texts of any length count in full; those without words are one group."""
    named, key, text_hash = (unused(docs, c) for c in ("nameless", "id_key", "text_hash"))
    keys = {named: F.col("doc_id").isNull(), key: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_hash: F.xxhash64("text")}
    found = simhash.near_duplicates(docs.select("doc_id", "text", F.xxhash64("text").alias(text_hash)), also=(text_hash,))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", text_hash)).alias("first"))
    kept = first.select(F.col("first.nameless").alias(named), F.coalesce(F.col("first.doc_id").cast("string"), F.lit("")).alias(key), F.col(f"first.{text_hash}").alias(text_hash))
    # One exchange by id and text serves the join and the choice among repeated rows.
    rows = docs.withColumns(keys).join(kept, [named, key, text_hash], "left_semi")
    row, order = F.struct(*own(docs)), F.struct(*in_order(docs))
    first = F.min(row) if not any(has_no_order(f) for f in docs.schema) else F.min_by(row, order)
    return rows.groupBy(named, key, text_hash).agg(first.alias("row")).select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words at least a twentieth lie in benchmark passages go; all others stay as they are. Null and
    empty texts have no words and stay; very long ones are read whole."""
    boxed = docs.select(F.struct("*").alias("row"), "text")
    found = decontaminate.scan(boxed, table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select("row.*")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the personal data in its text replaced by its kind; n_chars follows a changed text. A null
    text stays null; very long ones are read whole."""
    spans = unused(docs, "spans")
    found = pii.find(docs, pii.train(spark), out=spans)
    hidden = pii.redact(found, spans=spans)
    return hidden.withColumn("n_chars", F.expr(f"if(size({spans}) > 0, cast(length(text) as bigint), n_chars)")).select(own(docs))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, their number and digests of the ids and of what they decode to. A null text is
    coded as an empty one; very long ones are coded whole."""
    decoded = unused(docs, "decoded")
    coded = bpe.encode(docs, tokenizer_path(), decoded=decoded)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    new = ("token_ids", "n_tokens", "ids_sha256", "decoded_sha256")
    return coded.select(
        *(c for c, name in zip(own(docs), docs.columns, strict=True) if name.lower() not in new),
        "token_ids",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_good),
    ("near-duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal-data", without_personal_data),
    ("tokens", as_tokens),
]

#: SQL expresses neither the field nor the automaton nor the vocabulary; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
