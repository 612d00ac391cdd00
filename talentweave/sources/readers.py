"""Sources and sinks: files by extension, nested JSON, lines, manifests, text and table writers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.functions import text as X

#: Extensions that are documents.
EXTENSIONS = (".pdf", ".docx", ".txt")
LINES = """
meta STRUCT<source_path:STRING, pages:INT>,
lines ARRAY<STRUCT<page:INT, text:STRING, bbox:ARRAY<DOUBLE>, left_indent:DOUBLE, width:DOUBLE, is_bold:BOOLEAN, font_size:DOUBLE, column:INT>>
"""


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, most_bytes: int | None = None) -> DataFrame:
    """(path, name, extension, length, mtime) of a folder's visible documents, not of its subfolders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "modificationTime", "length")
    named = files.select("path", X.basename(F.col("path")).alias("name"), X.extension(F.col("path")).alias("extension"), "length", F.col("modificationTime").alias("mtime"))
    named = named.where(F.col("extension").isin(*extensions) & ~F.col("name").startswith("."))
    return named.where(F.col("length") <= most_bytes) if most_bytes else named


def manifest(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, name, sha1, mtime) of a folder's documents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return files.where(X.extension(F.col("path")).isin(*extensions)).select("path", X.basename(F.col("path")).alias("name"), F.sha1("content").alias("sha1"), F.unix_micros("modificationTime").alias("mtime"))


def newest(files: DataFrame, since: Column, cushion_seconds: int = 2) -> DataFrame:
    """The path modified last, of those since a time less the cushion."""
    recent = files.where(F.col("mtime") >= since - F.make_interval(secs=F.lit(cushion_seconds)))
    return recent.agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, source, page_content, type) of plain text files, white space collapsed; unreadable ones skipped."""
    df = spark.read.option("ignoreCorruptFiles", "true").text(path, wholetext=True)
    at = F.col("_metadata.file_path")
    return df.select(at.alias("source_path"), X.basename(at).alias("source"), X.collapse(F.col("value")).alias("page_content"), F.lit("txt").alias("type"))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Positioned lines (doc_id, line_no, page, text, x0, y0, x1, y1, …) of extraction payloads."""
    docs = read_documents(spark, path, LINES)
    rows = docs.select(F.col("meta.source_path").alias("doc_id"), F.posexplode("lines").alias("line_no", "l"))
    box = [F.get("l.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select("doc_id", "line_no", "l.page", "l.text", *box, "l.left_indent", "l.width", "l.is_bold", "l.font_size", F.coalesce("l.column", F.lit(0)).alias("column"))


#: The word processor's XML namespace, and the made-up geometry of its paragraphs.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DOCX_SIZE, DOCX_WIDTH, DOCX_EMPTY, DOCX_PAD, DOCX_STEP = 11.0, 600.0, 12.0, 4.0, 8.0
_LINE = "doc_id string, line_no int, page int, text string, x0 double, y0 double, x1 double, y1 double, left_indent double, width double, is_bold boolean, font_size double, column int"


def _paragraphs(content: bytes) -> list[tuple[str, list[float], list[bool]]]:
    """Text, stated sizes in points and boldness of the runs of each paragraph outside of tables; none of a broken file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    signs = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    out = []
    for p in body.findall(f"{_W}p") if body is not None else ():
        text, sizes, bold = [], [], []
        for r in p.iter(f"{_W}r"):
            text += [x.text or "" if x.tag == f"{_W}t" else signs.get(x.tag, "") for x in r]
            size, b = r.find(f"{_W}rPr/{_W}sz"), r.find(f"{_W}rPr/{_W}b")
            if size is not None:
                sizes.append(float(size.get(f"{_W}val")) / 2)
            bold.append(b is not None and b.get(f"{_W}val", "true") not in ("0", "false", "off"))
        out.append((" ".join("".join(text).split()), sizes, bold))
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Positioned lines of word-processor files, a line for each paragraph with text: sizes are the mean of those stated,
    else the default, boxes stand one below the other, and a line is bold if at least half of its runs are. Files that
    cannot be read have no lines."""

    def lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in parts:
            rows = []
            for at, content in zip(files["path"], files["content"], strict=True):
                y, n = 0.0, 0
                for text, sizes, bold in _paragraphs(content):
                    if not text:
                        y += DOCX_EMPTY
                        continue
                    size = sum(sizes) / len(sizes) if sizes else DOCX_SIZE
                    rows.append((at, n, 1, text, 0.0, y, DOCX_WIDTH, y + size + DOCX_PAD, 0.0, DOCX_WIDTH, sum(bold) >= max(1, len(bold) // 2), size, 0))
                    y, n = y + size + DOCX_STEP, n + 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _LINE.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "content").mapInPandas(lines, _LINE)


def payload(lines: DataFrame) -> DataFrame:
    """(doc_id, text_per_page, text_all) of lines: lines joined by a line break, pages by a blank line."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    pages = lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("t"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda p: p["t"])
    return pages.groupBy("doc_id").agg(texts.alias("text_per_page")).withColumn("text_all", F.array_join("text_per_page", "\n\n"))


def output_paths(df: DataFrame, path: str = "path", kinds: tuple[str, ...] = ("lines", "sections", "canonical")) -> DataFrame:
    """df with a map of the output paths that belong to an input path."""
    base = F.concat(F.regexp_replace(F.col(path), r"[^/]+$", ""), X.stem(F.col(path)))
    return df.withColumn("outputs", F.create_map(*[v for k in kinds for v in (F.lit(k), F.concat(base, F.lit(f"_{k}.json")))]))


def table_documents(tables: DataFrame) -> DataFrame:
    """Tables (source, page, rows array of arrays) as documents of pipe rows."""
    body = F.array_join(F.transform("rows", X.row_text), "\n")
    return tables.select("source", "page", (F.col("page") + 1).alias("page_display"), body.alias("page_content"), F.lit("table").alias("block_type"))


def write_store(chunks: DataFrame, path: str) -> None:
    """The vector store rebuilt from nothing."""
    chunks.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(F.coalesce(F.col(column), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def batch_summary(outputs: DataFrame, batch_dir: str) -> DataFrame:
    """One row: the batch and its inputs with their outputs, by input."""
    items = F.array_sort(F.collect_list(F.struct(F.col("path").alias("input"), F.to_json("outputs").alias("outputs"))))
    return outputs.agg(F.lit(batch_dir).alias("batch_dir"), items.alias("items"))
