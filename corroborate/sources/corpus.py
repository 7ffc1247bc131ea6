"""Trusted corpus: text files, paged documents, and the chunk store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.functions.text import doc_id

CHUNK_COLUMNS = ["chunk_id", "doc_id", "source", "page", "char_start", "char_end", "text"]


def scan_text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per UTF-8 file: id from the path, page 1."""
    files = spark.read.text(paths, wholetext=True).withColumn("source", F.input_file_name())
    return files.select(doc_id(F.col("source")).alias("doc_id"), "source", F.lit(1).alias("page"), F.col("value").alias("text"))


def document_format(path: Column, api: bool = False) -> Column:
    """``pdf`` or ``text`` by extension; NULL is unsupported. The API takes ``.pdf`` only."""
    if api:
        return F.when(F.endswith(path, F.lit(".pdf")), "pdf")
    low = F.lower(path)
    return F.when(F.endswith(low, F.lit(".pdf")), "pdf").when(F.endswith(low, F.lit(".txt")), "text")


def route_formats(files: DataFrame, path: str = "source", api: bool = False) -> DataFrame:
    fmt = document_format(F.col(path), api)
    return files.withColumn("format", fmt).withColumn(
        "reject_reason", F.when(fmt.isNull(), F.concat(F.lit("Unsupported file type: "), F.col(path)))
    )


def page_spans(pages: DataFrame) -> DataFrame:
    """Offsets of every non-empty page in the document joined with blank lines."""
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    kept = pages.where(F.length("text") > 0)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    return kept.select("doc_id", "page", start.alias("start"), (start + F.length("text") + 2).alias("end"))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Pages of a document in order, each followed by a blank line; empty pages skipped."""
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["text"], F.lit("\n\n"))), "")
    return pages.where(F.length("text") > 0).groupBy("doc_id").agg(text.alias("text"))


def join_pages(pages: DataFrame) -> DataFrame:
    """Plain join: every page followed by one line break; a NULL page counts as empty."""
    page_text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    parts = F.array_sort(F.collect_list(F.struct("page", page_text)))
    return pages.groupBy("doc_id").agg(
        F.array_join(F.transform(parts, lambda p: F.concat(p["text"], F.lit("\n"))), "").alias("text")
    )


def new_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks whose id is not in the store yet."""
    return chunks.join(store.select("chunk_id"), "chunk_id", "left_anti")


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Append to the store at ``path``; ids already there are left alone."""
    spark = chunks.sparkSession
    if store_exists(spark, path):
        store = spark.read.schema(chunks.schema).parquet(path)
        chunks = new_chunks(chunks, store)
    chunks.write.mode("append").parquet(path)


def clear_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Empty the store but keep its schema."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def store_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
