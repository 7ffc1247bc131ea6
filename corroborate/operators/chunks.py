"""Corpus chunks with true offsets, pages and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.functions.text import chunker
from corroborate.session import spread_small


def chunk_documents(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """``docs(doc_id, source, text)`` to one row per chunk, page 1."""
    docs = spread_small(docs.select("doc_id", "source", "text"))
    exploded = docs.select("doc_id", "source", F.inline(chunker(size, overlap)("text")).alias("chunk_index", "char_start", "char_end", "text"))
    return exploded.select(
        F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "doc_id",
        "source",
        "chunk_index",
        F.lit(1).alias("page"),
        "char_start",
        "char_end",
        "text",
    )


def locate_pages(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Page whose [start, end) holds the chunk's start, else page 1.

    The document id is an equality key beside the range, so the join hashes or
    sorts on it; a bare range would be a nested loop.
    """
    c, s = chunks.alias("c"), spans.alias("s")
    inside = (F.col("c.doc_id") == F.col("s.doc_id")) & (F.col("c.char_start") >= F.col("s.start")) & (F.col("c.char_start") < F.col("s.end"))
    columns = [F.col(f"c.{n}") if n != "page" else F.coalesce("s.page", F.lit(1)).alias("page") for n in chunks.columns]
    return c.join(s, inside, "left").select(*columns)


def inventory(chunks: DataFrame) -> DataFrame:
    """Chunks per source."""
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"))
