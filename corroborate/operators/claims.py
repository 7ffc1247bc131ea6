"""Claims of generated text, their topics and topic sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions import lexicon as L
from corroborate.functions import text as X


def atomize_claims(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, claim_index, claim)`` in text order."""
    claims = F.flatten(F.transform(X.sentences(F.col("text")), X.claims_of))
    return docs.select("doc_id", F.posexplode(claims).alias("claim_index", "claim"))


def topic_tags(docs: DataFrame) -> DataFrame:
    tags = X.topic_tags(F.col("text"))
    return docs.select(
        "doc_id",
        F.coalesce(F.try_element_at(tags, F.lit(1)), F.lit("general")).alias("primary_topic"),
        tags.alias("all_topics"),
    )


def topic_sources(tagged: DataFrame, sources: DataFrame, max_results: int = 3) -> DataFrame:
    """Best ``max_results`` curated sources of each document's primary topic.

    The sources are ranked before the join: ``max_results`` rows for each of
    the fixed topics, short enough to broadcast, so a popular topic is no hot
    join key.
    """
    best = Window.partitionBy("topic").orderBy("priority", "url")
    known = sources.where(F.col("topic").isin(*L.TOPICS, "general"))
    ranked = known.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max_results)
    return tagged.join(F.broadcast(ranked), tagged.primary_topic == ranked.topic).select("doc_id", "topic", "rank", "url", "title")
