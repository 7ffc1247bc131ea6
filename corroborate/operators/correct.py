"""Corrections of contradicted claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.functions import text as X


def corrections(verdicts: DataFrame) -> DataFrame:
    """One row per contradicted claim with evidence."""
    fixed = X.best_sentence(F.col("claim"), F.col("evidence.text"))
    explanation = F.concat(
        F.lit('The claim states: "'),
        X.shorten(F.col("claim")),
        F.lit('"\n\nHowever, the source document states: "'),
        X.shorten(F.col("suggested_correction")),
        F.lit('"\n\nPlease revise the claim to match the source document.'),
    )
    return (
        verdicts.where((F.col("status") == "contradicted") & F.col("evidence").isNotNull())
        .withColumn("suggested_correction", fixed)
        .select(
            "doc_id",
            "claim_index",
            F.col("claim").alias("original_claim"),
            "suggested_correction",
            F.col("evidence.source").alias("source"),
            F.col("evidence.page").alias("page"),
            explanation.alias("explanation"),
            F.col("evidence.confidence").alias("confidence"),
        )
    )


def correction_summary(docs: DataFrame, fixes: DataFrame) -> DataFrame:
    """Count and text summary for every document, also for those without corrections."""
    entries = F.array_sort(F.collect_list(F.struct("claim_index", "original_claim", F.col("source").cast("string").alias("source"), "page")))
    gathered = fixes.groupBy("doc_id").agg(F.count("*").alias("n"), entries.alias("entries"))
    lines = F.transform(
        "entries",
        lambda e, i: F.concat(
            (i + 1).cast("string"), F.lit(". "), F.substring(e["original_claim"], 1, 80), F.lit("...\n   Source: "), e["source"],
            F.lit(", Page "), e["page"].cast("string"), F.lit("\n   Suggested correction available.\n\n"),
        ),
    )
    found = F.concat(
        F.lit("Found "), F.col("n").cast("string"), F.lit(" contradicted claim(s) that require correction:\n\n"), F.array_join(lines, "")
    )
    none = "No contradictions found. All claims are either supported or unverifiable."
    return docs.select("doc_id").join(gathered, "doc_id", "left").select(
        "doc_id",
        F.coalesce("n", F.lit(0)).alias("total_contradictions"),
        F.when(F.col("n").isNull(), none).otherwise(found).alias("summary"),
    )


def corrected_documents(docs: DataFrame, fixes: DataFrame) -> DataFrame:
    """Longest claim first, the first occurrence (any case) gives way to the correction."""
    entry = F.struct((-F.length("original_claim")).alias("order"), "claim_index", "original_claim", "suggested_correction")
    gathered = fixes.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("fixes"))

    def step(text, fix):
        old = fix["original_claim"]
        same = (F.length(F.lower(text)) == F.length(text)) & (F.length(F.lower(old)) == F.length(old))
        at = F.when(same, F.position(F.lower(old), F.lower(text))).otherwise(F.position(old, text))
        swapped = F.concat(F.substr(text, F.lit(1), at - 1), fix["suggested_correction"], F.substr(text, at + F.length(old)))
        return F.when((at > 0) & (F.length(old) > 0), swapped).otherwise(text)

    fixed = F.when(F.col("fixes").isNull(), F.col("text")).otherwise(F.aggregate("fixes", F.col("text"), step))
    return docs.select("doc_id", "text").join(gathered, "doc_id", "left").select("doc_id", fixed.alias("corrected_text"))
