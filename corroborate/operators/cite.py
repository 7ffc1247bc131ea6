"""Claim positions, citations, annotations and marked-up text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions import lexicon as L
from corroborate.functions import text as X


def claim_positions(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """Every span of every claim in its document.

    The claims of a document are gathered first, so its text travels through
    the join once and not once per claim.
    """
    others = [c for c in claims.columns if c != "doc_id"]
    gathered = claims.groupBy("doc_id").agg(F.collect_list(F.struct(*others)).alias("items"))
    placed = F.flatten(
        F.transform(
            "items",
            lambda item: F.transform(
                X.claim_spans(F.col("text"), item["claim"]),
                lambda span: F.struct(*[item[c].alias(c) for c in others], span["start"].alias("start"), span["end"].alias("end")),
            ),
        )
    )
    return docs.select("doc_id", "text").join(gathered, "doc_id").select("doc_id", F.inline(placed))


def number_citations(positions: DataFrame) -> DataFrame:
    """Citations of supported, evidenced spans, numbered per document."""
    order = Window.partitionBy("doc_id").orderBy("claim_index", "start")
    return (
        positions.where((F.col("status") == "supported") & F.col("evidence").isNotNull())
        .withColumn("citation_number", F.row_number().over(order))
        .select(
            "doc_id",
            F.concat(F.lit("cite_"), "citation_number").alias("id"),
            "claim_index",
            F.col("claim").alias("claim_text"),
            "start",
            F.col("evidence.source").alias("source_file"),
            F.col("evidence.page").alias("source_page"),
            F.col("evidence.text").alias("evidence_text"),
            F.col("evidence.confidence").alias("confidence"),
            "citation_number",
        )
    )


def footnotes(citations: DataFrame) -> DataFrame:
    note = F.format_string(
        '[%d] %s, Page %d: "%s..." (Confidence: %s)',
        "citation_number",
        F.col("source_file").cast("string"),
        "source_page",
        F.substring("evidence_text", 1, 100),
        X.percent(F.col("confidence")),
    )
    return citations.select("doc_id", "citation_number", note.alias("footnote"))


def annotations(positions: DataFrame, citations: DataFrame) -> DataFrame:
    """All spans with status and, for supported ones, the citation; ordered by start."""
    cited = citations.select("doc_id", "claim_index", "start", F.col("id").alias("citation_id"), "citation_number")
    return positions.join(cited, ["doc_id", "claim_index", "start"], "left").select(
        "doc_id", "start", "end", "status", "confidence", "explanation", "claim_index", "citation_id", "citation_number"
    )


def gather_annotations(rows: DataFrame) -> DataFrame:
    fields = ["start", "claim_index", "end", "status", "confidence", "explanation", "citation_id", "citation_number"]
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("annotations"))


def annotated_markup(docs: DataFrame, gathered: DataFrame) -> DataFrame:
    """Text with one span per annotation; text, attributes escaped.

    Text is never repeated: a span that begins inside an earlier one shows the
    rest of its text, and one that also ends there only its marker.
    """
    text = F.col("text")
    colour = F.map_from_arrays(F.array(*map(F.lit, L.STATUS_COLOURS)), F.array(*map(F.lit, L.STATUS_COLOURS.values())))

    def piece(start, end):
        return X.escape_markup(F.substr(text, start + 1, F.greatest(end - start, F.lit(0))))

    def step(acc, a):
        start = F.greatest(a["start"], acc["at"])
        marker = F.when(a["citation_number"].isNotNull(), F.concat(F.lit("<sup>["), a["citation_number"], F.lit("]</sup>"))).otherwise("")
        span = F.concat(
            F.format_string(
                '<span class="claim %s" style="background-color: %s; padding: 2px 4px; border-radius: 3px;" '
                'data-claim-index="%d" data-confidence="%.2f" title="',
                a["status"],
                F.coalesce(F.try_element_at(colour, a["status"]), F.lit("#ffffff")),
                a["claim_index"],
                a["confidence"],
            ),
            X.escape_markup(a["explanation"]),
            F.lit('">'),
            piece(start, a["end"]),
            marker,
            F.lit("</span>"),
        )
        grown = F.struct(F.greatest(a["end"], acc["at"]).alias("at"), F.concat(acc["out"], piece(acc["at"], start), span).alias("out"))
        return grown

    marked = F.aggregate(
        F.coalesce("annotations", F.array().cast(gathered.schema["annotations"].dataType)),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(text))),
    )
    return docs.select("doc_id", "text").join(gathered, "doc_id", "left").select("doc_id", marked.alias("annotated_html"))
