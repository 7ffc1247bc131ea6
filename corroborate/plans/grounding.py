"""Check generated texts against a trusted corpus, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.functions.text import embed_text
from corroborate.operators import cite, correct, retrieval, verify
from corroborate.operators.chunks import chunk_documents
from corroborate.operators.claims import atomize_claims
from corroborate.session import light_batches, small, stage


@dataclass(frozen=True)
class Grounding:
    """The stages of one job; each is a DataFrame that runs when used."""

    docs: DataFrame
    claims: DataFrame
    evidence: DataFrame  # per distinct wording (query_id)
    verdicts: DataFrame

    def scores(self) -> DataFrame:
        return verify.document_scores(self.verdicts, self.docs)

    def positions(self) -> DataFrame:
        return cite.claim_positions(self.docs, self.verdicts.drop("all_evidence"))

    def citations(self) -> DataFrame:
        return cite.number_citations(self.positions())

    def annotations(self) -> DataFrame:
        positions = self.positions()
        return cite.annotations(positions, cite.number_citations(positions))

    def corrections(self) -> DataFrame:
        return correct.corrections(self.verdicts)

    def report(self) -> DataFrame:
        """One row per document: statistics, trust, annotations, citations, corrections."""
        positions = self.positions()
        citations = cite.number_citations(positions)
        notes = cite.gather_annotations(cite.annotations(positions, citations))
        cited = citations.groupBy("doc_id").agg(
            F.array_sort(F.collect_list(F.struct("citation_number", "id", "claim_index", "source_file", "source_page", "evidence_text", "confidence"))).alias("citations")
        )
        fixes = self.corrections().groupBy("doc_id").agg(
            F.array_sort(F.collect_list(F.struct("claim_index", "original_claim", "suggested_correction", "source", "page", "confidence"))).alias("corrections")
        )
        return (
            self.scores()
            .join(notes, "doc_id", "left")
            .join(cited, "doc_id", "left")
            .join(fixes, "doc_id", "left")
        )


def chunk_store(corpus: DataFrame, embedder=embed_text, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of ``corpus(doc_id, source, text)`` with their vectors."""
    return retrieval.embed(chunk_documents(corpus, size, overlap), "text", embedder)


def ground(
    texts: DataFrame,
    store: DataFrame,
    k: int = 5,
    embedder=embed_text,
    classifier=verify.lexical_logits,
    min_score: float | None = None,
    index: retrieval.Packed | None = None,
    **search,
) -> Grounding:
    """Check ``texts(doc_id, text)`` against a chunk store, whose vectors are searched in ``index`` if they were packed."""
    claims = atomize_claims(texts).withColumn("query_id", F.md5("claim"))
    # every distinct wording is searched and decided once, then joined back
    wording = claims.select("query_id", "claim").distinct()
    found = retrieval.evidence_topk(retrieval.embed(wording, "claim", embedder), index or store, k, **search)
    if min_score is not None:
        found = retrieval.gate(found, min_score)
    # staged, as only then it is known to be few rows, and passages are read where they lie, not shuffled to it
    with light_batches(found.sparkSession):
        found = small(stage(found, "found"), 1_000_000)
    passages = store.select("chunk_id", "text", F.col("source").cast("string").alias("source"), "page")
    pairs = (
        found.join(passages, "chunk_id")
        .join(wording, "query_id")
        .select("query_id", "claim", "chunk_id", "rank", "text", "source", "page", F.col("score").alias("retrieval_score"))
    )
    evidence = verify.classify_evidence(pairs, classifier)
    decided = verify.decide(wording, evidence, ("query_id",)).drop("claim")
    verdicts = claims.join(decided, "query_id").drop("query_id")
    return Grounding(texts, claims, evidence, verdicts)
