"""Classify evidence, decide verdicts, score documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import lexicon as L
from corroborate.functions import text as X

ENTAILMENT_MIN = 0.4
CONTRADICTION_MIN = 0.5
IMPLICIT_RETRIEVAL_MIN = -0.1
EVIDENCE_FIELDS = ["rank", "text", "source", "page", "nli_label", "confidence", "retrieval_score"]


def lexical_logits(claim: Column, evidence: Column) -> Column:
    """Built-in stand-in classifier: (contradiction, neutral, entailment) logits.

    Token cover, lowered by a clash of numbers or of negations. Not a model.
    """
    h, p = X.content_tokens(claim), X.content_tokens(evidence)
    cover = F.when(F.size(h) > 0, F.size(F.array_intersect(h, p)) / F.size(h)).otherwise(F.lit(0.0))
    negations = F.array(*map(F.lit, L.NEGATIONS))

    def has_digit(tokens: Column) -> Column:
        return F.exists(tokens, lambda t: F.regexp_like(t, F.lit("\\p{N}")))

    number_clash = has_digit(F.array_except(h, p)) & has_digit(p) & (cover >= 0.5)
    negation_clash = F.arrays_overlap(h, negations) != F.arrays_overlap(p, negations)
    clash = F.array(4 * cover - 1, F.lit(1.0), F.lit(-2.0))
    plain = F.array(F.lit(-2.0), F.lit(1.0), 6 * cover - 3)
    return F.when(number_clash | negation_clash, clash).otherwise(plain)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def with_label(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Add ``nli_label`` and ``confidence`` (6 digits); the first maximum wins."""
    labels = F.array(*map(F.lit, L.NLI_LABELS))
    return (
        df.withColumn("_p", softmax(F.col(logits)))
        .withColumn("nli_label", F.element_at(labels, F.array_position(logits, F.array_max(logits)).cast("int")))
        .withColumn("confidence", F.round(F.array_max("_p"), 6))
        .drop("_p")
    )


def classify_evidence(
    evidence: DataFrame,
    classifier: Callable[[Column, Column], Column] = lexical_logits,
) -> DataFrame:
    """Label every (claim, evidence text) pair. ``classifier`` gives the logits column."""
    return with_label(evidence.withColumn("logits", classifier(F.col("claim"), F.col("text")))).drop("logits")


def _mentions(c: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(p)) for p in phrases])


def implicit_contradiction(claim: Column, evidence: Column, label: Column, retrieval: Column) -> Column:
    """A neutral pair in which both sides speak of something prohibited."""
    return (
        _mentions(claim, L.CLAIM_PROHIBITIONS)
        & (label == "neutral")
        & _mentions(evidence, L.EVIDENCE_PROHIBITIONS)
        & (retrieval >= IMPLICIT_RETRIEVAL_MIN)
    )


def decide(claims: DataFrame, evidence: DataFrame, keys: tuple[str, ...] = ("doc_id", "claim_index"), listed: int = 3) -> DataFrame:
    """One verdict per claim, from its labelled evidence, by priority.

    Entailment, then contradiction, then implicit contradiction, else
    unverifiable. One aggregation, so evidence is combined before the shuffle.
    """
    ev = F.struct(*EVIDENCE_FIELDS)

    def best(label: str | None) -> Column:
        entry = F.struct("confidence", (-F.col("rank")).alias("order"), ev.alias("ev"))
        return F.max(F.when(F.col("nli_label") == label, entry) if label else entry)

    implied = implicit_contradiction(F.col("claim"), F.col("text"), F.col("nli_label"), F.col("retrieval_score"))
    ranked = F.array_sort(F.collect_list(F.when(F.col("rank") <= listed, ev)))
    summary = evidence.groupBy(*keys).agg(
        best("entailment").alias("entailed"),
        best("contradiction").alias("denied"),
        F.min(F.when(implied, F.struct("rank", ev.alias("ev")))).alias("implied"),
        best(None).alias("surest"),
        ranked.alias("all_evidence"),
    )
    joined = claims.join(summary, list(keys), "left")
    supported = F.col("entailed.confidence") >= ENTAILMENT_MIN
    denied = F.col("denied.confidence") >= CONTRADICTION_MIN
    implicit = F.col("implied").isNotNull()
    chosen = (
        F.when(supported, F.col("entailed.ev"))
        .when(denied, F.col("denied.ev"))
        .when(implicit, F.col("implied.ev"))
        .otherwise(F.col("surest.ev"))
    )
    page = F.col("evidence.page").cast("string")
    sure = X.percent(F.col("evidence.confidence"), 2)
    explanation = (
        F.when(F.col("surest").isNull(), "No relevant evidence found in source documents.")
        .when(supported, F.concat(F.lit("Claim is SUPPORTED by evidence on page "), page, F.lit(". Confidence: "), sure))
        .when(denied, F.concat(F.lit("Claim CONTRADICTS evidence on page "), page, F.lit(". Confidence: "), sure))
        .when(
            implicit,
            F.concat(
                F.lit("Claim appears to CONTRADICT evidence on page "),
                page,
                F.lit(". The source mentions different contraindications than the claim."),
            ),
        )
        .otherwise("Claim cannot be verified with high confidence. Evidence is either insufficient or neutral.")
    )
    return (
        joined.withColumn("status", F.when(supported, "supported").when(denied | implicit, "contradicted").otherwise("unverifiable"))
        .withColumn("implicit_contradiction", F.coalesce(~F.coalesce(supported, F.lit(False)) & ~F.coalesce(denied, F.lit(False)) & implicit, F.lit(False)))
        .withColumn("evidence", chosen)
        .withColumn("confidence", F.coalesce("evidence.confidence", F.lit(0.0)))
        .withColumn("explanation", explanation)
        .select(*keys, "claim", "status", "confidence", "evidence", "all_evidence", "implicit_contradiction", "explanation")
    )


def document_scores(verdicts: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Counts and trust score per document: supported share less half the contradicted.

    With ``docs`` a document without claims is kept, with trust 0.
    """

    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    scores = verdicts.groupBy("doc_id").agg(
        F.count("*").alias("total"),
        count("supported").alias("supported"),
        count("contradicted").alias("contradicted"),
        count("unverifiable").alias("unverifiable"),
    )
    if docs is not None:
        scores = docs.select("doc_id").join(scores, "doc_id", "left").na.fill(0)
    return scores.withColumn("trust_score", trust_score(F.col("total"), F.col("supported"), F.col("contradicted")))


def trust_score(total: Column, supported: Column, contradicted: Column) -> Column:
    raw = supported / total - 0.5 * contradicted / total
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(F.lit(0.0))


def verdict_percentages(scores: DataFrame) -> DataFrame:
    def share(name: str) -> Column:
        return F.when(F.col("total") > 0, F.round(F.col(name) * 100.0 / F.col("total"), 1)).otherwise(F.lit(0.0)).alias(f"{name}_pct")

    return scores.select("doc_id", share("supported"), share("contradicted"), share("unverifiable"))


def contradictions(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col("status") == "contradicted")


def evidence_of(verdicts: DataFrame, claim_index: int | None = None) -> DataFrame:
    """Stored evidence row by row, of one claim index or of all."""
    picked = verdicts if claim_index is None else verdicts.where(F.col("claim_index") == claim_index)
    others = [c for c in verdicts.columns if c in ("run_id", "doc_id", "claim_index", "claim", "status")]
    return picked.select(*others, F.inline("all_evidence"))


def stored_run(verdicts: DataFrame, scores: DataFrame, run_id: str) -> DataFrame:
    """What is stored of one run: a row per text with its scores and, in order, its claims with their status; no row for an unknown run."""
    own = verdicts.where(F.col("run_id") == run_id)
    claim = F.struct("claim_index", "claim", "status", "confidence")
    told = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(claim)).alias("claims"))
    return scores.where(F.col("run_id") == run_id).drop("batch_id").join(told, "doc_id", "left")


def run_stats(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Runs, mean trust of completed runs in percent, contradictions, store size."""
    done = F.col("status") == "completed"
    totals = runs.agg(
        F.count("*").alias("total_runs"),
        F.count_if(done).alias("completed_runs"),
        F.round(F.coalesce(F.avg(F.when(done, F.col("trust_score"))), F.lit(0.0)) * 100, 1).alias("average_trust"),
        F.coalesce(F.sum(F.when(done, F.col("contradicted"))), F.lit(0)).alias("total_contradictions"),
        F.lit(1).alias("_one"),
    )
    size = chunks.agg(F.count("*").alias("store_size"), F.lit(1).alias("_one"))
    return totals.join(size, "_one").drop("_one")
