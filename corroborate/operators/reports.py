"""Aggregates behind reports and charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions.text import percent

GREEN, YELLOW, RED = "rgba(46, 204, 113, {})", "rgba(241, 196, 15, {})", "rgba(231, 76, 60, {})"


def _weight(score: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(score * 100).cast("int"))


def _colour(score: Column, alpha: str) -> Column:
    return F.when(score >= 0.85, GREEN.format(alpha)).when(score >= 0.60, YELLOW.format(alpha)).otherwise(RED.format(alpha))


def pair_confidence(mappings: DataFrame) -> DataFrame:
    """Mean confidence and number of columns per table pair."""
    return mappings.groupBy("source_table", "target_table").agg(F.avg("ensemble").alias("confidence"), F.count("*").alias("column_count"))


def table_flow(mappings: DataFrame) -> DataFrame:
    pairs = pair_confidence(mappings)
    c = F.col("confidence")
    return pairs.select("source_table", "target_table", _weight(c).alias("weight"), _colour(c, "0.6").alias("colour"))


def column_flow(mappings: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Edges between columns, with the class (key or other) of both ends."""

    def side(catalog: DataFrame, name: str) -> DataFrame:
        fk = F.col("is_foreign_key") if "is_foreign_key" in catalog.columns else F.lit(False)
        kind = F.when(F.col("is_primary_key"), "primary_key").when(fk, "foreign_key").otherwise(name)
        return catalog.select(
            F.col("table_name").alias(f"{name}_table"), F.col("column_name").alias(f"{name}_column"), kind.alias(f"{name}_class")
        )

    joined = mappings.join(side(source, "source"), ["source_table", "source_column"]).join(side(target, "target"), ["target_table", "target_column"])
    s = F.col("ensemble")
    return joined.select(
        "source_table", "source_column", "source_class", "target_table", "target_column", "target_class",
        _weight(s).alias("weight"), _colour(s, "0.7").alias("colour"),
    )


def graph_nodes(mappings: DataFrame, unmapped: DataFrame) -> DataFrame:
    """Nodes keyed by table and column. Positions are dense numbers within a side.

    A single running number over all nodes would sort them in one task, so
    nodes are numbered per table and the tables' offsets are added.
    """

    def mapped(side: str) -> DataFrame:
        return mappings.select(F.lit(side).alias("side"), F.col(f"{side}_table").alias("table_name"), F.col(f"{side}_column").alias("column_name")).distinct().withColumn("reason", F.lit(None).cast("string"))

    free = unmapped.select("side", "table_name", "column_name", "reason")
    nodes = mapped("source").unionByName(mapped("target")).unionByName(free)
    local = Window.partitionBy("side", "table_name").orderBy("column_name")
    numbered = nodes.withColumn("at", F.row_number().over(local) - 1)
    sizes = numbered.groupBy("side", "table_name").agg(F.count("*").alias("n"))
    # tables, not columns: source before target, then by name
    before = Window.orderBy("side", "table_name").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    kind = F.when(F.col("reason").isNull(), F.col("side")).otherwise(F.concat("side", F.lit("_unmapped")))
    return numbered.join(offsets, ["side", "table_name"]).select(
        (F.col("offset") + F.col("at")).alias("node"),
        F.concat_ws("_", "side", "table_name", "column_name").alias("id"),
        F.concat_ws(".", "table_name", "column_name").alias("name"),
        kind.alias("type"),
        "side", "table_name", "column_name", "reason",
    )


def graph_links(mappings: DataFrame, nodes: DataFrame) -> DataFrame:
    def end(side: str) -> DataFrame:
        return nodes.where(F.col("side") == side).select(
            F.col("table_name").alias(f"{side}_table"), F.col("column_name").alias(f"{side}_column"), F.col("node").alias(f"{side}_node")
        )

    joined = mappings.join(end("source"), ["source_table", "source_column"]).join(end("target"), ["target_table", "target_column"])
    return joined.select(
        F.col("source_node").alias("source"), F.col("target_node").alias("target"), F.col("ensemble").alias("value"), F.col("confidence_level").alias("confidence"), "mapping_type"
    )


def similarity_matrix(scores: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Best score per source and target name; wide when the target columns are given."""
    long = scores.groupBy("source", "target").agg(F.max("score").alias("score"))
    if columns is None:
        return long
    return long.groupBy("source").pivot("target", columns).agg(F.first("score"))


def fk_edges(catalog: DataFrame) -> DataFrame:
    ref = F.split("foreign_key_ref", "\\.")
    return catalog.where(F.col("is_foreign_key")).select(
        F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"), ref[0].alias("to_table"), ref[1].alias("to_column")
    )


def status_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count("*").alias("checks"))


def migration_summary(results: DataFrame) -> DataFrame:
    totals = results.agg(
        F.coalesce(F.sum("records_migrated"), F.lit(0)).alias("migrated"),
        F.coalesce(F.sum("records_failed"), F.lit(0)).alias("failed"),
        F.coalesce(F.sum("records_attempted"), F.lit(0)).alias("attempted"),
    )
    skipped = F.col("attempted") - F.col("migrated") - F.col("failed")
    rate = F.when(F.col("attempted") > 0, F.round(F.col("migrated") * 100.0 / F.col("attempted"), 1)).otherwise(F.lit(0.0))
    return totals.select("migrated", "failed", skipped.alias("skipped"), rate.alias("success_pct"))


def relationship_types(mappings: DataFrame, unmapped: DataFrame) -> DataFrame:
    kind = F.when(F.col("mapping_type") == "1:N", "1:N (Split)").when(F.col("mapping_type") == "N:1", "N:1 (Merge)").otherwise("1:1 Mappings")
    mapped = mappings.groupBy(kind.alias("category")).agg(F.count("*").alias("columns"))
    free = unmapped.groupBy(F.when(F.col("side") == "source", "Unmapped Source").otherwise("Unmapped Target").alias("category")).agg(F.count("*").alias("columns"))
    return mapped.unionByName(free)


def confidence_histogram(scores: DataFrame, score: str = "score", bins: int = 10) -> DataFrame:
    at = F.least(F.width_bucket(F.col(score), F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins)).alias("bin")
    return scores.groupBy(at).agg(F.count("*").alias("n"))


def reject_types(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("error_type").agg(F.count("*").alias("records"))


def dashboard(results: DataFrame, mappings: DataFrame, checks: DataFrame) -> DataFrame:
    one = F.lit(1).alias("one")
    s = F.col("ensemble")
    moved = results.agg(F.coalesce(F.sum("records_migrated"), F.lit(0)).alias("migrated"), F.coalesce(F.sum("records_failed"), F.lit(0)).alias("failed"), one)
    bands = mappings.agg(
        F.count_if(s >= 0.85).alias("high"), F.count_if((s >= 0.60) & (s < 0.85)).alias("medium"), F.count_if(s < 0.60).alias("low"),
        F.round(F.avg(s), 5).alias("average_score"), one,
    )
    passed = F.count_if(F.col("status") == "passed")
    state = checks.agg(passed.alias("checks_passed"), (F.count("*") - passed).alias("checks_with_issues"), one)
    return moved.join(bands, "one").join(state, "one").drop("one")


def side_by_side(mappings: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """All columns of both catalogs, beside each other where mapped."""
    s = source.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"), F.col("data_type").alias("source_type"))
    t = target.select(F.col("table_name").alias("target_table"), F.col("column_name").alias("target_column"), F.col("data_type").alias("target_type"))
    links = mappings.select("source_table", "source_column", "target_table", "target_column")
    return s.join(links, ["source_table", "source_column"], "left").join(t, ["target_table", "target_column"], "full")


def mapping_report(mappings: DataFrame) -> DataFrame:
    def rounded(name: str, alias: str) -> Column:
        return F.round(name, 4).alias(alias)

    return mappings.select(
        "source_table", "source_column", "source_type", "target_table", "target_column", "target_type",
        rounded("ensemble", "confidence_score"), "confidence_level", "mapping_type", "transformation",
        rounded("cosine", "cosine"), rounded("proposal", "proposal"), rounded("tfidf", "tfidf"), rounded("domain", "domain"), "why_mapped",
    )


def platform_summary(mappings: DataFrame) -> DataFrame:
    high = F.count_if(F.col("ensemble") >= 0.85)
    totals = mappings.agg(
        F.count_distinct("source_table", "target_table").alias("table_pairs_mapped"), F.count("*").alias("total_column_mappings"), high.alias("high_confidence_mappings")
    )
    rate = percent(F.col("high_confidence_mappings") / F.col("total_column_mappings"), 1)
    return totals.withColumn("mapping_confidence_rate", F.when(F.col("total_column_mappings") > 0, rate).otherwise("N/A"))


CHECKLIST = [
    "1. Review all column mappings, especially low-confidence ones",
    "2. Verify data type transformations won't cause data loss",
    "3. Ensure target schema is created and matches expected structure",
    "4. Create backup of target database",
    "5. Test migration on subset of data first",
    "6. Plan for rollback in case of issues",
]


def recommendations(mappings: DataFrame, checks: DataFrame, score: str = "ensemble", shown: int = 5) -> DataFrame:
    """Low mappings (the first few named), failed checks, and the checklist.

    The few named mappings are a top-k, so the low ones are never all gathered.
    """
    low = mappings.where(F.col(score) < 0.6)
    places = ["source_table", "source_column", "target_table", "target_column"]
    named = low.orderBy(score, *places).limit(shown)
    line = F.concat(F.lit("• "), "source_column", F.lit(" → "), "target_column", F.lit(" ("), percent(F.col(score)), F.lit(")"))
    one = F.lit(1).alias("one")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(score, *places, line.alias("line")))), lambda x: x["line"])
    first = low.agg(F.count("*").alias("n"), one).join(named.agg(listed.alias("details"), one), "one").where(F.col("n") > 0).select(
        F.lit("recommendation").alias("kind"), F.lit("Review Low-Confidence Mappings").alias("title"),
        F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" mapping(s) with low confidence")).alias("summary"), "details",
    )
    # a run has a handful of failed checks per table; they are report rows, not data
    failed = checks.where(F.col("status") == "failed").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat(F.lit("• "), "check_name", F.lit(": "), "message"))).alias("details")
    ).where(F.col("n") > 0).select(
        F.lit("warning").alias("kind"), F.lit("⚠ Address Validation Failures Before Migration").alias("title"),
        F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" validation failure(s)")).alias("summary"), "details",
    )
    checklist = mappings.limit(1).select(
        F.lit("recommendation").alias("kind"), F.lit("Pre-Migration Checklist").alias("title"),
        F.lit("Recommended steps before executing migration").alias("summary"), F.array(*map(F.lit, CHECKLIST)).alias("details"),
    )
    return first.unionByName(failed).unionByName(checklist)
