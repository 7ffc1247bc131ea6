"""Conversion class of type pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.functions import lexicon as L
from corroborate.functions.types import declared_size, normalize_type

RULE_SCHEMA = "from_type string, to_type string, kind string, description string, custom boolean"


def conversion_rules(spark: SparkSession, custom: list[tuple[str, str, str, str]] = ()) -> DataFrame:
    """Built-in rules and the user's, which replace built-in ones for the same pair."""
    rules = {(s, t): (s, t, k, d, False) for s, t, k, d in L.CONVERSION_RULES}
    for s, t, kind, description in custom:
        rules[(L.TYPE_ALIASES.get(s.upper(), s.upper()), L.TYPE_ALIASES.get(t.upper(), t.upper()))] = (
            L.TYPE_ALIASES.get(s.upper(), s.upper()), L.TYPE_ALIASES.get(t.upper(), t.upper()), kind, description, True,
        )
    return spark.createDataFrame(list(rules.values()), RULE_SCHEMA)


def conversions(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Add kind, description, loss flag and warning to ``(source_type, target_type)`` rows.

    The rule table is a short list made on the driver, so it is broadcast.
    """
    src, tgt = normalize_type(F.col("source_type")), normalize_type(F.col("target_type"))
    keyed = pairs.withColumn("from_type", src).withColumn("to_type", tgt)
    joined = keyed.join(F.broadcast(rules), ["from_type", "to_type"], "left")
    ruled, same = F.col("kind").isNotNull(), F.col("from_type") == F.col("to_type")
    src_size, tgt_size = declared_size(F.col("source_type")), declared_size(F.col("target_type"))
    shrinks = ruled & ~F.coalesce("custom", F.lit(False)) & (src_size > tgt_size) & (tgt_size > 0)
    unknown = F.concat(F.lit("Unknown conversion: "), "from_type", F.lit(" → "), "to_type")
    return joined.select(
        *pairs.columns,
        F.when(ruled, F.col("kind")).when(same, "direct").otherwise("custom").alias("kind"),
        F.when(ruled, F.col("description")).when(same, "Types are equivalent").otherwise(unknown).alias("description"),
        F.coalesce((F.col("kind") == "lossy") | shrinks, F.lit(False)).alias("potential_loss"),
        F.when(
            shrinks,
            F.format_string("Source size (%d) > target size (%d). Data may be truncated.", src_size, tgt_size),
        ).when(~ruled & ~same, "Manual review recommended").alias("warning"),
    )
