"""Explanations as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import lexicon as L
from corroborate.functions.text import fixed, percent


def _bands(score: Column, arms: list[tuple[float, Column | str]], otherwise: Column | str) -> Column:
    """The first arm whose bound the score reaches."""
    (bound, value), *rest = arms
    chain = F.when(score >= bound, value)
    for bound, value in rest:
        chain = chain.when(score >= bound, value)
    return chain.otherwise(otherwise)


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def explain_mapping(m: DataFrame) -> DataFrame:
    """Title, summary and detail lines.

    Reads ``source_column, target_column, source_type, target_type, semantic,
    syntactic, type_score, overall``.
    """
    src, tgt = F.col("source_column"), F.col("target_column")
    types = _say(F.col("source_type"), " → ", F.col("target_type"))
    sem, syn, typ, all_ = (F.col(c) for c in ("semantic", "syntactic", "type_score", "overall"))
    meaning = _bands(
        sem,
        [
            (0.8, _say("✅ Strong semantic similarity (", percent(sem), "): The column names have similar meanings")),
            (0.6, _say("✓ Moderate semantic similarity (", percent(sem), "): The columns appear to represent related concepts")),
            (0.4, _say("⚠ Weak semantic similarity (", percent(sem), "): Limited semantic relationship detected")),
        ],
        _say("❌ Low semantic similarity (", percent(sem), "): Names don't appear semantically related"),
    )
    spelling = _bands(
        syn,
        [
            (0.8, _say("✅ Names are very similar (", percent(syn), "): '", src, "' closely matches '", tgt, "'")),
            (0.6, _say("✓ Names are somewhat similar (", percent(syn), "): Possibly abbreviations or variations")),
        ],
        _say("ℹ Names differ significantly (", percent(syn), "): Matched primarily on meaning, not spelling"),
    )
    kind = _bands(
        typ,
        [
            (1.0, _say("✅ Exact type match: Both are ", F.col("source_type"))),
            (0.8, _say("✓ Compatible types: ", types, " (safe conversion)")),
            (0.6, _say("⚠ Type conversion needed: ", types, " (review recommended)")),
        ],
        _say("❌ Type mismatch: ", types, " (manual review required)"),
    )
    pair = _say(src, " → ", tgt)
    return m.withColumn("title", _bands(all_, [(0.85, _say("✅ ", pair)), (0.6, _say("⚠ ", pair))], _say("❓ ", pair))).withColumn(
        "summary",
        _bands(
            all_,
            [
                (0.85, _say("High confidence match (", percent(all_), ")")),
                (0.6, _say("Moderate confidence match (", percent(all_), ") - Review recommended")),
            ],
            _say("Low confidence match (", percent(all_), ") - Manual verification needed"),
        ),
    ).withColumn("details", F.array(meaning, spelling, kind))


def explain_conversion(c: DataFrame) -> DataFrame:
    """Reads ``source_type, target_type, kind, potential_loss``."""
    src, tgt, kind = F.col("source_type"), F.col("target_type"), F.col("kind")

    def both(a: str, b: str) -> Column:
        return (kind == "lossy") & F.contains(src, F.lit(a)) & F.contains(tgt, F.lit(b))

    summary = (
        F.when(kind == "direct", "No transformation needed - types are compatible")
        .when(kind == "implicit", "Safe implicit conversion will be applied")
        .when(kind == "explicit", "Explicit conversion required")
        .when(kind == "lossy", "⚠ Potentially lossy conversion")
        .otherwise("Unknown transformation - manual review required")
    )
    first = (
        F.when(kind == "direct", _say("Source type (", src, ") matches target type (", tgt, ")"))
        .when(kind == "implicit", _say("Converting ", src, " → ", tgt))
        .when(kind == "explicit", _say("Must explicitly convert ", src, " → ", tgt))
        .when(kind == "lossy", _say("Converting ", src, " → ", tgt, " may lose data"))
        .otherwise(_say("No predefined rule for ", src, " → ", tgt))
    )
    details = F.array(
        first,
        F.when(kind == "implicit", "This is a widening conversion and no data will be lost"),
        F.when(kind == "explicit", "A SQL CAST or transformation function will be applied"),
        F.when(both("FLOAT", "INT"), "Decimal values will be truncated"),
        F.when(both("TEXT", "VARCHAR"), "Long text may be truncated"),
        F.when(both("DATETIME", "DATE"), "Time component will be lost"),
        F.when(F.col("potential_loss"), "⚠ RECOMMENDATION: Verify sample data before migration"),
    )
    return c.withColumn("title", _say("Transform: ", src, " → ", tgt)).withColumn("summary", summary).withColumn("details", F.array_compact(details))


def explain_check(checks: DataFrame) -> DataFrame:
    """Why a check did not pass, with advice by the check's name."""
    low = F.lower("check_name")

    def detail(key: str, missing: str) -> Column:
        return F.coalesce(F.try_element_at("details", F.lit(key)), F.lit(missing))

    def arm(found: Column, *advice: str) -> Column:
        return F.array(F.col("message"), found, *[F.lit(f"💡 {a}") for a in advice])

    lines = (
        F.when(F.contains(low, F.lit("null")), arm(_say("Found ", detail("null_counts", "unknown"), " NULL values"), "Consider adding default values", "Verify if NULLs are expected in target schema"))
        .when(F.contains(low, F.lit("duplicate")), arm(_say("Found ", detail("duplicate_count", "unknown"), " duplicate records"), "Remove or merge duplicate records", "Review primary key definition"))
        .when(F.contains(low, F.lit("referential")), arm(_say("Found ", detail("violations", "unknown"), " orphaned records"), "Ensure parent records exist before migration", "Consider ON DELETE CASCADE settings"))
        .when(
            F.contains(low, F.lit("row count")),
            arm(_say("Source: ", detail("source_count", "?"), ", Target: ", detail("target_count", "?")), "Check migration filters", "Verify no records were skipped"),
        )
        .otherwise(F.array(F.col("message")))
    )
    return checks.select("table_name", "check_name", _say("❌ ", F.col("check_name"), " Failed").alias("title"), F.col("message").alias("summary"), lines.alias("lines"))


def plain_mapping(m: DataFrame) -> DataFrame:
    """Plain words for one mapping. Reads the columns of :func:`explain_mapping`."""
    c, syn, sem = F.col("overall"), F.col("syntactic"), F.col("semantic")
    reasons = F.array_compact(
        F.array(
            F.when(syn >= 0.8, "the names are very similar").when(syn >= 0.5, "the names are somewhat similar"),
            F.when(sem >= 0.8, "they appear to mean the same thing").when(sem >= 0.5, "they seem to represent similar data"),
            F.when(F.upper("source_type") == F.upper("target_type"), "they store the same type of data"),
        )
    )
    why = F.when(F.size(reasons) > 0, _say("This match was made because ", F.array_join(reasons, ", and "), ".")).otherwise("This match was made based on overall pattern analysis.")
    return m.select(
        "source_table", "source_column", "target_table", "target_column",
        _say(F.col("source_column"), " → ", F.col("target_column")).alias("title"),
        _say("The system matched '", F.col("source_column"), "' from the old database to '", F.col("target_column"), "' in the new database.").alias("what_happened"),
        why.alias("why_it_happened"),
        _bands(
            c,
            [
                (0.85, "This is a reliable match. Data will transfer correctly without any issues."),
                (0.60, "This match is likely correct, but someone should verify it before the full migration."),
            ],
            "This match needs manual review. The system is not confident about this pairing.",
        ).alias("what_it_means"),
        F.when(c >= 0.85, F.lit(None).cast("string")).when(c >= 0.60, "Please review this mapping before migration.").otherwise("⚠️ Manual verification required before proceeding.").alias("action_needed"),
        _bands(c, [(0.85, "High"), (0.60, "Medium")], "Low").alias("confidence_level"),
        _bands(c, [(0.85, "✅"), (0.60, "⚠️")], "❓").alias("icon"),
    )


def plain_unmapped(unmapped: DataFrame) -> DataFrame:
    is_source = F.col("side") == "source"
    column, table = F.col("column_name"), F.col("table_name")
    return unmapped.select(
        "side", "table_name", "column_name",
        _say("Unmapped: ", column).alias("title"),
        F.when(is_source, _say("The column '", column, "' in the old database table '", table, "' was not matched to any column in the new database."))
        .otherwise(_say("The column '", column, "' in the new database table '", table, "' was not matched to any column in the old database."))
        .alias("what_happened"),
        F.when(is_source, "The system could not find a column in the new database that is similar enough to this one.")
        .otherwise("There doesn't appear to be equivalent data in the old system.")
        .alias("why_it_happened"),
        F.when(is_source, "Data in this column will NOT be migrated unless you manually specify where it should go.")
        .otherwise("This column will remain empty (or use default values) after migration.")
        .alias("what_it_means"),
        F.when(is_source, "Decide if this data needs to be migrated. If yes, manually map it to a target column.")
        .otherwise("Verify if this column should receive data from the old system.")
        .alias("action_needed"),
    )


def plain_rule(rows: DataFrame) -> DataFrame:
    """Plain words for a rule. Reads ``source_column, target_column, rule``."""
    texts = F.map_from_arrays(
        F.array(*map(F.lit, L.RULE_TEXTS)), F.array(*[F.struct(F.lit(t).alias("title"), F.lit(r).alias("reason")) for t, r in L.RULE_TEXTS.values()])
    )
    other = F.struct(F.lit(L.RULE_TEXT_OTHER[0]).alias("title"), F.lit(L.RULE_TEXT_OTHER[1]).alias("reason"))
    chosen = F.coalesce(F.try_element_at(texts, F.col("rule")), other)
    return rows.withColumn("_t", chosen).select(
        "source_column", "target_column", "rule",
        _say("Transform: ", F.col("source_column")).alias("title"),
        _say("Data from '", F.col("source_column"), "' will be converted before going into '", F.col("target_column"), "'.").alias("what_happened"),
        F.col("_t.reason").alias("why_it_happened"),
        _say("Your data will be automatically adjusted: ", F.col("_t.title"), ".").alias("what_it_means"),
    )


def reject_cause(rejects: DataFrame) -> DataFrame:
    """Plain words for a reject, by its typed error."""

    def pick(i: int) -> Column:
        chain = None
        for kind, texts in L.REJECT_CAUSES.items():
            chain = F.when(F.col("error_type") == kind, texts[i]) if chain is None else chain.when(F.col("error_type") == kind, texts[i])
        return chain.otherwise(L.REJECT_CAUSE_OTHER[i])

    number = F.col("record_id").cast("string")
    return rejects.select(
        "record_id", "error_type",
        _say("Failed Record #", number).alias("title"),
        _say("Record #", number, " could not be migrated: ", pick(0), ".").alias("what_happened"),
        pick(1).alias("why_it_happened"),
        F.lit("This specific record was NOT moved to the new system.").alias("what_it_means"),
        pick(2).alias("action_needed"),
    )


def plain_check(checks: DataFrame) -> DataFrame:
    """Plain words for a check, by its name and outcome."""
    low, ok = F.lower("check_name"), F.col("status") == "passed"

    def detail(key: str) -> Column:
        return F.coalesce(F.try_element_at("details", F.lit(key)), F.lit("?"))

    rows, nulls, copies = (F.contains(low, F.lit(w)) for w in ("row count", "null", "duplicate"))

    def choose(row: tuple, null: tuple, copy: tuple, other: tuple) -> Column:
        def either(pair: tuple) -> Column:
            good, bad = (F.lit(x) if not isinstance(x, Column) else x for x in pair)
            return F.when(ok, good).otherwise(bad)

        return F.when(rows, either(row)).when(nulls, either(null)).when(copies, either(copy)).otherwise(either(other))

    return checks.select(
        "table_name", "check_name", "status",
        choose(
            ("Row Count Check", "Row Count Mismatch"), ("Data Completeness Check", "Missing Data Found"), ("Duplicate Check", "Duplicates Found"), (F.col("check_name"), F.col("check_name"))
        ).alias("title"),
        choose(
            ("All records were successfully migrated.", _say("The old system had ", detail("source_count"), " records, but the new system has ", detail("target_count"), ".")),
            ("All required fields have values.", "Some fields have empty values that shouldn't be empty."),
            ("No duplicate records were found.", "The same record appears multiple times."),
            ("A validation check was performed.", "A validation check was performed."),
        ).alias("what_happened"),
        choose(
            ("✅ No data was lost during migration.", "⚠️ Not all data was transferred. Investigation needed."),
            ("✅ Data is complete and ready for use.", "⚠️ Some records may be incomplete in the new system."),
            ("✅ Data integrity is maintained.", "⚠️ You may have redundant data that needs cleanup."),
            ("✅ Check passed.", "⚠️ Check requires attention."),
        ).alias("what_it_means"),
        choose(
            (F.lit(None).cast("string"), "Check the failed records report to see what was missed."),
            (F.lit(None).cast("string"), "Review which fields are empty and decide if they need default values."),
            (F.lit(None).cast("string"), "Identify and remove duplicate records."),
            (F.lit(None).cast("string"), "Review the details and address any issues."),
        ).alias("action_needed"),
    )


def executive_summary(results: DataFrame, mappings: DataFrame, checks: DataFrame) -> DataFrame:
    """One row of totals with the overall status and the closing advice."""
    one = F.lit(1).alias("one")
    moved = results.agg(
        F.count("*").alias("tables"), F.coalesce(F.sum("records_migrated"), F.lit(0)).alias("migrated"), F.coalesce(F.sum("records_failed"), F.lit(0)).alias("failed"), one
    )
    sure = mappings.agg(F.count_if(F.col("confidence_level") == "high").alias("confident"), F.count_if(F.col("confidence_level") != "high").alias("to_review"), one)
    state = checks.agg(F.count_if(F.col("status") == "passed").alias("checks_passed"), F.count_if(F.col("status") == "failed").alias("checks_failed"), one)
    total = F.col("migrated") + F.col("failed")
    clean = (F.col("failed") == 0) & (F.col("checks_failed") == 0)
    rate, shown = F.col("success_rate"), _say(fixed(F.col("success_rate"), 1), "%")
    failed = F.format_number("failed", 0)
    return (
        moved.join(sure, "one").join(state, "one").drop("one")
        .withColumn("success_rate", F.when(total > 0, F.col("migrated") * 100.0 / total).otherwise(F.lit(0.0)))
        .withColumn("overall", F.when(clean, "✅ SUCCESS").when(rate > 95, "⚠️ ATTENTION NEEDED").otherwise("❌ ISSUES DETECTED"))
        .withColumn(
            "meaning",
            F.when(clean, "✅ Great news! The migration completed successfully. All your data has been transferred to the new system without any issues. You can proceed with confidence.")
            .when(rate > 99, _say("⚠️ Almost there! ", shown, " of your data migrated successfully. A small number of records (", failed, ") need manual attention. Review the \"Failed Records\" section below to resolve these issues."))
            .when(rate > 95, _say("⚠️ Needs Review. Most data (", shown, ") transferred correctly, but ", failed, " records require investigation. We recommend reviewing the failures before going live with the new system."))
            .otherwise(_say("❌ Action Required. A significant portion of your data (", failed, " records) did not migrate successfully. Please review the detailed report below and work with your technical team to resolve these issues before proceeding.")),
        )
    )


def qa_report(mappings: DataFrame, unmapped: DataFrame, rejects: DataFrame) -> DataFrame:
    """Question and answer rows on mappings, ignored columns, transformations and rejects."""
    mapped = mappings.select(
        F.lit("column_mapping").alias("topic"),
        _say("Why was '", F.col("source_column"), "' mapped to '", F.col("target_column"), "'?").alias("question"),
        F.col("why_mapped").alias("answer"),
        _say(percent(F.col("ensemble"), 1), " confident").alias("note"),
    )
    ignored = unmapped.where(F.col("side") == "source").select(
        F.lit("ignored_column").alias("topic"), _say("Why was '", F.col("table_name"), ".", F.col("column_name"), "' not mapped?").alias("question"),
        F.col("reason").alias("answer"), F.lit(None).cast("string").alias("note"),
    )
    moved = mappings.where(~F.col("transformation").isin("none", "")).select(
        F.lit("transformation").alias("topic"), _say("What transformation was applied to '", F.col("source_column"), "'?").alias("question"),
        F.col("transformation").alias("answer"), _say(F.col("source_type"), " → ", F.col("target_type")).alias("note"),
    )
    failed = rejects.select(
        F.lit("failed_data").alias("topic"), F.lit("Why did this record fail to migrate?").alias("question"), F.col("error_message").alias("answer"), F.col("record_data").alias("note")
    )
    return mapped.unionByName(ignored).unionByName(moved).unionByName(failed)
