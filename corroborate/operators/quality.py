"""Checks before and after a migration, as rows of one check schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corroborate.functions.text import fixed
from corroborate.functions.types import family, parse_double
from corroborate.specs import TableSpec


def _row(
    table: str | Column,
    name: str | Column,
    status: Column,
    severity: Column,
    message: Column,
    details: dict[str, Column],
    recommendations: Column | None = None,
) -> list[Column]:
    entries = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    empty = F.array().cast("array<string>")
    return [
        (F.lit(table) if isinstance(table, str) else table).alias("table_name"),
        (F.lit(name) if isinstance(name, str) else name).alias("check_name"),
        status.alias("status"),
        severity.alias("severity"),
        message.alias("message"),
        F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull()).alias("details"),
        F.coalesce(recommendations, empty).alias("recommendations") if recommendations is not None else empty.alias("recommendations"),
    ]


def _texts(*texts: str) -> Column:
    return F.array(*map(F.lit, texts))


def _number(c: Column) -> Column:
    return F.format_number(c, 0)


def _text_columns(df: DataFrame, spec: TableSpec) -> list[str]:
    """Columns declared TEXT; with no declaration, string columns."""
    found = []
    for f in df.schema.fields:
        declared = spec.declared_types.get(f.name)
        if family(declared) == "TEXT" if declared else isinstance(f.dataType, T.StringType):
            found.append(f.name)
    return found


def column_facts(df: DataFrame, spec: TableSpec) -> DataFrame:
    """One scan: row count, nulls per column, digit-led values per text column."""
    aggs = [F.count("*").alias("rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(df.columns)]
    aggs += [F.count_if(F.regexp_like(F.col(c), F.lit("^[0-9]"))).alias(f"digit_{c}") for c in _text_columns(df, spec)]
    return df.agg(*aggs)


def row_count_check(facts: DataFrame, table: str) -> DataFrame:
    empty = F.col("rows") == 0
    return facts.select(
        *_row(
            table, "Row Count Check",
            F.when(empty, "warning").otherwise("passed"),
            F.when(empty, "medium").otherwise("low"),
            F.when(empty, f"Table '{table}' is empty").otherwise(F.concat(F.lit(f"Table '{table}' has "), _number(F.col("rows")), F.lit(" rows"))),
            {"row_count": F.col("rows")},
            F.when(empty, _texts("Verify if empty table is expected")),
        )
    )


def null_check(facts: DataFrame, table: str, columns: list[str]) -> DataFrame:
    found = F.filter(
        F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"null_{i}").alias("n")) for i, c in enumerate(columns)]), lambda x: x["n"] > 0
    )
    bad = F.size(found) > 0
    listed = F.array_join(F.transform(found, lambda x: F.concat(x["name"], F.lit("="), x["n"].cast("string"))), ", ")
    return facts.select(
        *_row(
            table, "Null Value Check",
            F.when(bad, "warning").otherwise("passed"),
            F.when(bad, "medium").otherwise("low"),
            F.when(bad, F.concat(F.lit("Found NULL values in "), F.size(found).cast("string"), F.lit(" column(s)"))).otherwise("No NULL values found"),
            {"null_counts": listed},
            F.when(bad, _texts("Verify NULL handling in target schema", "Consider default values for migration")),
        )
    )


def numeric_text_check(facts: DataFrame, df: DataFrame, spec: TableSpec, limit: int = 50) -> DataFrame:
    columns = _text_columns(df, spec)
    issues = F.array_compact(
        F.array(*[F.when(F.col(f"digit_{c}") > limit, f"{c}: TEXT column contains mostly numeric values") for c in columns]).cast("array<string>")
    )
    bad = F.size(issues) > 0
    return facts.select(
        *_row(
            spec.name, "Data Type Check",
            F.when(bad, "warning").otherwise("passed"),
            F.when(bad, "medium").otherwise("low"),
            F.when(bad, F.concat(F.lit("Found "), F.size(issues).cast("string"), F.lit(" potential type issue(s)"))).otherwise("Data types appear consistent"),
            {"issues": F.when(bad, F.array_join(issues, "; ")), "columns_checked": F.when(~bad, F.lit(len(df.columns)))},
            F.when(bad, _texts("Review column types for optimization")),
        )
    )


def _counted(df: DataFrame, keys: list[str], rows: int = 250_000, of: DataFrame | None = None) -> DataFrame:
    """``keys`` with their ``copies``, in as many partitions as ``df``, or ``of`` if it is cheaper to count and no smaller, has ``rows`` rows.

    Most keys occur once, so nothing combines before the shuffle, and a scan
    holds no table of keys. The number of partitions is given, or adaptive
    execution would put well compressed keys of any number into one task. Rows
    of a hot key pass through its task, whose table has one entry for them. Two
    partitions at least: Spark joins a union of single ones, and one task would
    count the keys of all small tables.
    """
    parts = max(2, -(-(df if of is None else of).count() // rows))
    return df.select(*keys).repartition(parts, *keys).groupBy(*keys).agg(F.count("*").alias("copies"))


def duplicate_check(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Keys that occur more than once."""
    spark = df.sparkSession
    if not spec.primary_key:
        return spark.range(1).select(
            *_row(
                spec.name, "Duplicate Check", F.lit("skipped"), F.lit("low"),
                F.lit("No primary key defined, skipping duplicate check"), {"primary_key_columns": F.lit("")},
                _texts("Define primary key for better data integrity"),
            )
        )
    keys = list(spec.primary_key)
    shown = F.concat_ws(",", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    repeated = _counted(df, keys).where(F.col("copies") > 1)
    # the five smallest samples by a top-k, so no list of all duplicates is built
    few = repeated.select(shown.alias("sample")).orderBy("sample").limit(5).agg(F.array_join(F.array_sort(F.collect_list("sample")), "; ").alias("sample"))
    parts = repeated.agg(F.count("*").alias("n")).withColumn("sample", F.lit(None).cast("string")).unionByName(few.withColumn("n", F.lit(None).cast("long")))
    counted = parts.agg(F.max("n").alias("n"), F.max("sample").alias("sample"))
    bad = F.col("n") > 0
    return counted.select(
        *_row(
            spec.name, "Duplicate Check",
            F.when(bad, "failed").otherwise("passed"),
            F.when(bad, "critical").otherwise("low"),
            F.when(bad, F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" duplicate primary key(s)"))).otherwise("No duplicate primary keys found"),
            {"duplicate_count": F.when(bad, F.col("n")), "primary_key_columns": F.lit(", ".join(keys)), "sample_duplicates": F.when(bad, F.col("sample"))},
            F.when(bad, _texts("Remove or merge duplicate records before migration", "Review data quality in source system")),
        )
    )


def duplicate_samples(df: DataFrame, keys: list[str], limit: int = 5) -> DataFrame:
    """A few repeated keys with their number of copies."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1).orderBy(*keys).limit(limit)


def orphan_count(df: DataFrame, column: str, parent: DataFrame, ref_column: str) -> DataFrame:
    """Non-null values without a parent. Values are counted before the join, so a hot one costs one row."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    keys = parent.select(F.col(ref_column).alias("value"))
    return values.join(keys, "value", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))


def foreign_key_check(df: DataFrame, spec: TableSpec, parents: dict[str, DataFrame]) -> DataFrame:
    spark = df.sparkSession
    if not spec.foreign_keys:
        return spark.range(1).select(
            *_row(spec.name, "Referential Integrity Check", F.lit("skipped"), F.lit("low"), F.lit("No foreign keys defined"), {"violations": F.lit(None)})
        )
    # key by key, each with a table of values of its own: only the columns are read again
    names, broken = [], []
    for i, fk in enumerate(spec.foreign_keys):
        kind = parents[fk.ref_table].schema[fk.ref_column].dataType
        names.append(F.lit(f"{fk.column} → {fk.ref_table}.{fk.ref_column}"))
        broken.append(orphan_count(df.select(F.col(fk.column).cast(kind).alias("value")), "value", parents[fk.ref_table], fk.ref_column).withColumn("at", F.lit(i)))
    orphans = reduce(DataFrame.unionByName, broken).where("orphans > 0")
    named = orphans.select("at", F.element_at(F.array(*names), F.col("at") + 1).alias("key"), "orphans")
    merged = named.agg(F.array_sort(F.collect_list(F.struct("at", "key", "orphans"))).alias("broken"))
    bad = F.size("broken") > 0
    listed = F.array_join(F.transform("broken", lambda b: F.concat(b["key"], F.lit("="), b["orphans"].cast("string"))), ", ")
    return merged.select(
        *_row(
            spec.name, "Referential Integrity Check",
            F.when(bad, "failed").otherwise("passed"),
            F.when(bad, "high").otherwise("low"),
            F.when(bad, F.concat(F.lit("Found "), F.size("broken").cast("string"), F.lit(" FK violation(s)"))).otherwise("All foreign key references are valid"),
            {"violations": F.when(bad, listed), "foreign_keys_checked": F.when(~bad, F.lit(len(spec.foreign_keys)))},
            F.when(bad, _texts("Fix orphaned records before migration", "Ensure parent records are migrated first")),
        )
    )


def pre_migration_suite(df: DataFrame, spec: TableSpec, parents: dict[str, DataFrame]) -> DataFrame:
    """All checks of one table. Three of them read one and the same scan."""
    facts = column_facts(df, spec)
    checks = [
        row_count_check(facts, spec.name),
        null_check(facts, spec.name, df.columns),
        duplicate_check(df, spec),
        numeric_text_check(facts, df, spec),
        foreign_key_check(df, spec, parents),
    ]
    return reduce(DataFrame.unionByName, checks)


# --- source against target --------------------------------------------------------


def compare_counts(source: DataFrame, target: DataFrame, source_name: str, target_name: str) -> DataFrame:
    one = F.lit(1).alias("one")
    s = source.agg(F.count("*").alias("s"), one)
    both = s.join(target.agg(F.count("*").alias("t"), one), "one")
    same = F.col("s") == F.col("t")
    gap = F.abs(F.col("s") - F.col("t"))
    pct = F.when(F.col("s") > 0, gap * 100.0 / F.col("s")).otherwise(F.lit(100.0))
    mismatch = F.concat(
        F.lit("Row count mismatch: "), _number(F.col("s")), F.lit(" vs "), _number(F.col("t")), F.lit(" ("), fixed(pct, 2), F.lit("% difference)")
    )
    return both.select(
        *_row(
            f"{source_name} → {target_name}", "Row Count Comparison",
            F.when(same, "passed").otherwise("failed"),
            F.when(same, "low").when(pct > 1, "critical").otherwise("high"),
            F.when(same, F.concat(F.lit("Row counts match: "), _number(F.col("s")))).otherwise(mismatch),
            {"source_count": F.col("s"), "target_count": F.col("t"), "difference": F.when(~same, gap)},
            F.when(~same, _texts("Investigate missing/extra records", "Check migration filters and conditions")),
        )
    )


def column_counts(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Rows, distinct values and nulls per column, in one scan.

    Exact counts group (column, value) pairs, which combine before the shuffle;
    ``exact=False`` uses sketches and no shuffle of values.
    """
    if not exact:
        stats = [
            F.struct(F.lit(c).alias("column_name"), F.count("*").alias("rows"), F.approx_count_distinct(c).alias("distinct_values"), F.count_if(F.col(c).isNull()).alias("nulls"))
            for c in columns
        ]
        return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    counted = df.select(F.inline(F.array(*pairs))).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    return counted.groupBy("column_name").agg(
        F.sum("n").alias("rows"), F.count("value").alias("distinct_values"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls")
    )


def compare_columns(
    source: DataFrame, target: DataFrame, pairs: list[tuple[str, str]], source_name: str, target_name: str, exact: bool = True
) -> DataFrame:
    """Distinct and null counts of every mapped pair of columns."""
    spark = source.sparkSession
    s = column_counts(source, sorted({a for a, _ in pairs}), exact).alias("s")
    t = column_counts(target, sorted({b for _, b in pairs}), exact).alias("t")
    mapped = spark.createDataFrame(pairs, "source string, target string")
    rows = F.broadcast(mapped).join(s, F.col("source") == F.col("s.column_name")).join(t, F.col("target") == F.col("t.column_name"))
    issues = F.array_compact(
        F.array(
            F.when(
                F.col("s.distinct_values") != F.col("t.distinct_values"),
                F.format_string("Distinct values differ: %d vs %d", "s.distinct_values", "t.distinct_values"),
            ),
            F.when(F.col("s.nulls") != F.col("t.nulls"), F.format_string("NULL counts differ: %d vs %d", "s.nulls", "t.nulls")),
        )
    )
    bad = F.size(issues) > 0
    return rows.select(
        *_row(
            f"{source_name} → {target_name}", F.format_string("Column Comparison: %s → %s", "source", "target"),
            F.when(bad, "warning").otherwise("passed"),
            F.when(bad, "medium").otherwise("low"),
            F.when(bad, "Column value differences detected").otherwise("Column values match"),
            {
                "issues": F.when(bad, F.array_join(issues, "; ")),
                "distinct_values": F.when(~bad, F.col("s.distinct_values")),
                "null_count": F.when(~bad, F.col("s.nulls")),
            },
        )
    )


def distributions(df: DataFrame, columns: list[str], accuracy: int = 10000) -> DataFrame:
    """Count, min, max, mean, standard deviation and quartiles of columns, in one scan. Text counts where it is a number."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def number(c: str) -> Column:
        return parse_double(F.col(c)) if isinstance(kinds[c], T.StringType) else F.col(c).cast("double")

    stats = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(number(c)).alias("n"),
            F.min(number(c)).alias("low"),
            F.max(number(c)).alias("high"),
            F.avg(number(c)).alias("mean"),
            F.stddev_samp(number(c)).alias("stddev"),
            F.percentile_approx(number(c), [0.25, 0.5, 0.75], accuracy).alias("quartiles"),
        )
        for c in columns
    ]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def compare_distributions(
    source: DataFrame, target: DataFrame, pairs: list[tuple[str, str]], source_name: str, target_name: str, tolerance: float = 0.01
) -> DataFrame:
    """Warn when mean or spread of a mapped numeric pair moves by more than ``tolerance``."""
    spark = source.sparkSession
    s = distributions(source, sorted({a for a, _ in pairs})).alias("s")
    t = distributions(target, sorted({b for _, b in pairs})).alias("t")
    mapped = spark.createDataFrame(pairs, "source string, target string")
    rows = F.broadcast(mapped).join(s, F.col("source") == F.col("s.column_name")).join(t, F.col("target") == F.col("t.column_name"))

    def moved(name: str) -> Column:
        a, b = F.col(f"s.{name}"), F.col(f"t.{name}")
        scale = F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))
        return F.coalesce(F.abs(a - b) > tolerance * scale, a.isNull() != b.isNull())

    bad = moved("mean") | moved("stddev")
    return rows.select(
        *_row(
            f"{source_name} → {target_name}", F.format_string("Distribution Comparison: %s → %s", "source", "target"),
            F.when(bad, "warning").otherwise("passed"),
            F.when(bad, "medium").otherwise("low"),
            F.when(bad, "Distributions differ").otherwise("Distribution comparison completed"),
            {"source_mean": fixed(F.col("s.mean"), 4), "target_mean": fixed(F.col("t.mean"), 4)},
        )
    )


def post_migration_suite(
    source: DataFrame, target: DataFrame, pairs: list[tuple[str, str]], source_name: str, target_name: str, numeric: list[tuple[str, str]] | None = None, exact: bool = True
) -> DataFrame:
    if numeric is None:
        kinds = {f.name: f.dataType for f in source.schema.fields} , {f.name: f.dataType for f in target.schema.fields}
        numeric = [(a, b) for a, b in pairs if isinstance(kinds[0][a], (T.NumericType, T.StringType)) and isinstance(kinds[1][b], T.NumericType)]
    checks = [
        compare_counts(source, target, source_name, target_name),
        compare_columns(source, target, pairs, source_name, target_name, exact),
    ]
    if numeric:
        checks.append(compare_distributions(source, target, numeric, source_name, target_name))
    return reduce(DataFrame.unionByName, checks)


# --- summaries --------------------------------------------------------------------


def summarize(checks: DataFrame) -> DataFrame:
    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return checks.agg(
        F.count("*").alias("total_checks"),
        count("passed").alias("passed"),
        count("failed").alias("failed"),
        count("warning").alias("warnings"),
        count("skipped").alias("skipped"),
        F.count_if((F.col("status") == "failed") & (F.col("severity") == "critical")).alias("critical_issues"),
    )


def overall_status(summary: DataFrame) -> DataFrame:
    return summary.withColumn(
        "overall_status",
        F.when(F.col("critical_issues") > 0, "BLOCKED")
        .when(F.col("failed") > 0, "REVIEW_REQUIRED")
        .when(F.col("warnings") > 0, "PASSED_WITH_WARNINGS")
        .otherwise("PASSED"),
    )


def run_validation(source: DataFrame, target: DataFrame, pairs: list[tuple[str, str]], source_name: str, target_name: str) -> DataFrame:
    """Counts, null match and duplicate target values of one migrated pair, in long form.

    Duplicates are looked for in targets whose source name contains ``id``;
    NULL is a value here. They raise issues but do not make a run invalid.
    """
    one = F.lit(1).alias("one")
    nulls_s = [F.count_if(F.col(a).isNull()).alias(f"s{i}") for i, (a, _) in enumerate(pairs)]
    nulls_t = [F.count_if(F.col(b).isNull()).alias(f"t{i}") for i, (_, b) in enumerate(pairs)]
    both = source.agg(F.count("*").alias("s"), *nulls_s, one).join(target.agg(F.count("*").alias("t"), *nulls_t, one), "one")

    def item(check, name, a, b, ok):
        return F.struct(F.lit(check).alias("check"), F.lit(name).alias("item"), a.cast("bigint").alias("source_value"), b.cast("bigint").alias("target_value"), ok.alias("matches"))

    items = [item("row_count", f"{source_name} -> {target_name}", F.col("s"), F.col("t"), F.col("s") == F.col("t"))]
    items += [item("nulls", f"{a} -> {b}", F.col(f"s{i}"), F.col(f"t{i}"), F.col(f"s{i}") == F.col(f"t{i}")) for i, (a, b) in enumerate(pairs)]
    rows = both.select(F.inline(F.array(*items)))
    for a, b in pairs:
        if "id" in a.lower():
            repeated = target.groupBy(b).agg(F.count("*").alias("n")).where(F.col("n") > 1).agg(F.count("*").alias("n"))
            rows = rows.unionByName(repeated.select(F.inline(F.array(item("duplicates", b, F.lit(None), F.col("n"), F.col("n") == 0)))))
    return rows.withColumn("source_table", F.lit(source_name)).withColumn("target_table", F.lit(target_name))


def validation_issues(rows: DataFrame) -> DataFrame:
    """Issue count, validity and summary of a run's validation rows."""
    issues = F.count_if(~F.col("matches") & F.col("check").isin("row_count", "duplicates"))
    return rows.agg(
        issues.alias("issues"), (F.count_if(~F.col("matches") & (F.col("check") == "row_count")) == 0).alias("is_valid")
    ).withColumn(
        "summary",
        F.when(F.col("issues") == 0, "✓ All validation checks passed. Data migration is complete and accurate.").otherwise(
            F.concat(F.lit("⚠ "), F.col("issues").cast("string"), F.lit(" validation issues found. Review the detailed report."))
        ),
    )


def health_totals(rows: DataFrame, rows_migrated: Column | None = None) -> DataFrame:
    """Totals over a run's validation rows; percentages are capped at 100."""

    def total(check: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("check") == check, F.col(column))), F.lit(0)).cast("bigint")

    sums = rows.agg(
        total("row_count", "source_value").alias("source_rows"),
        total("row_count", "target_value").alias("target_rows"),
        total("nulls", "target_value").alias("target_nulls"),
        total("duplicates", "target_value").alias("duplicates"),
        F.count_if((F.col("check") == "nulls") & ~F.col("matches")).alias("null_mismatches"),
        F.count_if((F.col("check") == "duplicates") & ~F.col("matches")).alias("duplicate_columns"),
    )
    migrated = rows_migrated if rows_migrated is not None else F.col("target_rows")
    pct = F.when(F.col("source_rows") > 0, F.round(F.least(migrated * 100.0 / F.col("source_rows"), F.lit(100.0)), 1)).otherwise(F.lit(100.0))
    return sums.withColumn("row_delta", F.col("target_rows") - F.col("source_rows")).withColumn("completion_pct", pct)
