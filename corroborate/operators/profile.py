"""Catalogs and profiles of tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corroborate.functions import lexicon as L
from corroborate.specs import TableSpec

CATALOG_SCHEMA = (
    "table_name string, column_name string, position int, data_type string, is_nullable boolean, "
    "is_primary_key boolean, is_foreign_key boolean, foreign_key_ref string, default_value string, max_length int"
)


def column_catalog(spark: SparkSession, tables: dict[str, DataFrame], specs: dict[str, TableSpec], samples: int = 0) -> DataFrame:
    """One row per column. Without ``samples`` it is metadata only and no table is read.

    ``max_length`` is the size that a declared type gives (none for two numbers,
    as in ``DECIMAL(10,2)``). With ``samples``, ``sample_values`` has that many
    of the smallest distinct values, in one scan per table.
    """
    rows = []
    for name, df in tables.items():
        spec = specs.get(name, TableSpec(name))
        refs = {fk.column: f"{fk.ref_table}.{fk.ref_column}" for fk in spec.foreign_keys}
        for i, f in enumerate(df.schema.fields):
            declared = spec.declared_types.get(f.name, f.dataType.simpleString().upper())
            size = re.search(r"\((\d+)\)", declared)
            key = (f.nullable and f.name not in spec.required, f.name in spec.primary_key, f.name in refs, refs.get(f.name))
            rows.append((name, f.name, i, declared, *key, spec.defaults.get(f.name), int(size[1]) if size else None))
    catalog = spark.createDataFrame(rows, CATALOG_SCHEMA)
    if not samples:
        return catalog
    found = [sample_values(df, samples).select(F.lit(name).alias("table_name"), "column_name", "rank", "value") for name, df in tables.items()]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"])
    held = reduce(DataFrame.unionByName, found).groupBy("table_name", "column_name").agg(listed.alias("sample_values"))
    return catalog.join(held, ["table_name", "column_name"], "left").withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def as_text_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Long form (column_name, value) of all columns, as text, in one scan."""
    columns = columns or df.columns
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pairs)))


def _smallest(df: DataFrame, k: int) -> DataFrame:
    """``(column_name, value)``: the ``k`` smallest distinct values of every text column, as far as each task knows."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {name: [] for name in names}
        for batch in batches:
            for name, column in zip(names, batch.columns, strict=True):
                if len(held[name]) == k:
                    column = column.filter(pc.less(column, held[name][-1]))
                if len(column) - column.null_count:
                    held[name] = sorted({*held[name], *pc.unique(column.drop_null()).to_pylist()})[:k]
        found = [(name, value) for name, values in held.items() for value in values]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["column_name", "value"])

    return df.mapInArrow(run, "column_name string, value string")


def sample_values(df: DataFrame, limit: int = 5) -> DataFrame:
    """The ``limit`` smallest distinct non-null values of every column.

    One scan for all columns: a task keeps the smallest it has seen, so at most
    ``limit`` values per column and task are shuffled, whatever the table holds.
    """
    simple = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    if not simple:
        return df.sparkSession.createDataFrame([], "column_name string, value string, rank int")
    distinct = _smallest(df.select(*[F.col(c).cast("string").alias(c) for c in simple]), limit).distinct()
    first = Window.partitionBy("column_name").orderBy("value")
    return distinct.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= limit)


def compare_names(source: DataFrame, target: DataFrame, column: str = "table_name") -> DataFrame:
    """Names in both, only in source, only in target; case does not matter."""
    name = F.lower(F.col(column)).alias("name")
    s, t = source.select(name), target.select(name)
    return (
        s.intersect(t).withColumn("side", F.lit("common"))
        .unionByName(s.subtract(t).withColumn("side", F.lit("source_only")))
        .unionByName(t.subtract(s).withColumn("side", F.lit("target_only")))
    )


def split_candidates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in which one delimiter is in more than half of the non-null values.

    The delimiter with most hits wins, the first listed on ties. One scan for
    all columns and delimiters.
    """
    long = as_text_columns(df, columns).where(F.col("value").isNotNull())
    aggs = [F.count("*").alias("n"), F.min("value").alias("example")]
    for i, d in enumerate(L.SPLIT_DELIMITERS):
        aggs.append(F.count_if(F.contains("value", F.lit(d))).alias(f"hits_{i}"))
        aggs.append(F.sum(F.size(F.split("value", f"\\Q{d}\\E", -1))).alias(f"parts_{i}"))
    stats = long.groupBy("column_name").agg(*aggs)
    options = F.array(
        *[
            F.when(
                F.col(f"hits_{i}") > F.col("n") * 0.5,
                F.struct(
                    F.col(f"hits_{i}").alias("hits"),
                    F.lit(-i).alias("order"),
                    F.lit(d).alias("delimiter"),
                    F.round(F.col(f"parts_{i}") / F.col("n"), 1).alias("average_parts"),
                ),
            )
            for i, d in enumerate(L.SPLIT_DELIMITERS)
        ]
    )
    best = stats.withColumn("best", F.array_max(F.array_compact(options))).where(F.col("best").isNotNull())
    return best.select(
        "column_name",
        F.col("best.delimiter").alias("recommended_delimiter"),
        F.col("best.average_parts").alias("average_parts"),
        F.split("example", F.concat(F.lit("\\Q"), "best.delimiter", F.lit("\\E")), -1).alias("sample"),
    )


def merge_candidates(catalog: DataFrame) -> DataFrame:
    """The first listed pattern whose columns all exist in a table; case and ``_`` do not matter."""

    def flat(c):
        return F.replace(F.lower(c), F.lit("_"), F.lit(""))

    patterns = [
        F.struct(
            F.lit(i).alias("order"),
            F.array(*[F.lit(c.replace("_", "")) for c in cols]).alias("parts"),
            F.lit(target).alias("suggested_target"),
            F.lit(template).alias("merge_template"),
        )
        for i, (cols, target, template) in enumerate(L.MERGE_PATTERNS)
    ]
    wanted = sorted({c.replace("_", "") for cols, _, _ in L.MERGE_PATTERNS for c in cols})
    tables = (
        catalog.where(flat(F.col("column_name")).isin(wanted))
        .groupBy("table_name", flat(F.col("column_name")).alias("part"))
        .agg(F.min(F.struct("position", "column_name"))["column_name"].alias("column_name"))
        .groupBy("table_name")
        .agg(F.map_from_entries(F.collect_list(F.struct("part", "column_name"))).alias("found"))
    )
    fits = F.filter(F.array(*patterns), lambda p: F.size(F.array_except(p["parts"], F.map_keys("found"))) == 0)
    return (
        tables.withColumn("pick", F.try_element_at(fits, F.lit(1)))
        .where(F.col("pick").isNotNull())
        .select(
            "table_name",
            F.transform("pick.parts", lambda p: F.col("found")[p]).alias("source_columns"),
            "pick.suggested_target",
            "pick.merge_template",
        )
    )
