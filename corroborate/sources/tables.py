"""Target tables and result files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.sources.corpus import store_exists


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """Selected columns of a table in any Spark format."""
    df = spark.read.format(fmt).options(**options).load(path)
    return df.select(*columns) if columns else df


def append_rows(rows: DataFrame, path: str, run_id: str, batch_id: int = 0, **more: str) -> None:
    """Append rows under run, batch and what else is given: writing them again replaces them, also by none.

    Batch runs have one batch, 0, so that streams and batch runs share a layout.
    """
    overwrite_partition(rows, path, {"run_id": run_id, "batch_id": batch_id, **more})


def overwrite_partition(rows: DataFrame, path: str, at: dict[str, str | int]) -> None:
    """Replace the partition ``at`` by ``rows``; no rows leave no partition. ``rows`` should be staged: they are looked at first."""
    spark = rows.sparkSession
    if rows.isEmpty():
        root = _folder(spark, path)
        for place in _partitions(spark, root, at):
            root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if store_exists(spark, path):
            return
    tagged = rows.withColumns({k: F.lit(v).cast("long") if isinstance(v, int) else F.lit(v) for k, v in at.items()})
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*at).parquet(path)


def _folder(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _partitions(spark: SparkSession, root, at: dict[str, str | int]) -> list:
    """Folders of the partitions that ``at`` names, a key per level."""
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    places = [root] if fs.exists(root) else []
    for key, value in at.items():
        places = [s.getPath() for place in places for s in fs.listStatus(place) if unescape(s.getPath().getName()) == f"{key}={value}"]
    return places


def without_run(target: DataFrame, run_id: str) -> DataFrame:
    """What a rollback of ``run_id`` leaves."""
    return target.where(F.col("run_id") != run_id)


def rollback(spark: SparkSession, path: str, run_id: str | None = None) -> None:
    """Remove a run's partitions; without ``run_id`` every partition."""
    if not store_exists(spark, path):
        return
    root = _folder(spark, path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if run_id is None:
        places = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("run_id=")]
    else:
        places = _partitions(spark, root, {"run_id": run_id})
    for place in places:
        fs.delete(place, True)


def rollback_run(spark: SparkSession, out: str, run_id: str | None = None) -> None:
    """Remove what a run wrote under ``out``: rows of all its tables, their rejects and the progress log."""
    root = _folder(spark, out)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(root) if fs.exists(root) else []:
        if status.isDirectory():
            rollback(spark, status.getPath().toString(), run_id)


def write_json(report: DataFrame, path: str) -> None:
    """Report rows as JSON, without the markup column."""
    report.drop("annotated_html").write.mode("overwrite").json(path)


def _told(fmt: str) -> tuple[Column, Column, Column | None]:
    """Number of an explanation's section, its lines, and the header of its section."""
    kinds = ["mapping", "transformation", "validation", "recommendation", "warning"]
    headers = ["## Column Mappings", "## Data Transformations", "## Validation Results", "## Recommendations", "## ⚠ Warnings"]
    section = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int")
    head = None
    if fmt == "json":
        body = F.array(F.to_json(F.struct("kind", "title", "summary", "details")))
    elif fmt == "text":
        body = F.concat(
            F.array(F.concat(F.lit("["), F.upper("kind"), F.lit("] "), "title"), F.concat(F.lit("  "), "summary")),
            F.transform("details", lambda d: F.concat(F.lit("    • "), d)),
            F.array(F.lit("")),
        )
    elif fmt == "markdown":
        body = F.concat(
            F.array(F.concat(F.lit("### "), "title"), F.lit(""), F.concat(F.lit("**"), "summary", F.lit("**")), F.lit("")),
            F.transform("details", lambda d: F.concat(F.lit("- "), d)),
            F.array(F.lit("")),
        )
        head = F.element_at(F.array(*map(F.lit, headers)), section)
    else:
        raise ValueError(f"unknown format: {fmt}")
    return section, body, head


def report_lines(explanations: DataFrame, fmt: str = "markdown") -> DataFrame:
    """Lines of the explanation report: ``(section, position, line, text)``; a section's header is its line 0 without a position.

    ``explanations(kind, position, title, summary, details)``; sections come in
    a fixed order. Lines stay rows, so a report of any length is never one value.
    """
    section, body, head = _told(fmt)
    lines = explanations.select(section.alias("section"), "position", F.posexplode(body).alias("line", "text"))
    if head is not None:
        titles = explanations.select(section.alias("section"), head.alias("text")).distinct()
        lines = lines.unionByName(titles.select("section", F.lit(None).cast("bigint").alias("position"), F.lit(0).alias("line"), "text"))
    return lines


def write_report(explanations: DataFrame | list[DataFrame], path: str, fmt: str = "markdown", made_of: list[DataFrame] | None = None, compression: str = "none") -> None:
    """Write the lines in order, each section after its header.

    A list has a frame per section, in the order of the sections, with its rows
    as they shall lie (no ``position`` is read). So a caller can sort what
    explanations are made of, and neither texts nor lines are sorted. ``made_of(kind)``
    has a frame per section that has rows if the section has, and is cheaper to
    look at. Lines repeat much: ``compression`` is a codec of Spark's text files.
    """
    if isinstance(explanations, DataFrame):
        ordered = report_lines(explanations, fmt).orderBy("section", F.asc_nulls_first("position"), "line").select("text")
    else:
        _, body, head = _told(fmt)
        told = []
        for rows, seen in zip(explanations, made_of or explanations, strict=True):
            if head is not None:
                told.append(seen.limit(1).select(head.alias("text")))
            told.append(rows.select(F.explode(body).alias("text")))
        ordered = reduce(DataFrame.union, told)
    ordered.write.mode("overwrite").option("compression", compression).text(path)
