"""Move rows: project by mappings, route the rows that break constraints, count."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corroborate.functions.text import percent
from corroborate.functions.rules import compile_mapping, describe
from corroborate.operators.quality import _counted
from corroborate.session import small, stage
from corroborate.specs import Mapping, TablePlan, TableSpec


def project(df: DataFrame, mappings: tuple[Mapping, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Target columns of all mappings: renamed, converted, split and merged."""
    columns = [c for m in mappings for c in compile_mapping(m, df.schema)]
    return df.select(*keep, *columns)


@dataclass(frozen=True)
class Routed:
    """Projected rows with ``_id``, ``_record`` and ``_local``, and the verdicts on those that other rows or tables decide.

    ``_local`` is the reason of a row that breaks a constraint by itself.
    ``verdicts(_id, _reason)`` has the others that are rejected, or is None
    where no constraint asks for them. Rows and verdicts meet once, by id: the
    verdicts are broadcast if their size allows it.
    """

    rows: DataFrame
    verdicts: DataFrame | None
    source_name: str

    @property
    def accepted(self) -> DataFrame:
        rows = self.rows.where(F.col("_local").isNull())
        if self.verdicts is not None:
            bad = self.verdicts.select(F.col("_id").alias("_bad"))
            rows = rows.join(bad, F.col("_id").eqNullSafe(F.col("_bad")), "left_anti")
        return rows.select(*[c for c in self.rows.columns if not c.startswith("_")])

    @property
    def rejects(self) -> DataFrame:
        rows, reason = self.rows, F.col("_local")
        if self.verdicts is not None:
            bad = self.verdicts.select(F.col("_id").alias("_bad"), "_reason")
            rows, reason = rows.join(bad, F.col("_id").eqNullSafe(F.col("_bad")), "left"), F.coalesce("_local", "_reason")
        compound = isinstance(self.rows.schema["_id"].dataType, T.StructType)
        shown = F.to_json("_id") if compound else F.col("_id").cast("string")
        return rows.withColumn("_why", reason).where(F.col("_why").isNotNull()).select(
            F.lit(self.source_name).alias("source_table"),
            shown.alias("record_id"),
            F.col("_record").alias("record_data"),
            F.col("_why.message").alias("error_message"),
            F.col("_why.type").alias("error_type"),
        )

    def counts(self) -> DataFrame:
        """One row: attempted, migrated and failed."""
        counts = self.rows.agg(F.count("*").alias("records_attempted"), F.count_if(F.col("_local").isNotNull()).alias("_failed"))
        if self.verdicts is not None:
            counts = counts.join(F.broadcast(self.verdicts.agg(F.count("*").alias("_more"))), how="cross")
        failed = F.col("_failed") + (F.col("_more") if self.verdicts is not None else F.lit(0))
        return counts.select("records_attempted", (F.col("records_attempted") - failed).alias("records_migrated"), failed.alias("records_failed"))


def _reason(kind: str, message: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(message).alias("message"))


def _first_of(reasons: list[Column]) -> Column:
    nothing = F.lit(None).cast("struct<type:string,message:string>")
    return F.coalesce(*reasons, nothing) if reasons else nothing


def _judged(rows: DataFrame, spec: TableSpec, row_id: Column, record: Column) -> DataFrame:
    """``rows`` with ``_id``, ``_record`` and ``_local``."""
    local = [F.when(F.col(c).isNull(), _reason("NOT NULL", f"NOT NULL constraint failed: {spec.name}.{c}")) for c in spec.required]
    local += [F.when(~F.expr(e), _reason("CHECK", f"CHECK constraint failed: {name}")) for name, e in spec.checks.items()]
    return rows.withColumns({"_id": row_id, "_record": record, "_local": _first_of(local)})


def _unique(spec: TableSpec) -> Column:
    return _reason("UNIQUE", f"UNIQUE constraint failed: {', '.join(f'{spec.name}.{k}' for k in spec.primary_key)}")


def _against_others(rows: DataFrame, spec: TableSpec, parents: dict[str, DataFrame] | None, target: DataFrame | None) -> DataFrame:
    """Ids, keys and ``_reason`` of the rows that are sound by themselves: missing parents, and keys that the target holds.

    Missing and held values are staged, and broadcast if they are few, as they
    mostly are. So the rows are not shuffled to look them up.
    """
    keys = list(spec.primary_key)
    for fk in spec.foreign_keys:
        if not parents or fk.ref_table not in parents:
            raise ValueError(f"no parent table {fk.ref_table} given for {spec.name}.{fk.column}")
    thin = rows.where(F.col("_local").isNull()).select("_id", *dict.fromkeys(keys + [fk.column for fk in spec.foreign_keys]))
    sound, reasons = thin, []
    for i, fk in enumerate(spec.foreign_keys):
        # distinct values first: the missing ones are few, and a hot value is one row
        have = parents[fk.ref_table].select(F.col(fk.ref_column).alias(fk.column))
        missing = stage(sound.select(fk.column).where(F.col(fk.column).isNotNull()).distinct().join(have, fk.column, "left_anti"), "missing")
        thin = thin.join(small(missing, rows=1_000_000).withColumn(f"_fk{i}", F.lit(True)), fk.column, "left")
        reasons.append(F.when(F.col(f"_fk{i}"), _reason("FOREIGN KEY", f"FOREIGN KEY constraint failed: {spec.name}.{fk.column}")))
    if target is not None and keys:
        # only the keys that come in are looked up in the target
        held = stage(target.select(*keys).join(sound.select(*keys).distinct(), keys, "left_semi").distinct(), "held")
        thin = thin.join(small(held, rows=1_000_000).withColumn("_held", F.lit(True)), keys, "left")
        reasons.append(F.when(F.col("_held"), _unique(spec)))
    return thin.withColumn("_reason", _first_of(reasons))


def route_rows(
    rows: DataFrame,
    spec: TableSpec,
    row_id: Column,
    source_name: str,
    record: Column,
    parents: dict[str, DataFrame] | None = None,
    target: DataFrame | None = None,
) -> Routed:
    """Split projected rows into accepted and rejected ones.

    Checked in this order: required columns, check expressions, foreign keys,
    keys already in the target, repeated keys. Of valid rows with one key the
    smallest ``row_id`` wins, so ``row_id`` must be unique.

    Two phases. The first reads ids, keys and foreign keys only, of the rows
    that are sound by themselves: missing parents are found among distinct
    values, held keys among those that come in, repeated keys by a count with
    map-side combine, so no step gathers the rows of a key. What it rejects is
    staged, and its size decides how it is joined to the whole rows, of which
    this is the only join.
    """
    keys = list(spec.primary_key)
    rows = _judged(rows, spec, row_id, record)
    if not keys and not spec.foreign_keys:
        return Routed(rows, None, source_name)
    thin = _against_others(rows, spec, parents, target)
    if keys:
        copies = thin.where(F.col("_reason").isNull()).groupBy(*keys).agg(F.count("*").alias("_copies"), F.min("_id").alias("_winner"))
        thin = thin.join(copies.where(F.col("_copies") > 1).drop("_copies"), keys, "left")
        lost = F.col("_winner").isNotNull() & (F.col("_id") != F.col("_winner"))
        thin = thin.withColumn("_reason", F.coalesce("_reason", F.when(lost, _unique(spec))))
    verdicts = stage(thin.where(F.col("_reason").isNotNull()).select("_id", "_reason"), "verdicts")
    return Routed(rows, small(verdicts, rows=1_000_000), source_name)


def count_rows(rows: DataFrame, spec: TableSpec, row_id: Column, parents: dict[str, DataFrame] | None = None, target: DataFrame | None = None) -> DataFrame:
    """The counts of :func:`route_rows`, of which no row is needed: of the valid rows with one key all but one fail, whichever wins."""
    rows = _judged(rows, spec, row_id, F.lit(None))
    totals = rows.agg(F.count("*").alias("records_attempted"), F.count_if(F.col("_local").isNotNull()).alias("_failed"))
    failed = [F.col("_failed")]
    if spec.primary_key or spec.foreign_keys:
        thin = _against_others(rows, spec, parents, target)
        totals = totals.join(F.broadcast(thin.agg(F.count_if(F.col("_reason").isNotNull()).alias("_others"))), how="cross")
        failed.append(F.col("_others"))
        if spec.primary_key:
            keys = _counted(thin.where(F.col("_reason").isNull()), list(spec.primary_key), of=rows)
            totals = totals.join(F.broadcast(keys.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("_repeated"))), how="cross")
            failed.append(F.col("_repeated"))
    return totals.select("records_attempted", (F.col("records_attempted") - sum(failed)).alias("records_migrated"), sum(failed).alias("records_failed"))


def _projected(source: DataFrame, plan: TablePlan) -> tuple[DataFrame, Column]:
    """Target columns with the source's used ones in ``_row``, and the id of a row."""
    used = sorted({s for m in plan.mappings for s in m.sources} | set(plan.row_id))
    kept = source.withColumn("_row", F.struct(*[F.col(c) for c in used]))
    ids = [F.col(f"_row.{c}") for c in plan.row_id]
    return project(kept, plan.mappings, ("_row",)), ids[0] if len(ids) == 1 else F.struct(*ids)


def migrate(source: DataFrame, plan: TablePlan, parents: dict[str, DataFrame] | None = None, target: DataFrame | None = None) -> Routed:
    """Project and route the rows of one table pair; of these nothing is written but what the verdicts need."""
    projected, row_id = _projected(source, plan)
    routed = route_rows(projected, plan.target, row_id, plan.source_table, F.to_json("_row", {"ignoreNullFields": "false"}), parents, target)
    return Routed(routed.rows.drop("_row"), routed.verdicts, routed.source_name)


def migration_counts(source: DataFrame, plan: TablePlan, parents: dict[str, DataFrame] | None = None, target: DataFrame | None = None) -> DataFrame:
    """The result of one table pair as of :func:`migration_result`, without routing its rows."""
    projected, row_id = _projected(source, plan)
    return _result(plan, count_rows(projected, plan.target, row_id, parents, target))


def migration_result(plan: TablePlan, routed: Routed) -> DataFrame:
    """Attempted, migrated, failed and status of one table pair."""
    return _result(plan, routed.counts())


def _result(plan: TablePlan, counts: DataFrame) -> DataFrame:
    named = counts.select(F.lit(plan.source_table).alias("source_table"), F.lit(plan.target.name).alias("target_table"), "*")
    applied = F.array(*[F.lit(d) for d in dict.fromkeys(describe(m) for m in plan.mappings)])
    return _with_status(named).withColumn("transformations_applied", applied)


def _with_status(results: DataFrame) -> DataFrame:
    rate = F.when(F.col("records_attempted") > 0, percent(F.col("records_migrated") / F.col("records_attempted"), 1)).otherwise("N/A")
    failed = (F.col("records_attempted") > 0) & (F.col("records_migrated") == 0)
    return results.withColumn("status", F.when(F.col("records_failed") == 0, "completed").when(failed, "failed").otherwise("partial")).withColumn("success_rate", rate)


def migration_report(results: DataFrame) -> DataFrame:
    """Totals of a run. A table that failed outright also rules out SUCCESS."""
    totals = results.agg(
        F.count("*").alias("total_tables"),
        F.coalesce(F.sum("records_attempted"), F.lit(0)).alias("total_records_attempted"),
        F.coalesce(F.sum("records_migrated"), F.lit(0)).alias("total_records_migrated"),
        F.coalesce(F.sum("records_failed"), F.lit(0)).alias("total_records_failed"),
        F.count_if(F.col("status") == "failed").alias("_broken"),
    )
    rate = percent(F.col("total_records_migrated") / F.col("total_records_attempted"), 1)
    return totals.withColumn(
        "overall_success_rate", F.when(F.col("total_records_attempted") > 0, rate).otherwise("N/A")
    ).withColumn(
        "status",
        F.when((F.col("total_records_failed") == 0) & (F.col("_broken") == 0), "SUCCESS").when(F.col("total_records_migrated") > 0, "PARTIAL").otherwise("FAILED"),
    ).drop("_broken")


def dry_run(plan: TablePlan, routed: Routed) -> DataFrame:
    """Counts without writing, with the rejects that a real run would give."""
    return migration_result(plan, routed).drop("transformations_applied").withColumn("dry_run", F.lit(True))


def merge_results(results: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, results)
