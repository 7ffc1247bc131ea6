"""Live migration and continuous grounding.

Every micro-batch writes into partitions named after the run and the batch, so
a batch that is replayed after a failure replaces its own output.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corroborate.operators import move, quality, retrieval
from corroborate.plans.grounding import ground
from corroborate.session import stage
from corroborate.sources.corpus import store_exists
from corroborate.sources.tables import append_rows
from corroborate.specs import TablePlan


def migrate_stream(
    source: DataFrame,
    plan: TablePlan,
    out: str,
    run_id: str,
    checkpoint: str,
    parents: dict[str, DataFrame] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Move a stream of source rows; one progress row per batch.

    Keys are unique across batches: a batch is checked against the rows of all
    earlier ones, but not against its own earlier attempt. A batch that cannot
    be moved is recorded as an error and fails the query, so that it is
    delivered again; what is recorded then is replaced.
    """
    pair = {"source_table": plan.source_table, "target_table": plan.target.name}
    target_path, keys = os.path.join(out, plan.target.name), list(plan.target.primary_key)

    def move_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            held = None
            if keys and store_exists(spark, target_path):
                held = spark.read.parquet(target_path).where((F.col("run_id") != run_id) | (F.col("batch_id") < batch_id))
            routed = move.migrate(batch, plan, parents, held)
            append_rows(routed.accepted, target_path, run_id, batch_id)
            append_rows(routed.rejects.drop("source_table"), os.path.join(out, "_rejects"), run_id, batch_id, **pair)
            counts = move.migration_result(plan, routed).select(
                F.lit("transfer").alias("phase"), F.col("records_attempted").alias("rows"),
                F.col("records_migrated").alias("migrated"), F.col("records_failed").alias("failed"), F.lit(None).cast("string").alias("error"),
            )
        except AnalysisException as exc:
            failed = spark.createDataFrame([("error", 0, 0, 0, str(exc))], "phase string, rows long, migrated long, failed long, error string")
            append_rows(failed, os.path.join(out, "_progress"), run_id, batch_id, **pair)
            raise
        append_rows(stage(counts, "counts"), os.path.join(out, "_progress"), run_id, batch_id, **pair)

    writer = source.writeStream.foreachBatch(move_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


#: What a live run goes through, for each pair of tables; ``error`` ends it instead.
PHASES = ["counting", "transfer", "validation", "finished", "error"]


def _enter(spark: SparkSession, out: str, run_id: str, plan: TablePlan, phase: str, total_rows: int | None = None, issues: int | None = None) -> None:
    row = spark.createDataFrame([(phase, total_rows, issues)], "phase string, total_rows long, issues long")
    append_rows(row, os.path.join(out, "_phases"), run_id, PHASES.index(phase), source_table=plan.source_table, target_table=plan.target.name)


def run_live(
    streams: dict[str, DataFrame],
    tables: dict[str, DataFrame],
    plans: list[TablePlan],
    out: str,
    run_id: str,
    checkpoint: str,
    parents: dict[str, DataFrame] | None = None,
    trigger: dict | None = None,
) -> None:
    """Move several tables live, through all phases, and return when the last one is reached.

    ``streams`` and ``tables`` have each source table as a stream and as a
    batch. Counting takes the totals of the batches; the streams of all pairs
    run beside each other; each pair that arrived is validated against its
    batch (see :func:`quality.run_validation`, on the columns mapped one to
    one), whose rows go to ``_validation``. Every phase that is entered leaves
    a row in ``_phases``, under run and phase, so a run that is started again
    replaces its own. A pair whose stream fails is marked as an error, the
    others go on, and the failure is raised at the end.
    """
    spark = next(iter(tables.values())).sparkSession
    for plan in plans:
        _enter(spark, out, run_id, plan, "counting", tables[plan.source_table].count())
    running = []
    for plan in plans:
        name = f"{plan.source_table}-{plan.target.name}"
        running.append(migrate_stream(streams[plan.source_table], plan, out, run_id, os.path.join(checkpoint, name), parents, trigger))
        _enter(spark, out, run_id, plan, "transfer")
    broken = None
    for plan, stream in zip(plans, running, strict=True):
        try:
            stream.awaitTermination()
        except StreamingQueryException as exc:
            _enter(spark, out, run_id, plan, "error")
            broken = exc
            continue
        _enter(spark, out, run_id, plan, "validation")
        target = spark.read.parquet(os.path.join(out, plan.target.name)).where(F.col("run_id") == run_id)
        pairs = [(m.sources[0], m.targets[0]) for m in plan.mappings if m.kind == "1:1"]
        rows = stage(quality.run_validation(tables[plan.source_table], target, pairs, plan.source_table, plan.target.name), "validation")
        append_rows(rows.drop("source_table", "target_table"), os.path.join(out, "_validation"), run_id, source_table=plan.source_table, target_table=plan.target.name)
        _enter(spark, out, run_id, plan, "finished", issues=quality.validation_issues(rows).first()["issues"])
    if broken is not None:
        raise broken


def progress_totals(progress: DataFrame) -> DataFrame:
    """Running totals, batch by batch: of the table pair, and of all pairs of the run."""
    of_pair = Window.partitionBy("run_id", "source_table", "target_table").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    # a run has few rows: one per pair and batch; they are added up per batch first
    batches = progress.groupBy("run_id", "batch_id").agg(F.sum("migrated").alias("m"), F.sum("failed").alias("f"))
    of_run = Window.partitionBy("run_id").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    overall = batches.select("run_id", "batch_id", F.sum("m").over(of_run).alias("overall_migrated"), F.sum("f").over(of_run).alias("overall_failed"))
    return progress.select(
        "run_id", "source_table", "target_table", "batch_id", "migrated", "failed",
        F.sum("migrated").over(of_pair).alias("table_migrated"), F.sum("failed").over(of_pair).alias("table_failed"),
    ).join(overall, ["run_id", "batch_id"])


def progress_latest(progress: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Latest state per run and table pair.

    ``expected(run_id, source_table, target_table, total_rows)`` gives the
    percentage; without it, the rows seen so far count as the total.
    """
    keys = ["run_id", "source_table", "target_table"]
    state = progress.groupBy(*keys).agg(
        F.max("batch_id").alias("batch_id"), F.sum("rows").alias("rows"), F.sum("migrated").alias("migrated"), F.sum("failed").alias("failed"),
        F.max(F.struct("batch_id", "phase"))["phase"].alias("phase"),
    )
    total = F.col("rows")
    if expected is not None:
        state = state.join(expected, keys, "left")
        total = F.coalesce("total_rows", "rows")
    pct = F.when(total > 0, F.round(F.col("migrated") * 100.0 / total).cast("int")).otherwise(F.lit(0))
    status = F.when((F.col("failed") > 0) | (F.col("phase") == "error"), "error").when(F.col("migrated") + F.col("failed") >= total, "completed").otherwise("migrating")
    return state.select(*keys, "batch_id", "rows", "migrated", "failed", status.alias("status"), pct.alias("progress_percent"))


def progress_status(progress: DataFrame, run_id: str, phases: DataFrame | None = None) -> DataFrame:
    """Totals of one run, table by table; with the phases of :func:`run_live` also the phase, and the counted total behind the percentage."""
    keys = ["run_id", "source_table", "target_table"]
    own = progress.where(F.col("run_id") == run_id)
    if phases is None:
        return progress_latest(own)
    entered = phases.where(F.col("run_id") == run_id).groupBy(*keys).agg(
        F.max(F.struct(F.col("batch_id").alias("at"), "phase"))["phase"].alias("phase"), F.max("total_rows").alias("total_rows"), F.max("issues").alias("issues")
    )
    state = progress_latest(own, entered.select(*keys, "total_rows"))
    none = F.lit(0).cast("long")
    return entered.join(state, keys, "left").select(
        *keys, "phase", "total_rows", F.coalesce("migrated", none).alias("migrated"), F.coalesce("failed", none).alias("failed"), "issues",
        F.coalesce("progress_percent", F.lit(0)).alias("progress_percent"),
    )


def newest_rejects(rejects: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` rejects of a run (a top-k view)."""
    return rejects.orderBy(F.desc("batch_id"), F.desc("record_id")).limit(n)


def ground_stream(
    texts: DataFrame, store: DataFrame, out: str, run_id: str, checkpoint: str, trigger: dict | None = None, index: retrieval.Packed | None = None, **options
) -> StreamingQuery:
    """Check arriving ``texts(doc_id, text)`` against a stored corpus.

    Verdicts and scores of a batch go to ``out`` under run and batch. The
    store's vectors are packed once, before the first batch, into ``_index``
    beside them, unless ``index`` is given; a stream that is started again
    packs the store of its time anew.
    """
    packed = index or retrieval.pack(store, os.path.join(out, "_index", run_id))

    def check(batch: DataFrame, batch_id: int) -> None:
        job = ground(stage(batch, "texts"), store, index=packed, **options)
        verdicts = stage(job.verdicts, "verdicts")
        append_rows(verdicts, os.path.join(out, "verdicts"), run_id, batch_id)
        scores = type(job)(job.docs, job.claims, job.evidence, verdicts).scores()
        append_rows(stage(scores, "scores"), os.path.join(out, "scores"), run_id, batch_id)

    writer = texts.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
