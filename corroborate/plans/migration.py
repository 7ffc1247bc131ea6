"""Run all table pairs of a migration."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from corroborate.operators import move
from corroborate.sources.tables import append_rows
from corroborate.specs import TablePlan


def migrate_all(sources: dict[str, DataFrame], plans: list[TablePlan], parents: dict[str, DataFrame] | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Results of every table pair, without writing: rows are counted, not routed. The loop is over tables, not rows."""
    results = []
    for plan in plans:
        results.append(move.migration_counts(sources[plan.source_table], plan, parents, (targets or {}).get(plan.target.name)))
    return move.merge_results(results)


def migrate_table(source: DataFrame, plan: TablePlan, out: str, run_id: str, parents: dict[str, DataFrame] | None = None, target: DataFrame | None = None) -> DataFrame:
    """Move one table: append accepted rows and rejects under ``out``, return the result row.

    Ids and reasons of rejected rows are staged, whole rows are not: the source
    is read once for each of the two. A rerun of the same run replaces what it
    wrote. ``target`` must not hold rows of the same run.
    """
    routed = move.migrate(source, plan, parents, target)
    append_rows(routed.accepted, os.path.join(out, plan.target.name), run_id)
    rejects = routed.rejects.drop("source_table")
    append_rows(rejects, os.path.join(out, "_rejects"), run_id, source_table=plan.source_table, target_table=plan.target.name)
    return move.migration_result(plan, routed)
