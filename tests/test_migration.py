"""Row movement, checks and streams."""

import os
import re
import shutil

import pytest
from pyspark.sql import functions as F

from corroborate.functions import rules as R
from corroborate.functions import types as TY
from corroborate.operators import move, profile, quality
from corroborate.plans import migration as P
from corroborate.sources import tables as TB
from corroborate.specs import ForeignKey, Mapping, TablePlan, TableSpec
from corroborate.streaming import live

ROWS = [
    (1, 10, "Ann Lee", "7"), (2, 10, "Bob Roe", "8"), (3, 20, None, "9"), (4, 30, "Cy  Poe", "x"), (5, 20, "Dee", "12.5"), (6, None, "Eve Moe", " 5 "), (7, 99, "Flo", None),
]
PLAN = TablePlan(
    "old",
    TableSpec("new", ("key",), (ForeignKey("key", "parent", "id"),), ("name",)),
    (
        Mapping(("k",), ("key",)),
        Mapping(("n",), ("name",)),
        Mapping(("n",), ("first", "last"), kind="1:N"),
        Mapping(("n", "v"), ("both",), kind="N:1", template="{1}:{0}"),
        Mapping(("v",), ("value",), rule="cast_int"),
    ),
    ("id",),
)


@pytest.fixture
def source(spark):
    return spark.createDataFrame(ROWS, "id long, k long, n string, v string")


@pytest.fixture
def parent(spark):
    return {"parent": spark.createDataFrame([(10,), (20,), (30,)], "id long")}


def test_routing(spark, source, parent):
    routed = move.migrate(source, PLAN, parent)
    accepted = {r.key: r for r in routed.accepted.collect()}
    # row 5 takes key 20, because row 3 is rejected for its name
    assert sorted(accepted) == [10, 20, 30] and accepted[10].name == "Ann Lee" and accepted[20].name == "Dee"
    assert (accepted[10].first, accepted[10].last, accepted[10].both, accepted[10].value) == ("Ann", "Lee", "7:Ann Lee", 7)
    assert accepted[30].last == "" and accepted[30].value is None
    rejects = {int(r.record_id): r.error_type for r in routed.rejects.collect()}
    assert rejects == {2: "UNIQUE", 3: "NOT NULL", 6: "NOT NULL", 7: "FOREIGN KEY"}
    result = move.migration_result(PLAN, routed).first()
    assert (result.records_attempted, result.records_migrated, result.records_failed, result.status) == (7, 3, 4, "partial")


def test_keys_in_target_are_rejected(spark, source, parent):
    target = spark.createDataFrame([(30,)], "key long")
    routed = move.migrate(source, PLAN, parent, target)
    assert {r.key for r in routed.accepted.collect()} == {10, 20}
    assert routed.rejects.where("error_type = 'UNIQUE'").count() == 2


def test_accepted_and_rejected_are_all(spark):
    """A key with a third of all rows: nothing is lost, one row wins."""
    rows = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 10).otherwise(F.col("id") + 1000).alias("k"), F.lit("n m").alias("n"), F.lit("1").alias("v"))
    plan = TablePlan("old", TableSpec("new", ("key",), (), ("name",)), PLAN.mappings, ("id",))
    routed = move.migrate(rows, plan)
    assert routed.accepted.count() == 6001 and routed.rejects.count() == 2999
    assert routed.accepted.where("key = 10").count() == 1


def exchanged(df):
    """Columns of every shuffle of the plan that runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if re.search(r"\bExchange ", line)]


def test_no_shuffle_carries_whole_rows(spark, source, parent):
    target = spark.createDataFrame([(30,)], "key long")
    routed = move.migrate(source, PLAN, parent, target)
    assert set(routed.verdicts.columns) == {"_id", "_reason"}
    for df in (routed.accepted, routed.rejects):
        df.collect()
        assert not exchanged(df), exchanged(df)


def test_many_verdicts_are_joined_without_broadcast(spark, source, parent, monkeypatch):
    monkeypatch.setattr(move, "small", lambda df, **_: df)
    routed = move.migrate(source, PLAN, parent)
    assert sorted(r.key for r in routed.accepted.collect()) == [10, 20, 30]
    assert {int(r.record_id) for r in routed.rejects.collect()} == {2, 3, 6, 7}


def test_counts_are_those_of_routing_without_routing(spark, source, parent, monkeypatch):
    target = spark.createDataFrame([(30,), (30,), (77,)], "key long")
    hot = spark.range(900).select(F.col("id"), F.when(F.col("id") % 3 == 0, 10).otherwise(F.col("id") % 50).alias("k"), F.when(F.col("id") % 7 > 0, "n").alias("n"), F.lit("1").alias("v"))
    free = TablePlan("old", TableSpec("free", (), (), ("name",)), PLAN.mappings, ("id",))
    cases = [(rows, plan, held) for rows in (source, hot, source.limit(0)) for plan in (PLAN, free) for held in (None, target)]
    want = [move.migration_result(plan, move.migrate(rows, plan, parent, held)).collect() for rows, plan, held in cases]
    monkeypatch.setattr(move, "route_rows", None)
    got = [P.migrate_all({"old": rows}, [plan], parent, {plan.target.name: held}).collect() for rows, plan, held in cases]
    assert got == want


def test_rows_are_not_shuffled_to_missing_parents(spark, source, parent):
    rows = move._judged(move.project(source, PLAN.mappings, ("id",)), PLAN.target, F.col("id"), F.lit(None))
    told = move._against_others(rows, PLAN.target, parent, spark.createDataFrame([(30,)], "key long"))
    assert {r["_id"]: r["_reason"]["type"] for r in told.where("_reason is not null").collect()} == {4: "UNIQUE", 7: "FOREIGN KEY"}
    assert not [line for line in exchanged(told) if "_id" in line]


def test_report_status(spark):
    schema = "source_table string, records_attempted long, records_migrated long, records_failed long, status string"
    good = spark.createDataFrame([("a", 5, 5, 0, "completed")], schema)
    broken = spark.createDataFrame([("a", 5, 5, 0, "completed"), ("b", 0, 0, 0, "failed")], schema)
    assert move.migration_report(good).first().status == "SUCCESS"
    assert move.migration_report(broken).first().status == "PARTIAL"
    assert move.migration_report(good.limit(0)).first().overall_success_rate == "N/A"


def test_rules(spark):
    df = spark.createDataFrame([(" 12 ",), ("12.7",), ("1f",), ("1e3",), (None,)], "v string")
    got = df.select(TY.parse_int(F.col("v")).alias("i"), TY.parse_double(F.col("v")).alias("d"), R.apply_rule(F.col("v"), "trim").alias("t")).collect()
    assert [r.i for r in got] == [12, None, None, None, None]
    assert [r.d for r in got] == [12.0, 12.7, None, 1000.0, None]
    assert got[0].t == "12"
    numbers = spark.createDataFrame([(12.7,), (-3.9,)], "v double")
    assert [r.x for r in numbers.select(R.apply_rule(F.col("v"), "cast_int", dtype=numbers.schema["v"].dataType).alias("x")).collect()] == [12, -3]


def test_write_rerun_and_rollback(spark, source, parent, tmp_path):
    out = str(tmp_path)
    for run in ("r1", "r1", "r2"):
        P.migrate_table(source, PLAN, out, run, parent)
    path = os.path.join(out, "new")
    assert {r.run_id: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {"r1": 3, "r2": 3}
    TB.rollback(spark, path, "r2")
    left = spark.read.parquet(path)
    assert left.count() == 3 and left.where("run_id = 'r2'").count() == 0
    P.migrate_table(source, PLAN, out, "r2", parent)
    TB.rollback_run(spark, out, "r1")
    for folder in (path, os.path.join(out, "_rejects")):
        assert {r.run_id for r in spark.read.parquet(folder).select("run_id").distinct().collect()} == {"r2"}
    TB.rollback(spark, path)
    assert not [d for d in os.listdir(path) if d.startswith("run_id=")]


def test_rerun_without_rejects_leaves_none(spark, tmp_path):
    out, plan = str(tmp_path), TablePlan("old", TableSpec("new", ("key",), (), ("name",)), PLAN.mappings, ("id",))
    bad = spark.createDataFrame([(1, 1, None, "1"), (2, 2, "n m", "2")], "id long, k long, n string, v string")
    P.migrate_table(bad, plan, out, "r1")
    rejects = spark.read.parquet(os.path.join(out, "_rejects"))
    assert [r.record_data for r in rejects.collect()] == ['{"id":1,"k":1,"n":null,"v":"1"}']
    schema = rejects.schema
    P.migrate_table(bad.fillna("n m", ["n"]), plan, out, "r1")
    assert spark.read.schema(schema).parquet(os.path.join(out, "_rejects")).count() == 0
    assert spark.read.parquet(os.path.join(out, "new")).count() == 2


def test_a_failed_batch_is_delivered_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "n m", "1"), (2, 2, "n m", "2")], "id long, k long, n string, v string")
    arrivals, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.coalesce(1).write.parquet(arrivals)

    def run(**checks):
        plan = TablePlan("old", TableSpec("new", ("key",), (), ("name",), **checks), PLAN.mappings, ("id",))
        live.migrate_stream(stream_of(spark, arrivals, rows.schema), plan, out, "r1", str(tmp_path / "ckpt")).awaitTermination()

    with pytest.raises(Exception):
        run(checks={"wrong": "no_such_column > 1"})
    assert [r.phase for r in spark.read.parquet(os.path.join(out, "_progress")).collect()] == ["error"]
    run()
    assert spark.read.parquet(os.path.join(out, "new")).count() == 2
    assert [(r.phase, r.migrated) for r in spark.read.parquet(os.path.join(out, "_progress")).collect()] == [("transfer", 2)]


def test_candidates(spark):
    df = spark.createDataFrame([("a b",), ("c d",), ("e",)], "x string")
    row = profile.split_candidates(df, ["x"]).first()
    assert (row.recommended_delimiter, row.average_parts, row.sample) == (" ", 1.7, ["a", "b"])
    cat = spark.createDataFrame([("t", "First_Name", 0), ("t", "lastname", 1), ("t", "fname", 2), ("t", "lname", 3)], "table_name string, column_name string, position int")
    merge = profile.merge_candidates(cat).first()
    assert merge.suggested_target == "full_name" and merge.source_columns == ["First_Name", "lastname"]


def test_checks_on_empty_and_keyless_tables(spark):
    df = spark.createDataFrame([], "a int, b string")
    got = {r.check_name: r.status for r in quality.pre_migration_suite(df, TableSpec("t"), {}).collect()}
    assert got == {
        "Row Count Check": "warning", "Null Value Check": "passed", "Duplicate Check": "skipped", "Data Type Check": "passed", "Referential Integrity Check": "skipped",
    }


def test_overall_status(spark):
    def overall(*rows):
        checks = spark.createDataFrame(rows, "status string, severity string")
        return quality.overall_status(quality.summarize(checks)).first().overall_status

    assert overall(("failed", "critical"), ("passed", "low")) == "BLOCKED"
    assert overall(("failed", "high"),) == "REVIEW_REQUIRED"
    assert overall(("warning", "medium"), ("skipped", "low")) == "PASSED_WITH_WARNINGS"
    assert overall(("passed", "low"),) == "PASSED"


def test_count_comparison_severity(spark):
    def severity(n):
        return quality.compare_counts(spark.range(1000), spark.range(n), "s", "t").first().severity

    assert (severity(1000), severity(995), severity(900)) == ("low", "high", "critical")
    assert quality.compare_counts(spark.range(0), spark.range(5), "s", "t").first().severity == "critical"


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_equals_batch_also_after_replay(spark, tmp_path):
    rows = spark.range(300).select("id", (F.col("id") % 200).alias("k"), F.lit("n m").alias("n"), F.lit("1").alias("v"))
    plan = TablePlan("old", TableSpec("new", ("key",), (), ("name",)), PLAN.mappings, ("id",))
    arrivals, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.repartition(3).write.parquet(arrivals)

    def run(checkpoint):
        live.migrate_stream(stream_of(spark, arrivals, rows.schema), plan, out, "r1", str(checkpoint)).awaitTermination()

    run(tmp_path / "ckpt")
    batch = {r.key for r in move.migrate(rows, plan).accepted.collect()}

    def state():
        done = spark.read.parquet(os.path.join(out, "new"))
        progress = spark.read.parquet(os.path.join(out, "_progress"))
        return sorted(r.key for r in done.collect()), progress

    keys, progress = state()
    assert keys == sorted(batch) and progress.count() == 3
    latest = live.progress_latest(progress).first()
    assert (latest.rows, latest.migrated, latest.failed, latest.status) == (300, 200, 100, "error")
    assert spark.read.parquet(os.path.join(out, "_rejects")).count() == 100
    # the last batch is replayed: a checkpoint without its commit, while its output is there
    last = max(int(c.name) for c in (tmp_path / "ckpt" / "commits").glob("[0-9]*"))

    def without_last_commit(folder, names):
        return [n for n in names if os.path.basename(folder) == "commits" and n in (str(last), f".{last}.crc")]

    shutil.copytree(tmp_path / "ckpt", tmp_path / "again", ignore=without_last_commit)
    run(tmp_path / "again")
    again, progress = state()
    assert again == keys and progress.count() == 3


def test_live_run_goes_through_all_phases(spark, tmp_path):
    schema = "id long, k long, n string, v string"
    rows = {"old": spark.createDataFrame([(1, 1, "n m", "1"), (2, 1, "n m", "2"), (3, 3, None, "3")], schema), "bad": spark.createDataFrame([(1, 1, "n m", "1")], schema)}
    out, arrivals = str(tmp_path / "out"), {k: str(tmp_path / f"in-{k}") for k in rows}
    for k, df in rows.items():
        df.coalesce(1).write.parquet(arrivals[k])
    plans = [TablePlan("old", TableSpec("new", ("key",), (), ("name",)), PLAN.mappings, ("id",)), TablePlan("bad", TableSpec("worse", ("key",), checks={"wrong": "no_such_column > 1"}), PLAN.mappings, ("id",))]

    def run(some, run_id):
        streams = {k: stream_of(spark, arrivals[k], rows[k].schema) for k in rows}
        live.run_live(streams, rows, some, out, run_id, str(tmp_path / f"ckpt-{run_id}"))

    def status(run_id):
        read = lambda name: spark.read.parquet(os.path.join(out, name))
        return {r.source_table: (r.phase, r.total_rows, r.migrated, r.failed, r.issues, r.progress_percent) for r in live.progress_status(read("_progress"), run_id, read("_phases")).collect()}

    run(plans[:1], "r1")
    assert status("r1") == {"old": ("finished", 3, 1, 2, 1, 33)}
    entered = spark.read.parquet(os.path.join(out, "_phases")).orderBy("batch_id")
    assert [r.phase for r in entered.collect()] == ["counting", "transfer", "validation", "finished"]
    with pytest.raises(Exception):
        run(plans[::-1], "r2")
    assert {k: v[0] for k, v in status("r2").items()} == {"old": "finished", "bad": "error"}


def test_keys_are_counted_in_partitions_of_bounded_size(spark):
    df = spark.range(0, 1000, 1, 4).selectExpr("id div 2 as k", "if(id < 700, null, id) as j")
    counted = quality._counted(df, ["k", "j"], rows=100)
    assert counted.rdd.getNumPartitions() == 10
    assert counted.agg(F.sum("copies"), F.count("*"), F.max("copies")).first()[:] == (1000, 650, 2)
    small = quality._counted(spark.range(3), ["id"])
    assert small.rdd.getNumPartitions() == 2 and small.count() == 3
    plan = quality.duplicate_check(df, TableSpec("t", ("k",)))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_foreign_keys_are_counted_each_by_itself(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", None), (2, "z", 9), (None, None, 1)], "i int, t string, j long")
    spec = TableSpec("t", (), (ForeignKey("i", "p", "id"), ForeignKey("t", "q", "name"), ForeignKey("j", "p", "id")))
    have = {"p": spark.createDataFrame([(1,), (1,)], "id long"), "q": spark.createDataFrame([("a",), ("b",), (None,)], "name string")}
    check = quality.foreign_key_check(df, spec, have)
    assert check.first().details["violations"] == "i → p.id=2, t → q.name=1, j → p.id=1"
    plan = check._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "cast(id" not in plan


def test_report_puts_each_header_first_and_keeps_explanations_whole(spark, tmp_path):
    rows = [("mapping", -5, "a", "s", ["1", "2"]), ("mapping", 7, "b", "s", ["3"]), ("validation", -9, "c", "s", ["4"])]
    told = spark.createDataFrame(rows, "kind string, position long, title string, summary string, details array<string>")

    def lines(path):
        return [line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines() if line]

    want = ["## Column Mappings", "### a", "**s**", "- 1", "- 2", "### b", "**s**", "- 3", "## Validation Results", "### c", "**s**", "- 4"]
    TB.write_report(told, str(tmp_path / "one"))
    assert lines(tmp_path / "one") == want
    sections = [told.where(F.col("kind") == kind).repartition(4, "title").orderBy("position") for kind in ("mapping", "validation")]
    TB.write_report(sections, str(tmp_path / "list"))
    assert lines(tmp_path / "list") == want
    TB.write_report([s.limit(0) for s in sections], str(tmp_path / "none"))
    assert lines(tmp_path / "none") == []


def test_report_can_be_compressed_and_look_for_headers_elsewhere(spark, tmp_path):
    told = spark.createDataFrame([("mapping", k, f"t{k}", "s", ["d"] * 3) for k in range(50)], "kind string, position long, title string, summary string, details array<string>")
    TB.write_report(told, str(tmp_path / "plain"))
    TB.write_report([told.coalesce(1)], str(tmp_path / "made"), made_of=[spark.createDataFrame([("mapping",)], "kind string")], compression="gzip")
    TB.write_report([told.limit(0)], str(tmp_path / "none"), made_of=[told.limit(0)], compression="gzip")
    lines = lambda name: sorted(r.value for r in spark.read.text(str(tmp_path / name)).collect())
    assert lines("made") == lines("plain") and lines("none") == []
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / name).glob("part-*"))
    assert size("made") * 4 < size("plain")


@pytest.fixture
def met_tables(spark, tmp_path):
    """Parts and suppliers that give columns of equal names, types or both, and lines that meet them, some twice, some without a partner."""
    spark.createDataFrame([(k, f"name {k % 5}", ["STEEL", "TIN"][k % 2], k % 4) for k in range(60)], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, k % 3) for k in range(40)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    lines = [(k % 60, k * 7 % 40) for k in range(900)] * 2 + [(None, 1), (1, None), (999, 1)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_judged_pairs_are_ordered_as_numbers(spark, met_tables, most):
    from queries.reports import judged, judged_in_order

    read = ["source_column", "target_column", "source_type", "target_type", "semantic", "syntactic", "type_score", "overall"]
    rows, pairs = judged_in_order(spark, met_tables, 20, most)
    want = judged(spark, met_tables)
    got = rows.select("h", *read).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(tuple(r) for r in want.select(*read).collect()) and len(got) == pairs.count() > 100
    order = [r.h for r in want.select(F.xxhash64("source_table", "source_column", "target_table", "target_column").alias("h")).collect()]
    assert [r.h for r in got] == sorted(order)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    dealt = plan[plan.index("Exchange rangepartitioning(h") :]
    assert ("Join" in dealt[: dealt.index("FileScan")]) == (most == 0)


def test_shuffles_of_staged_queries_are_deleted(spark, tmp_path):
    from corroborate.session import fleeting_shuffles

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(KeyError), fleeting_shuffles(spark):
        assert spark.conf.get(key) == "true"
        spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(str(tmp_path / "out"))
        raise KeyError
    assert spark.conf.get(key) == before and spark.read.parquet(str(tmp_path / "out")).count() == 7
