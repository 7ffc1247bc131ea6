"""Streaming queries: each runs its stream to the end and returns what it wrote."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from corroborate.operators import verify
from corroborate.plans.grounding import chunk_store
from corroborate.session import light_batches, stage
from corroborate.specs import Mapping, TablePlan, TableSpec
from corroborate.streaming import live
from queries import inputs as I
from queries import query
from queries.grounding import GROUND, SCORES
from queries.migration import ORDERS_PLAN, _scratch

EVENTS_PLAN = TablePlan(
    "events",
    TableSpec("activity", ("activity_id",), not_null=("kind",), checks={"value_floor": "amount >= 1"}),
    (
        Mapping(("event_id",), ("activity_id",)),
        Mapping(("event_type",), ("kind",), rule="uppercase"),
        Mapping(("value",), ("amount",)),
    ),
    row_id=("event_id",),
)


def _event_stream(spark, sf, files: int = 4):
    """The events as several files, one of them sent twice, arriving one per batch."""
    path = os.path.join(_scratch(spark), "arrivals")
    events = I.table(spark, sf, "events").select("event_id", "event_type", "value")
    events.repartition(files, "event_id").write.parquet(path)
    events.where(F.col("event_type") == "error").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_migrate", "select event_id as activity_id, upper(event_type) as kind, value as amount from events where event_type is not null and value >= 1")
def stream_migrate(spark, sf):
    out = _scratch(spark)
    live.migrate_stream(_event_stream(spark, sf), EVENTS_PLAN, out, "r1", os.path.join(out, "_checkpoint")).awaitTermination()
    return spark.read.parquet(os.path.join(out, "activity")).select("activity_id", "kind", "amount")


def _live(spark, sf) -> str:
    """Events and orders move live side by side; the folder that the run wrote."""
    out = _scratch(spark)
    folders = {"events": os.path.join(out, "in-events"), "orders": os.path.join(out, "in-orders")}
    events = I.table(spark, sf, "events").select("event_id", "event_type", "value")
    orders = I.table(spark, sf, "orders")
    events.repartition(3, "event_id").write.parquet(folders["events"])
    events.where(F.col("event_type") == "error").coalesce(1).write.mode("append").parquet(folders["events"])
    orders.repartition(2, "o_orderkey").write.parquet(folders["orders"])
    schemas = {"events": events.schema, "orders": orders.schema}
    streams = {k: spark.readStream.schema(schemas[k]).option("maxFilesPerTrigger", 1).parquet(v) for k, v in folders.items()}
    tables = {k: spark.read.parquet(v) for k, v in folders.items()}
    # customers of even keys alone are known, so that orders are rejected
    known = {"customer": I.table(spark, sf, "customer").where(F.col("c_custkey") % 2 == 0)}
    live.run_live(streams, tables, [EVENTS_PLAN, ORDERS_PLAN], out, "r1", os.path.join(out, "_checkpoint"), known)
    return out


LIVE = """with ev as (select event_id, event_type, value from events union all select event_id, event_type, value from events where event_type = 'error'),
good_ev as (select * from events where event_type is not null and value >= 1),
good_or as (select * from orders where o_orderstatus is not null and o_custkey in (select c_custkey from customer where c_custkey % 2 = 0)),
val as (select 'events' as source_table, 'activity' as target_table, 'row_count' as "check", 'events -> activity' as item, (select count(*) from ev) as source_value, (select count(*) from good_ev) as target_value
  union all select 'events', 'activity', 'nulls', 'event_id -> activity_id', (select count(*) filter (event_id is null) from ev), 0
  union all select 'events', 'activity', 'nulls', 'event_type -> kind', (select count(*) filter (event_type is null) from ev), 0
  union all select 'events', 'activity', 'nulls', 'value -> amount', (select count(*) filter (value is null) from ev), 0
  union all select 'events', 'activity', 'duplicates', 'activity_id', null, 0
  union all select 'orders', 'sales_orders', 'row_count', 'orders -> sales_orders', (select count(*) from orders), (select count(*) from good_or)
  union all select 'orders', 'sales_orders', 'nulls', 'o_orderkey -> order_id', (select count(*) filter (o_orderkey is null) from orders), (select count(*) filter (o_orderkey is null) from good_or)
  union all select 'orders', 'sales_orders', 'nulls', 'o_custkey -> customer_id', (select count(*) filter (o_custkey is null) from orders), (select count(*) filter (o_custkey is null) from good_or)
  union all select 'orders', 'sales_orders', 'nulls', 'o_orderstatus -> status', (select count(*) filter (o_orderstatus is null) from orders), (select count(*) filter (o_orderstatus is null) from good_or)),
judged as (select *, case when "check" = 'duplicates' then target_value = 0 else source_value = target_value end as matches from val)
"""


@query(
    "live_phases",
    f"""{LIVE}, c as (select 'events' as source_table, 'activity' as target_table, (select count(*) from ev) as total_rows, (select count(*) from good_ev) as migrated
      union all select 'orders', 'sales_orders', (select count(*) from orders), (select count(*) from good_or))
    select 'r1' as run_id, source_table, target_table, 'finished' as phase, total_rows, migrated, total_rows - migrated as failed,
      (select count(*) filter (not matches and "check" in ('row_count', 'duplicates')) from judged j where j.source_table = c.source_table) as issues,
      cast(round(migrated * 100.0 / total_rows) as integer) as progress_percent from c""",
)
def live_phases(spark, sf):
    """The state of a live run of two table pairs, from what it wrote."""
    out = _live(spark, sf)
    read = lambda name: spark.read.parquet(os.path.join(out, name))
    return live.progress_status(read("_progress"), "r1", read("_phases"))


@query("live_validation", f"""{LIVE} select source_table, target_table, "check", item, cast(source_value as bigint) as source_value, cast(target_value as bigint) as target_value, matches from judged""")
def live_validation(spark, sf):
    """What the validation after the transfer found."""
    rows = spark.read.parquet(os.path.join(_live(spark, sf), "_validation"))
    return rows.select("source_table", "target_table", "check", "item", "source_value", "target_value", "matches")


@query("stream_grounding", f"{GROUND}, {SCORES} select doc_id, total, supported, contradicted, unverifiable from scores")
def stream_grounding(spark, sf):
    out = _scratch(spark)
    texts = I.generated(spark, sf)
    arrivals = os.path.join(out, "arrivals")
    texts.repartition(2).write.parquet(arrivals)
    with light_batches(spark):
        store = stage(chunk_store(I.corpus(spark, sf)), "store")
    stream = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
    live.ground_stream(stream, store, out, "r1", os.path.join(out, "_checkpoint")).awaitTermination()
    return spark.read.parquet(os.path.join(out, "scores")).select("doc_id", "total", "supported", "contradicted", "unverifiable")


@query(
    "stored_run",
    f"""{GROUND}, {SCORES}, t as (select doc_id, string_agg(claim_index || ' ' || status || ' ' || claim, chr(10) order by claim_index) as claims from verdicts group by 1)
    select s.doc_id, total, supported, contradicted, unverifiable, claims from scores s left join t using (doc_id)""",
)
def stored_run(spark, sf):
    """Two runs are stored, one is looked up by its id."""
    out = _scratch(spark)
    texts = I.generated(spark, sf)
    with light_batches(spark):
        store = stage(chunk_store(I.corpus(spark, sf)), "store")
    arrivals = os.path.join(out, "arrivals")
    texts.coalesce(1).write.parquet(arrivals)
    for run in ("r1", "r2"):
        asked = spark.readStream.schema(texts.schema).parquet(arrivals)
        live.ground_stream(asked if run == "r1" else asked.where("doc_id < 0"), store, out, run, os.path.join(out, f"_checkpoint-{run}")).awaitTermination()
    found = verify.stored_run(spark.read.parquet(os.path.join(out, "verdicts")), spark.read.parquet(os.path.join(out, "scores")), "r1")
    told = F.transform("claims", lambda c: F.concat_ws(" ", c["claim_index"], c["status"], c["claim"]))
    return found.select("doc_id", "total", "supported", "contradicted", "unverifiable", F.array_join(told, "\n").alias("claims"))


# A progress log as a live run leaves it: one row per user (the table pair) and hour (the batch).
LOG = """
select 'r' || cast(user_id % 3 as varchar(3)) as run_id, 'source_' || cast(user_id as varchar(9)) as source_table, 'target_' || cast(user_id % 2 as varchar(3)) as target_table,
       cast(floor(event_id / 1000) as bigint) as batch_id, 'transfer' as phase, count(*) as rows, sum(case when event_type <> 'error' then 1 else 0 end) as migrated,
       sum(case when event_type = 'error' then 1 else 0 end) as failed
from {events} group by user_id, cast(floor(event_id / 1000) as bigint)
"""


def log(spark, sf):
    return I.derived(spark, sf, LOG)


LOGGED = I.sql(LOG)


@query("progress_totals", f"""select run_id, source_table, target_table, batch_id, cast(migrated as bigint) as migrated, cast(failed as bigint) as failed,
    cast(sum(migrated) over w as bigint) as table_migrated, cast(sum(failed) over w as bigint) as table_failed,
    cast(sum(migrated) over o as bigint) as overall_migrated, cast(sum(failed) over o as bigint) as overall_failed from ({LOGGED})
    window w as (partition by run_id, source_table, target_table order by batch_id), o as (partition by run_id order by batch_id)""")
def progress_totals(spark, sf):
    return live.progress_totals(log(spark, sf))


LATEST = f"""select run_id, source_table, target_table, max(batch_id) as batch_id, cast(sum(rows) as bigint) as rows, cast(sum(migrated) as bigint) as migrated, cast(sum(failed) as bigint) as failed,
    case when sum(failed) > 0 then 'error' else 'completed' end as status, cast(round(sum(migrated) * 100.0 / sum(rows)) as integer) as progress_percent from ({LOGGED}) group by 1, 2, 3"""


@query("progress_latest", LATEST)
def progress_latest(spark, sf):
    return live.progress_latest(log(spark, sf))


@query("progress_status", f"select * from ({LATEST}) where run_id = 'r1'")
def progress_status(spark, sf):
    return live.progress_status(log(spark, sf), "r1")


@query(
    "newest_rejects",
    "select 'r1' as run_id, cast(floor(event_id / 1000) as bigint) as batch_id, event_id as record_id from events where event_type = 'error' order by batch_id desc, record_id desc limit 50",
)
def newest_rejects(spark, sf):
    errors = I.table(spark, sf, "events").where(F.col("event_type") == "error")
    rejects = errors.select(F.lit("r1").alias("run_id"), F.floor(F.col("event_id") / 1000).cast("long").alias("batch_id"), F.col("event_id").alias("record_id"))
    return live.newest_rejects(rejects)
