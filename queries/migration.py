"""Row-movement queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

import pandas as pd

from corroborate.functions import lexicon as L
from corroborate.functions import rules as R
from corroborate.functions import types as TY
from corroborate.operators import move, retrieval, verify
from corroborate.plans import migration as P
from corroborate.session import checkpoint_dir
from corroborate.sources import tables as TB
from corroborate.specs import ForeignKey, Mapping, TablePlan, TableSpec
from queries import inputs as I
from queries import query

CUST = I.sql(I.CUST)
HELD = I.sql(I.HELD)

CUSTOMERS = TableSpec(
    "customers",
    primary_key=("customer_id",),
    foreign_keys=(ForeignKey("nation_id", "nation", "n_nationkey"),),
    not_null=("full_name",),
    checks={"balance_floor": "balance is null or balance > -900"},
)
CUSTOMER_PLAN = TablePlan(
    "cust",
    CUSTOMERS,
    (
        Mapping(("cust_id",), ("customer_id",)),
        Mapping(("cust_name",), ("full_name",), rule="uppercase"),
        Mapping(("nation",), ("nation_id",)),
        Mapping(("bal_text",), ("balance",), rule="cast_int"),
        Mapping(("segment",), ("segment",), rule="trim"),
        Mapping(("tier",), ("tier",), rule="null_to_default", default="STANDARD"),
        Mapping(("cust_name",), ("kind", "number"), kind="1:N", delimiter="#"),
        Mapping(("segment", "bal_text"), ("label",), kind="N:1", template="{0}: {1}"),
    ),
    row_id=("row_no",),
)
ORDERS_PLAN = TablePlan(
    "orders",
    TableSpec("sales_orders", ("order_id",), (ForeignKey("customer_id", "customer", "c_custkey"),), ("status",)),
    (
        Mapping(("o_orderkey",), ("order_id",)),
        Mapping(("o_custkey",), ("customer_id",)),
        Mapping(("o_orderstatus",), ("status",), rule="lowercase"),
        Mapping(("o_orderpriority",), ("priority_rank", "priority"), kind="1:N", delimiter="-"),
    ),
    row_id=("o_orderkey",),
)
LINES_PLAN = TablePlan(
    "lineitem",
    TableSpec("order_lines", ("order_id", "line_number"), (ForeignKey("order_id", "orders", "o_orderkey"),)),
    (
        Mapping(("l_orderkey",), ("order_id",)),
        Mapping(("l_linenumber",), ("line_number",)),
        Mapping(("l_partkey",), ("part_id",)),
        Mapping(("l_quantity",), ("quantity",), rule="cast_int"),
    ),
    row_id=("l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax"),
)


def parents(spark, sf):
    return {n: I.table(spark, sf, n) for n in ("nation", "customer", "orders")}


def held(spark, sf):
    return I.derived(spark, sf, I.HELD)


def routed(spark, sf):
    return move.migrate(I.cust(spark, sf), CUSTOMER_PLAN, parents(spark, sf), held(spark, sf))


PROJECTED = rf"""
projected as (select row_no, cust_id as customer_id, upper(cust_name) as full_name, nation as nation_id,
  case when regexp_matches(bal_text, '^\s*[+-]?[0-9]+\s*$') then cast(trim(bal_text) as bigint) end as balance,
  trim(segment) as segment, coalesce(tier, 'STANDARD') as tier,
  list_extract(string_split(cust_name, '#'), 1) as kind, list_extract(string_split(cust_name, '#'), 2) as number,
  segment || ': ' || bal_text as label from ({CUST}))
"""
ROUTED = f"""with {PROJECTED},
flagged as (select *, case when customer_id is null then 'NOT NULL constraint failed: customers.customer_id'
   when full_name is null then 'NOT NULL constraint failed: customers.full_name'
   when not (balance is null or balance > -900) then 'CHECK constraint failed: balance_floor'
   when nation_id is not null and nation_id not in (select n_nationkey from nation) then 'FOREIGN KEY constraint failed: customers.nation_id'
   when customer_id in ({HELD}) then 'UNIQUE constraint failed: customers.customer_id' end as m from projected),
routed as (select * exclude (m), coalesce(m, case when row_number() over (partition by customer_id, m is null order by row_no) > 1 then 'UNIQUE constraint failed: customers.customer_id' end) as message
  from flagged)
"""
RECORD = "cast(json_object('bal_text', c.bal_text, 'cust_id', c.cust_id, 'cust_name', c.cust_name, 'nation', c.nation, 'row_no', c.row_no, 'segment', c.segment, 'tier', c.tier) as varchar)"
ACCEPTED = "select customer_id, full_name, nation_id, balance, segment, tier, kind, number, label from routed where message is null"
REJECTED = f"select 'cust' as source_table, cast(r.row_no as varchar) as record_id, message as error_message, split_part(message, ' constraint', 1) as error_type, {RECORD} as record_data from routed r join ({CUST}) c on c.row_no = r.row_no where message is not null"


# --- rules ----------------------------------------------------------------------


@query(
    "rule_casts",
    rf"""select row_no, case when regexp_matches(bal_text, '^\s*[+-]?[0-9]+\s*$') then cast(trim(bal_text) as bigint) end as as_int,
    case when regexp_matches(bal_text, '^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$') then cast(trim(bal_text) as double) end as as_float,
    cast(trunc(c_acctbal) as bigint) as cut from ({CUST}) join customer on c_custkey = row_no""",
)
def rule_casts(spark, sf):
    rows = I.cust(spark, sf).join(I.table(spark, sf, "customer").select(F.col("c_custkey").alias("row_no"), "c_acctbal"), "row_no")
    text = F.col("bal_text")
    return rows.select(
        "row_no", R.apply_rule(text, "cast_int").alias("as_int"), R.apply_rule(text, "cast_float").alias("as_float"),
        R.apply_rule(F.col("c_acctbal"), "cast_int", dtype=T.DoubleType()).alias("cut"),
    )


@query("rule_strings", f"select row_no, cast(cust_id as varchar) as as_text, upper(cust_name) as up, lower(cust_name) as low, trim(segment) as trimmed from ({CUST})")
def rule_strings(spark, sf):
    return I.cust(spark, sf).select(
        "row_no", R.apply_rule(F.col("cust_id"), "cast_str").alias("as_text"), R.apply_rule(F.col("cust_name"), "uppercase").alias("up"),
        R.apply_rule(F.col("cust_name"), "lowercase").alias("low"), R.apply_rule(F.col("segment"), "trim").alias("trimmed"),
    )


@query("rule_default", f"select row_no, coalesce(tier, 'STANDARD') as tier, cust_name as unknown_rule from ({CUST})")
def rule_default(spark, sf):
    return I.cust(spark, sf).select(
        "row_no", R.apply_rule(F.col("tier"), "null_to_default", "STANDARD").alias("tier"), R.apply_rule(F.col("cust_name"), "no such rule").alias("unknown_rule")
    )


@query("split_column", f"select row_no, list_extract(string_split(cust_name, '#'), 1) as kind, list_extract(string_split(cust_name, '#'), 2) as number, list_extract(string_split(cust_name, '#'), 3) as rest from ({CUST})")
def split_column(spark, sf):
    kind, number, rest = R.split_value(F.col("cust_name"), "#", 3)
    return I.cust(spark, sf).select("row_no", kind.alias("kind"), number.alias("number"), rest.alias("rest"))


@query("merge_columns", f"select row_no, coalesce(cust_name, '') || ' <' || coalesce(tier, '') || '>' as templated, coalesce(cust_name, '') || ' ' || coalesce(tier, '') as joined from ({CUST})")
def merge_columns(spark, sf):
    both = [F.col("cust_name"), F.col("tier")]
    return I.cust(spark, sf).select("row_no", R.merge_values(both, "{0} <{1}>").alias("templated"), R.merge_values(both).alias("joined"))


@query(
    "convert_columns",
    rf"""select o_orderkey, cast(o_custkey as varchar) as int_to_text, cast(o_orderdate as date) as day, o_custkey <> 0 as flag,
    case when o_orderstatus = 'F' then 1 else 0 end as bool_to_int, try_cast(split_part(o_orderpriority, '-', 1) as bigint) as text_to_int,
    cast(o_orderdate as date)::varchar as day_text, o_totalprice as plain from orders""",
)
def convert_columns(spark, sf):
    o = I.table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(
        "o_orderkey",
        TY.convert(F.col("o_custkey"), "INTEGER", "VARCHAR(20)").alias("int_to_text"),
        TY.convert(F.col("o_orderdate"), "DATETIME", "DATE").alias("day"),
        TY.convert(F.col("o_custkey"), "INT", "BOOLEAN").alias("flag"),
        TY.convert(F.col("o_orderstatus") == "F", "BOOL", "INTEGER").alias("bool_to_int"),
        TY.convert(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)), "VARCHAR(5)", "INTEGER").alias("text_to_int"),
        TY.convert(day, "DATE", "VARCHAR(10)").alias("day_text"),
        TY.convert(F.col("o_totalprice"), "FLOAT", "DECIMAL(10,2)").alias("plain"),
    )


@query("apply_mapping", f"with {PROJECTED} select * from projected")
def apply_mapping(spark, sf):
    return move.project(I.cust(spark, sf), CUSTOMER_PLAN.mappings, ("row_no",))


# --- movement -------------------------------------------------------------------


@query("migrate_table", f"{ROUTED} {ACCEPTED}")
def migrate_table(spark, sf):
    return routed(spark, sf).accepted


@query("reject_rows", f"{ROUTED} {REJECTED}")
def reject_rows(spark, sf):
    return routed(spark, sf).rejects


LINE_ROUTED = """lines as (select *, case when l_orderkey not in (select o_orderkey from orders) then 'FOREIGN KEY' else
   case when row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) > 1 then 'UNIQUE' end end as err from lineitem)"""


@query(
    "reject_duplicate_lines",
    f"with {LINE_ROUTED} select l_orderkey as order_id, l_linenumber as line_number, l_partkey as part_id, cast(trunc(l_quantity) as bigint) as quantity from lines where err is null",
)
def reject_duplicate_lines(spark, sf):
    """Natural duplicates: many lines share order and line number."""
    return move.migrate(I.table(spark, sf, "lineitem"), LINES_PLAN, parents(spark, sf)).accepted


RESULTS = f"""
{ROUTED}, {LINE_ROUTED},
counted as (
  select 'cust' as source_table, 'customers' as target_table, count(*) as records_attempted, count(*) filter (message is null) as records_migrated, count(*) filter (message is not null) as records_failed from routed
  union all select 'orders', 'sales_orders', count(*), count(*) filter (o_custkey in (select c_custkey from customer)), count(*) filter (o_custkey not in (select c_custkey from customer)) from orders
  union all select 'lineitem', 'order_lines', count(*), count(*) filter (err is null), count(*) filter (err is not null) from lines),
results as (select *, case when records_failed = 0 then 'completed' when records_migrated = 0 then 'failed' else 'partial' end as status,
   printf('%.1f%%', records_migrated * 100.0 / records_attempted) as success_rate from counted)
"""


def results(spark, sf):
    sources = {"cust": I.cust(spark, sf), "orders": I.table(spark, sf, "orders"), "lineitem": I.table(spark, sf, "lineitem")}
    return P.migrate_all(sources, [CUSTOMER_PLAN, ORDERS_PLAN, LINES_PLAN], parents(spark, sf), {"customers": held(spark, sf)})


@query("migrate_all", f"{RESULTS} select source_table, target_table, records_attempted, records_migrated, records_failed from results")
def migrate_all(spark, sf):
    return results(spark, sf).select("source_table", "target_table", "records_attempted", "records_migrated", "records_failed")


APPLIED = (
    "cust_id → customer_id: direct; cust_name → full_name: uppercase; nation → nation_id: direct; bal_text → balance: cast_int; segment → segment: trim; "
    "tier → tier: null_to_default; cust_name → kind+number: split; segment+bal_text → label: merge"
)


@query("migration_result", f"{RESULTS} select *, '{APPLIED}' as transformations_applied from results where source_table = 'cust'")
def migration_result(spark, sf):
    result = move.migration_result(CUSTOMER_PLAN, routed(spark, sf))
    return result.withColumn("transformations_applied", F.array_join("transformations_applied", "; "))


@query(
    "migration_report",
    f"""{RESULTS} select count(*) as total_tables, cast(sum(records_attempted) as bigint) as total_records_attempted, cast(sum(records_migrated) as bigint) as total_records_migrated,
    cast(sum(records_failed) as bigint) as total_records_failed, printf('%.1f%%', sum(records_migrated) * 100.0 / sum(records_attempted)) as overall_success_rate,
    case when sum(records_failed) = 0 then 'SUCCESS' when sum(records_migrated) > 0 then 'PARTIAL' else 'FAILED' end as status from results""",
)
def migration_report(spark, sf):
    return move.migration_report(results(spark, sf))


@query("dry_run", f"{RESULTS} select *, true as dry_run from results where source_table = 'cust'")
def dry_run(spark, sf):
    return move.dry_run(CUSTOMER_PLAN, routed(spark, sf))


def _scratch(spark) -> str:
    """A fresh folder name in the shared folder; writers create it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


@query("migrate_append", f"{ROUTED} {ACCEPTED}")
def migrate_append(spark, sf):
    """Write the table twice under one run id: the second writing replaces the first."""
    out = _scratch(spark)
    for _ in range(2):
        P.migrate_table(I.cust(spark, sf), CUSTOMER_PLAN, out, "r1", parents(spark, sf), held(spark, sf))
    return spark.read.parquet(os.path.join(out, "customers")).drop("run_id", "batch_id")


@query("rollback_run", f"with {PROJECTED} select customer_id, full_name from projected where row_no % 2 = 0")
def rollback_run(spark, sf):
    """Two runs go in, one is rolled back."""
    path = os.path.join(_scratch(spark), "customers")
    rows = move.project(I.cust(spark, sf), CUSTOMER_PLAN.mappings, ("row_no",)).select("row_no", "customer_id", "full_name")
    TB.append_rows(rows.where(F.col("row_no") % 2 == 0).drop("row_no"), path, "r1")
    TB.append_rows(rows.where(F.col("row_no") % 2 != 0).drop("row_no"), path, "r2")
    TB.rollback_run(spark, os.path.dirname(path), "r2")
    return spark.read.parquet(path).drop("run_id", "batch_id")


@query("user_function", "select c_custkey, abs(c_acctbal) as balance from customer")
def user_function(spark, sf):
    mapping = Mapping(("c_acctbal",), ("balance",), rule=lambda c: F.abs(c))
    return move.project(I.table(spark, sf, "customer"), (mapping,), ("c_custkey",))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def letter_profile(texts: pd.Series) -> pd.Series:
    """A user's own embedder: shares of five vowels."""

    def profile(text: str):
        low = text.lower()
        counts = [low.count(v) + 0.001 for v in "aeiou"]
        norm = sum(c * c for c in counts) ** 0.5
        return [c / norm for c in counts]

    return texts.map(profile)


def _scorer_sql() -> str:
    counts = ", ".join(f"length(lower(text)) - length(replace(lower(text), '{v}', '')) + 0.001::double" for v in "aeiou")
    profile = f"select id, text, list_transform(c, lambda x: (x / sqrt(list_sum(list_transform(c, lambda y: y * y))))::float::double) as e from (select id, text, [{counts}] as c from {{}})"
    dot = "list_sum(list_transform(range(1, 6), lambda i: {0}.e[i] * {1}.e[i]))"
    logit = [0.0, "length(q.text) / 100.0", "length(d.text) / 1000.0"]
    top = f"greatest({logit[0]}, {logit[1]}, {logit[2]})"
    total = " + ".join(f"exp({x} - {top})" for x in logit)
    label = f"case when {logit[0]} = {top} then '{L.NLI_LABELS[0]}' when {logit[1]} = {top} then '{L.NLI_LABELS[1]}' else '{L.NLI_LABELS[2]}' end"
    return f"""with q as ({profile.format("(select item_id as id, text from benchmark)")}), d as ({profile.format("(select doc_id as id, text from documents)")}),
    met as (select q.id as query_id, d.id as chunk_id, round(1 - ({dot.format("q", "q")} + {dot.format("d", "d")} - 2 * {dot.format("q", "d")}), 6) as score from q cross join d),
    best as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from met)
    select query_id, chunk_id, cast(rank as integer) as rank, score, {label} as nli_label, round(1.0 / ({total}), 6) as confidence
    from best join q on q.id = query_id join d on d.id = chunk_id where rank <= 3"""


@query("user_scorer", _scorer_sql())
def user_scorer(spark, sf):
    """Retrieval with a user's embedder, labels with a user's classifier."""
    texts = I.generated(spark, sf).select(F.col("doc_id").alias("query_id"), F.col("text").alias("claim"))
    docs = I.corpus(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text")
    found = retrieval.evidence_topk(retrieval.embed(texts, "claim", letter_profile), retrieval.embed(docs, "text", letter_profile), 3)
    pairs = found.join(texts, "query_id").join(docs, "chunk_id")

    def by_length(claim, text):
        return F.array(F.lit(0.0), F.length(claim) / 100.0, F.length(text) / 1000.0)

    return verify.classify_evidence(pairs, by_length).select("query_id", "chunk_id", "rank", "score", "nli_label", "confidence")
