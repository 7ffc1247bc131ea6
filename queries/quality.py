"""Data-quality queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.operators import quality as Q
from corroborate.specs import ForeignKey, TableSpec
from queries import inputs as I
from queries import query
from queries.migration import CUSTOMER_PLAN

SPECS = {
    "customer": TableSpec("customer", ("c_custkey",), (ForeignKey("c_nationkey", "nation", "n_nationkey"),)),
    "orders": TableSpec("orders", ("o_orderkey",), (ForeignKey("o_custkey", "customer", "c_custkey"),)),
    "lineitem": TableSpec(
        "lineitem", ("l_orderkey", "l_linenumber"),
        (ForeignKey("l_orderkey", "orders", "o_orderkey"), ForeignKey("l_partkey", "part", "p_partkey"), ForeignKey("l_suppkey", "supplier", "s_suppkey")),
    ),
    "nation": TableSpec("nation", ("n_nationkey",), (ForeignKey("n_regionkey", "region", "r_regionkey"),)),
    "region": TableSpec("region", ("r_regionkey",)),
    "part": TableSpec("part", ("p_partkey",)),
    "supplier": TableSpec("supplier", ("s_suppkey",), (ForeignKey("s_nationkey", "nation", "n_nationkey"),)),
    "cust": TableSpec("cust", ("cust_id",), (ForeignKey("nation", "nation", "n_nationkey"),)),
}
CHECKED = ["customer", "orders", "lineitem", "nation", "region", "part", "supplier", "cust"]
CUST = I.sql(I.CUST)
CUST_COLUMNS = ["row_no", "cust_id", "cust_name", "nation", "bal_text", "segment", "tier"]


def load(spark, sf, name):
    return I.cust(spark, sf) if name == "cust" else I.table(spark, sf, name)


def parents(spark, sf):
    return {n: I.table(spark, sf, n) for n in ("customer", "orders", "nation", "region", "part", "supplier")}


def each(spark, sf, fn) -> DataFrame:
    return reduce(DataFrame.unionByName, [fn(load(spark, sf, n), SPECS[n]) for n in CHECKED])


def flat(checks: DataFrame) -> DataFrame:
    """Details as sorted text, so that both engines give the same value."""
    text = F.array_join(F.array_sort(F.transform(F.map_entries("details"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " | ")
    return checks.select("table_name", "check_name", "status", "severity", "message", text.alias("details"))


# --- SQL ------------------------------------------------------------------------

COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "cust": CUST_COLUMNS,
}
TEXT = {
    "customer": ["c_name", "c_mktsegment"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "nation": ["n_name"],
    "region": ["r_name"],
    "part": ["p_name", "p_brand", "p_type"],
    "supplier": ["s_name"],
    "cust": ["cust_name", "bal_text", "segment", "tier"],
}


def src(name: str) -> str:
    return f"({CUST})" if name == "cust" else name


def union(fn) -> str:
    return " union all ".join(fn(n) for n in CHECKED)


def row_count_sql(n: str) -> str:
    return f"""select '{n}' as table_name, 'Row Count Check' as check_name, case when n = 0 then 'warning' else 'passed' end as status,
    case when n = 0 then 'medium' else 'low' end as severity, case when n = 0 then 'Table ''{n}'' is empty' else 'Table ''{n}'' has ' || format('{{:,}}', n) || ' rows' end as message,
    'row_count=' || n as details from (select count(*) as n from {src(n)})"""


def null_sql(n: str) -> str:
    found = ", ".join(f"case when count(*) filter ({c} is null) > 0 then '{c}=' || count(*) filter ({c} is null) end" for c in COLUMNS[n])
    return f"""select '{n}' as table_name, 'Null Value Check' as check_name, case when len(f) > 0 then 'warning' else 'passed' end as status,
    case when len(f) > 0 then 'medium' else 'low' end as severity, case when len(f) > 0 then 'Found NULL values in ' || len(f) || ' column(s)' else 'No NULL values found' end as message,
    'null_counts=' || array_to_string(f, ', ') as details from (select list_filter([{found}], lambda x: x is not null) as f from {src(n)})"""


def duplicate_sql(n: str) -> str:
    keys = SPECS[n].primary_key
    shown = " || ',' || ".join(f"coalesce(cast({k} as varchar), 'NULL')" for k in keys)
    return f"""select '{n}' as table_name, 'Duplicate Check' as check_name, case when n > 0 then 'failed' else 'passed' end as status,
    case when n > 0 then 'critical' else 'low' end as severity, case when n > 0 then 'Found ' || n || ' duplicate primary key(s)' else 'No duplicate primary keys found' end as message,
    case when n > 0 then 'duplicate_count=' || n || ' | ' else '' end || 'primary_key_columns={", ".join(keys)}' || case when n > 0 then ' | sample_duplicates=' || s else '' end as details
    from (select count(*) as n, array_to_string(list_sort(list({shown}))[1:5], '; ') as s from (select {", ".join(keys)} from {src(n)} group by {", ".join(keys)} having count(*) > 1))"""


def numeric_text_sql(n: str) -> str:
    found = ", ".join(f"case when count(*) filter (regexp_matches({c}, '^[0-9]')) > 50 then '{c}: TEXT column contains mostly numeric values' end" for c in TEXT[n])
    return f"""select '{n}' as table_name, 'Data Type Check' as check_name, case when len(f) > 0 then 'warning' else 'passed' end as status,
    case when len(f) > 0 then 'medium' else 'low' end as severity, case when len(f) > 0 then 'Found ' || len(f) || ' potential type issue(s)' else 'Data types appear consistent' end as message,
    case when len(f) > 0 then 'issues=' || array_to_string(f, '; ') else 'columns_checked={len(COLUMNS[n])}' end as details from (select list_filter([{found}], lambda x: x is not null) as f from {src(n)})"""


def fk_sql(n: str) -> str:
    fks = SPECS[n].foreign_keys
    if not fks:
        return f"""select '{n}' as table_name, 'Referential Integrity Check' as check_name, 'skipped' as status, 'low' as severity, 'No foreign keys defined' as message, '' as details"""
    counts = ", ".join(f"(select count(*) from {src(n)} t where t.{k.column} is not null and not exists (select 1 from {k.ref_table} r where r.{k.ref_column} = t.{k.column}))" for k in fks)
    names = "[" + ", ".join(f"'{k.column} → {k.ref_table}.{k.ref_column}='" for k in fks) + "]"
    return f"""select '{n}' as table_name, 'Referential Integrity Check' as check_name, case when len(f) > 0 then 'failed' else 'passed' end as status,
    case when len(f) > 0 then 'high' else 'low' end as severity, case when len(f) > 0 then 'Found ' || len(f) || ' FK violation(s)' else 'All foreign key references are valid' end as message,
    case when len(f) > 0 then 'violations=' || array_to_string(f, ', ') else 'foreign_keys_checked={len(fks)}' end as details
    from (select list_filter(list_transform(range(1, {len(fks)} + 1), lambda i: case when c[i] > 0 then {names}[i] || c[i] end), lambda x: x is not null) as f from (select [{counts}] as c))"""


SUITE = union(lambda n: " union all ".join(f(n) for f in (row_count_sql, null_sql, duplicate_sql, numeric_text_sql, fk_sql)))


# --- before the migration -------------------------------------------------------


@query("check_row_count", union(row_count_sql))
def check_row_count(spark, sf):
    return flat(each(spark, sf, lambda df, spec: Q.row_count_check(Q.column_facts(df, spec), spec.name)))


@query("check_nulls", union(null_sql))
def check_nulls(spark, sf):
    return flat(each(spark, sf, lambda df, spec: Q.null_check(Q.column_facts(df, spec), spec.name, df.columns)))


@query("check_duplicates", union(duplicate_sql))
def check_duplicates(spark, sf):
    return flat(each(spark, sf, Q.duplicate_check))


@query("check_numeric_text", union(numeric_text_sql))
def check_numeric_text(spark, sf):
    return flat(each(spark, sf, lambda df, spec: Q.numeric_text_check(Q.column_facts(df, spec), df, spec)))


@query("check_fk", union(fk_sql))
def check_fk(spark, sf):
    have = parents(spark, sf)
    return flat(each(spark, sf, lambda df, spec: Q.foreign_key_check(df, spec, have)))


def suite(spark, sf) -> DataFrame:
    have = parents(spark, sf)
    return each(spark, sf, lambda df, spec: Q.pre_migration_suite(df, spec, have))


@query("pre_migration_suite", SUITE)
def pre_migration_suite(spark, sf):
    return flat(suite(spark, sf))


# --- source against target ------------------------------------------------------
# Source: the faulty customer table. Target: what the router accepts of it.

# Compared are all pairs of the plan, those that are split or merged among them.

PAIRS = [(a, b) for m in CUSTOMER_PLAN.mappings for a in m.sources for b in m.targets]


def target(spark, sf):
    from queries.migration import routed

    return routed(spark, sf).accepted


def moved_sql() -> str:
    from queries.migration import ACCEPTED, ROUTED

    return f"{ROUTED}, src as ({CUST}), tgt as ({ACCEPTED})"


COUNTS = """select 'cust → customers' as table_name, 'Row Count Comparison' as check_name, case when s = t then 'passed' else 'failed' end as status,
  case when s = t then 'low' when abs(s - t) * 100.0 / s > 1 then 'critical' else 'high' end as severity,
  case when s = t then 'Row counts match: ' || format('{:,}', s) else 'Row count mismatch: ' || format('{:,}', s) || ' vs ' || format('{:,}', t) || ' (' || printf('%.2f', abs(s - t) * 100.0 / s) || '% difference)' end as message,
  case when s <> t then 'difference=' || abs(s - t) || ' | ' else '' end || 'source_count=' || s || ' | target_count=' || t as details
  from (select (select count(*) from src) as s, (select count(*) from tgt) as t)"""


def columns_sql() -> str:
    def one(a: str, b: str) -> str:
        return f"""select 'cust → customers' as table_name, 'Column Comparison: {a} → {b}' as check_name, case when sd <> td or sn <> tn then 'warning' else 'passed' end as status,
        case when sd <> td or sn <> tn then 'medium' else 'low' end as severity, case when sd <> td or sn <> tn then 'Column value differences detected' else 'Column values match' end as message,
        case when sd <> td or sn <> tn then 'issues=' || array_to_string(list_filter([case when sd <> td then printf('Distinct values differ: %d vs %d', sd, td) end,
          case when sn <> tn then printf('NULL counts differ: %d vs %d', sn, tn) end], lambda x: x is not null), '; ') else 'distinct_values=' || sd || ' | null_count=' || sn end as details
        from (select count(distinct {a}) as sd, count(*) filter ({a} is null) as sn from src), (select count(distinct {b}) as td, count(*) filter ({b} is null) as tn from tgt)"""

    return " union all ".join(one(a, b) for a, b in PAIRS)


# pairs whose target is a number; text on the source side is read as one
DISTRIBUTION_PAIRS = [("cust_id", "customer_id"), ("nation", "nation_id"), ("bal_text", "balance")]
AS_NUMBER = {"bal_text": r"case when regexp_matches(bal_text, '^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$') then cast(trim(bal_text) as double) end"}


def distributions_sql() -> str:
    def one(a: str, b: str) -> str:
        def moved(x: str) -> str:
            return f"abs(s{x} - t{x}) > 0.01 * greatest(abs(s{x}), abs(t{x}), 1e-12)"

        bad = f"({moved('m')} or {moved('d')})"
        return f"""select 'cust → customers' as table_name, 'Distribution Comparison: {a} → {b}' as check_name, case when {bad} then 'warning' else 'passed' end as status,
        case when {bad} then 'medium' else 'low' end as severity, case when {bad} then 'Distributions differ' else 'Distribution comparison completed' end as message,
        'source_mean=' || printf('%.4f', sm) || ' | target_mean=' || printf('%.4f', tm) as details
        from (select avg({AS_NUMBER.get(a, a)}) as sm, stddev_samp({AS_NUMBER.get(a, a)}) as sd from src), (select avg({b}) as tm, stddev_samp({b}) as td from tgt)"""

    return " union all ".join(one(a, b) for a, b in DISTRIBUTION_PAIRS)


MOVED = moved_sql()


@query("compare_counts", f"{MOVED} {COUNTS}")
def compare_counts(spark, sf):
    return flat(Q.compare_counts(I.cust(spark, sf), target(spark, sf), "cust", "customers"))


@query("compare_columns", f"{MOVED} {columns_sql()}")
def compare_columns(spark, sf):
    return flat(Q.compare_columns(I.cust(spark, sf), target(spark, sf), PAIRS, "cust", "customers"))


@query("compare_distributions", f"{MOVED} {distributions_sql()}")
def compare_distributions(spark, sf):
    return flat(Q.compare_distributions(I.cust(spark, sf), target(spark, sf), DISTRIBUTION_PAIRS, "cust", "customers"))


@query("post_migration_suite", f"{MOVED} {COUNTS} union all {columns_sql()} union all {distributions_sql()}")
def post_migration_suite(spark, sf):
    return flat(Q.post_migration_suite(I.cust(spark, sf), target(spark, sf), PAIRS, "cust", "customers"))


SUMMARY = """summary as (select count(*) as total_checks, count(*) filter (status = 'passed') as passed, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'warning') as warnings,
  count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'failed' and severity = 'critical') as critical_issues from checks)"""


@query("validation_summary", f"with checks as ({SUITE}), {SUMMARY} select * from summary")
def validation_summary(spark, sf):
    return Q.summarize(suite(spark, sf))


@query(
    "overall_status",
    f"""with checks as ({SUITE}), {SUMMARY} select *, case when critical_issues > 0 then 'BLOCKED' when failed > 0 then 'REVIEW_REQUIRED'
    when warnings > 0 then 'PASSED_WITH_WARNINGS' else 'PASSED' end as overall_status from summary""",
)
def overall_status(spark, sf):
    return Q.overall_status(Q.summarize(suite(spark, sf)))


def validation_sql() -> str:
    parts = ["""select 'row_count' as "check", 'cust -> customers' as item, (select count(*) from src) as source_value, (select count(*) from tgt) as target_value"""]
    parts += [f"select 'nulls', '{a} -> {b}', (select count(*) filter ({a} is null) from src), (select count(*) filter ({b} is null) from tgt)" for a, b in PAIRS]
    parts += [f"select 'duplicates', '{b}', null, (select count(*) from (select {b} from tgt group by {b} having count(*) > 1))" for a, b in PAIRS if "id" in a]
    return f"""validated as (select "check", item, cast(source_value as bigint) as source_value, cast(target_value as bigint) as target_value, case when "check" = 'duplicates' then target_value = 0 else source_value = target_value end as matches,
      'cust' as source_table, 'customers' as target_table from ({" union all ".join(parts)}))"""


def validated(spark, sf):
    return Q.run_validation(I.cust(spark, sf), target(spark, sf), PAIRS, "cust", "customers")


@query("run_validation", f"{MOVED}, {validation_sql()} select * from validated")
def run_validation(spark, sf):
    return validated(spark, sf)


@query(
    "validation_issues",
    f"""{MOVED}, {validation_sql()} select count(*) filter (not matches and "check" in ('row_count', 'duplicates')) as issues, count(*) filter (not matches and "check" = 'row_count') = 0 as is_valid,
    case when count(*) filter (not matches and "check" in ('row_count', 'duplicates')) = 0 then '✓ All validation checks passed. Data migration is complete and accurate.'
      else '⚠ ' || count(*) filter (not matches and "check" in ('row_count', 'duplicates')) || ' validation issues found. Review the detailed report.' end as summary from validated""",
)
def validation_issues(spark, sf):
    return Q.validation_issues(validated(spark, sf))


@query(
    "health_totals",
    f"""{MOVED}, {validation_sql()}, t as (select cast(sum(case when "check" = 'row_count' then source_value end) as bigint) as source_rows,
      cast(sum(case when "check" = 'row_count' then target_value end) as bigint) as target_rows, cast(coalesce(sum(case when "check" = 'nulls' then target_value end), 0) as bigint) as target_nulls,
      cast(coalesce(sum(case when "check" = 'duplicates' then target_value end), 0) as bigint) as duplicates,
      count(*) filter ("check" = 'nulls' and not matches) as null_mismatches, count(*) filter ("check" = 'duplicates' and not matches) as duplicate_columns from validated)
    select *, target_rows - source_rows as row_delta, case when source_rows > 0 then round(least(target_rows * 100.0 / source_rows, 100.0), 1) else 100.0 end::double as completion_pct from t""",
)
def health_totals(spark, sf):
    return Q.health_totals(validated(spark, sf))
