"""Inputs that queries derive from the given tables, on Spark and in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.session import small, stage


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "text")


def generated(spark: SparkSession, sf: str) -> DataFrame:
    """Texts to check: their passages also occur in the corpus."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns, one document per turn."""
    turns = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


ANSWERS = "select conv_id * 1000 + turn as doc_id, text from conversations where role = 'assistant'"


def paged(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut at line ends into numbered pages."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page"), "text")


PAGED = """
select doc_id, cast(pos as integer) as page, parts[pos] as text
from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as pos
      from (select doc_id, string_split(text, chr(10)) as parts from documents))
"""


# --- column catalogs --------------------------------------------------------------
# Legacy columns are named after parts, modern ones after suppliers; which parts meet
# which suppliers in lineitem gives pairs of names. One text serves both engines.

LEGACY = """
select p_partkey, 'legacy_' || lower(p_type) || '_' || cast(cast(floor(p_partkey / 200) as bigint) as varchar(9)) as table_name,
       case when p_partkey % 4 = 0 then replace(p_name, ' ', '_') || '_' || stem else prefix || stem end as column_name,
       data_type, p_partkey % 3 = 0 as is_nullable, p_partkey % 11 = 0 as is_primary_key
from {part} join (values (0, 'id'), (1, 'fname'), (2, 'lname'), (3, 'email'), (4, 'ph'), (5, 'addr'), (6, 'city'), (7, 'state'),
  (8, 'zip'), (9, 'type'), (10, 'status'), (11, 'created_dt'), (12, 'modified_dt'), (13, 'qty'), (14, 'amt'), (15, 'dob'),
  (16, 'desc'), (17, 'no'), (18, 'orderTotal'), (19, 'notes')) as stems(s_at, stem) on p_size % 20 = s_at
join (values (0, 'cust_'), (1, 'ord_'), (2, 'prod_'), (3, 'ph_'), (4, 'pol_'), (5, ''), (6, 'emp_')) as prefixes(p_at, prefix) on p_partkey % 7 = p_at
join (values (0, 'INTEGER'), (1, 'VARCHAR(50)'), (2, 'FLOAT'), (3, 'DATETIME'), (4, 'TEXT'), (5, 'DECIMAL(10,2)'), (6, 'BOOL'), (7, 'bigint'), (8, 'VARCHAR(100)')) as types(t_at, data_type)
  on (p_partkey + p_size) % 9 = t_at
"""
MODERN = """
select s_suppkey, 'modern_' || cast(s_nationkey as varchar(9)) as table_name,
       case when s_suppkey % 5 = 0 then stem || '_' || cast(s_suppkey % 13 as varchar(9)) else prefix || stem end as column_name,
       data_type, s_suppkey % 2 = 0 as is_nullable, s_suppkey % 7 = 0 as is_primary_key
from {supplier} join (values (0, 'id'), (1, 'first_name'), (2, 'last_name'), (3, 'email_address'), (4, 'phone_number'), (5, 'street_address'),
  (6, 'city'), (7, 'state_code'), (8, 'postal_code'), (9, 'type'), (10, 'is_active'), (11, 'created_at'), (12, 'updated_at'),
  (13, 'quantity'), (14, 'amount'), (15, 'date_of_birth'), (16, 'description'), (17, 'number'), (18, 'total'), (19, 'notes'), (20, 'pin-code'), (21, 'ring_id'), (22, 'widget_total')) as stems(s_at, stem) on (s_suppkey * 3) % 23 = s_at
join (values (0, 'customer_'), (1, ''), (2, 'order_'), (3, ''), (4, 'product_'), (5, 'policy_')) as prefixes(p_at, prefix) on s_suppkey % 6 = p_at
join (values (0, 'INTEGER'), (1, 'VARCHAR(100)'), (2, 'DOUBLE'), (3, 'TIMESTAMP'), (4, 'TEXT'), (5, 'VARCHAR(20)'), (6, 'BOOLEAN'), (7, 'DATE')) as types(t_at, data_type)
  on (s_suppkey + s_nationkey) % 8 = t_at
"""
# one row per (table, column); the column's position is that of its first row
LEGACY_COLUMNS = f"""
select table_name, column_name, cast(min(p_partkey) as int) as position, min(data_type) as data_type,
       min(is_nullable) as is_nullable, max(is_primary_key) as is_primary_key from ({LEGACY}) as legacy group by table_name, column_name
"""
MODERN_COLUMNS = f"""
select table_name, column_name, cast(min(s_suppkey) as int) as position, min(data_type) as data_type,
       min(is_nullable) as is_nullable, max(is_primary_key) as is_primary_key from ({MODERN}) as modern group by table_name, column_name
"""
NAME_PAIRS = f"""
select distinct l.column_name as source, m.column_name as target, l.data_type as source_type, m.data_type as target_type
from {{lineitem}} join ({LEGACY}) as l on l_partkey = p_partkey join ({MODERN}) as m on l_suppkey = s_suppkey
"""


# An outside proposer's answers: the columns that a legacy column meets most in lineitem,
# with the kind of mapping and its reasons. Not every proposal says everything.
SAID_OF_MET = """
select source_table, source_column, target_table, replace(upper(target_column), '_', '-') as target_column, least(95, 55 + 10 * n) / 100.0 as confidence,
       case when n % 3 = 0 then '1:N' when n % 3 = 1 then 'N:1' end as mapping_type,
       case when n % 3 = 0 then 'split on _' when n % 3 = 1 then 'merge with blank' end as transformation,
       case when n % 2 = 0 then 'they meet ' || cast(n as varchar(9)) || ' times' end as why_mapped, case when n % 2 = 0 then 'others meet less' end as why_not_others
from {met} as met
"""
MET_COUNTS = f"""(select l.table_name as source_table, l.column_name as source_column, m.table_name as target_table, m.column_name as target_column, count(*) as n
      from {{lineitem}} join ({LEGACY}) as l on l_partkey = p_partkey join ({MODERN}) as m on l_suppkey = s_suppkey
      group by l.table_name, l.column_name, m.table_name, m.column_name having count(*) > 2)"""
PROPOSALS = SAID_OF_MET.replace("{met}", MET_COUNTS)


def derived(spark: SparkSession, sf: str, text: str) -> DataFrame:
    names = [n for n in ("part", "supplier", "lineitem", "customer", "orders", "nation", "events") if "{" + n + "}" in text]
    return spark.sql(text, **{n: table(spark, sf, n) for n in names})


def sql(text: str) -> str:
    """The same text for DuckDB."""
    for n in ("part", "supplier", "lineitem", "customer", "orders", "nation", "events"):
        text = text.replace("{" + n + "}", n)
    return text


def legacy_columns(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, LEGACY_COLUMNS)


def modern_columns(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, MODERN_COLUMNS)


def numbered(rows: DataFrame, key: str, columns: list[str], *more: str) -> tuple[DataFrame, DataFrame]:
    """``(key, at, more)`` of all rows, and the different ``columns``, each with its number ``at``."""
    kinds = stage(rows.select(*columns).distinct().withColumn("at", F.monotonically_increasing_id()), "numbered")
    same = reduce(Column.__and__, [rows[c].eqNullSafe(kinds[c]) for c in columns])
    return rows.join(kinds, same).select(key, "at", *[rows[c] for c in more]), kinds


def met_numbers(spark: SparkSession, sf: str, parts: DataFrame, suppliers: DataFrame) -> DataFrame:
    """A row of numbers ``(s, t)`` per line: its part's column and its supplier's. Lines are not shuffled for a few suppliers."""
    suppliers = small(stage(suppliers, "suppliers"), 1_000_000)
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    return lines.join(suppliers.withColumnRenamed("at", "t"), "s_suppkey").join(parts.withColumnRenamed("at", "s"), "p_partkey").select("s", "t")


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    """PROPOSALS; lineitem is counted by numbers of columns, and names are joined to the few that meet often enough."""
    names = ["table_name", "column_name"]
    (parts, sources), (suppliers, targets) = numbered(derived(spark, sf, LEGACY), "p_partkey", names), numbered(derived(spark, sf, MODERN), "s_suppkey", names)
    counts = met_numbers(spark, sf, parts, suppliers).groupBy("s", "t").agg(F.count("*").alias("n")).where("n > 2")
    named = counts.join(sources.toDF("source_table", "source_column", "s"), "s").join(targets.toDF("target_table", "target_column", "t"), "t")
    return spark.sql(SAID_OF_MET, met=named).withColumn("confidence", F.col("confidence").cast("double"))


def name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, NAME_PAIRS)


# --- a legacy customer table with faults -------------------------------------------
# Every row of customer, with repeated keys, missing names, unknown nations, and text
# that is no number, put in by fixed rules so that each constraint has rows to reject.

CUST = """
select c_custkey as row_no,
       case when c_custkey % 50 = 7 then c_custkey - 1 when c_custkey % 9 = 0 then 0 else c_custkey end as cust_id,
       case when c_custkey % 97 = 3 then cast(null as varchar(60)) else c_name end as cust_name,
       case when c_custkey % 83 = 5 then c_nationkey + 100 else c_nationkey end as nation,
       case when c_custkey % 20 = 1 then 'n/a' when c_custkey % 20 = 2 then '12.5' else cast(cast(floor(c_acctbal) as bigint) as varchar(20)) end as bal_text,
       '  ' || c_mktsegment || ' ' as segment,
       case when c_custkey % 4 = 0 then cast(null as varchar(20)) else c_mktsegment end as tier
from {customer}
"""
# keys that the target already holds
HELD = "select c_custkey as customer_id from {customer} where c_custkey % 29 = 1"


def cust(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, CUST)
