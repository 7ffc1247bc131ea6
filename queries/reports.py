"""Report and explanation queries."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corroborate.functions import lexicon as L
from corroborate.functions import similarity as S
from corroborate.operators import explain as X
from corroborate.operators import match, profile
from corroborate.operators import reports as R
from corroborate.session import fleeting_shuffles, small, stage
from corroborate.sources import tables as TB
from queries import inputs as I
from queries import SQL, query
from queries.grounding import CHUNKED, GROUND
from queries.grounding import SCORES as GROUND_SCORES
from queries.matching import MATCHED, MET, PROPOSED, UNMAPPED, conversion_sql, mappings, met, met_pairs, norm_a_sql, proposed_mappings, quote, reason_sql, tables, tokens_sql
from queries.migration import REJECTED, RESULTS, ROUTED, _scratch, results, routed
from queries.quality import SPECS, SUITE, suite

CHECKS = f"checks as ({SUITE})"


def unmapped(spark, sf, mapped):
    return match.unmapped_columns(I.legacy_columns(spark, sf), I.modern_columns(spark, sf), mapped)


PAIRS = "pair_conf as (select source_table, target_table, avg(ensemble) as confidence, count(*) as column_count from mappings group by 1, 2)"


@query("table_flow", f"""{MATCHED}, {PAIRS} select source_table, target_table, greatest(1, cast(floor(confidence * 100) as integer)) as weight,
    case when confidence >= 0.85 then 'rgba(46, 204, 113, 0.6)' when confidence >= 0.60 then 'rgba(241, 196, 15, 0.6)' else 'rgba(231, 76, 60, 0.6)' end as colour from pair_conf""")
def table_flow(spark, sf):
    return R.table_flow(mappings(spark, sf))


@query("column_flow", f"""{MATCHED} select source_table, source_column, case when s.is_primary_key then 'primary_key' else 'source' end as source_class, target_table, target_column,
    case when t.is_primary_key then 'primary_key' else 'target' end as target_class, greatest(1, cast(floor(ensemble * 100) as integer)) as weight,
    case when ensemble >= 0.85 then 'rgba(46, 204, 113, 0.7)' when ensemble >= 0.60 then 'rgba(241, 196, 15, 0.7)' else 'rgba(231, 76, 60, 0.7)' end as colour
    from mappings join src s on s.table_name = source_table and s.column_name = source_column join tgt t on t.table_name = target_table and t.column_name = target_column""")
def column_flow(spark, sf):
    return R.column_flow(mappings(spark, sf), I.legacy_columns(spark, sf), I.modern_columns(spark, sf))


@query("pair_confidence", f"{MATCHED}, {PAIRS} select source_table, target_table, round(confidence, 5) as confidence, column_count from pair_conf")
def pair_confidence(spark, sf):
    return R.pair_confidence(mappings(spark, sf)).withColumn("confidence", F.round("confidence", 5))


NODES = """
named as (select 'source' as side, source_table as table_name, source_column as column_name, null as reason from mappings
  union select 'target', target_table, target_column, null from mappings union all select side, table_name, column_name, reason from unmapped),
nodes as (select row_number() over (order by side, table_name, column_name) - 1 as node, *, case when reason is null then side else side || '_unmapped' end as type from named)
"""


@query("mapping_graph", f"{MATCHED}, {UNMAPPED}, {NODES} select node, side || '_' || table_name || '_' || column_name as id, table_name || '.' || column_name as name, type, reason from nodes")
def mapping_graph(spark, sf):
    mapped = mappings(spark, sf)
    return R.graph_nodes(mapped, unmapped(spark, sf, mapped)).select("node", "id", "name", "type", "reason")


@query("mapping_links", f"""{MATCHED}, {UNMAPPED}, {NODES} select s.node as source, t.node as target, ensemble as value, confidence_level as confidence, mapping_type
    from mappings join nodes s on s.side = 'source' and s.table_name = source_table and s.column_name = source_column
    join nodes t on t.side = 'target' and t.table_name = target_table and t.column_name = target_column""")
def mapping_links(spark, sf):
    mapped = mappings(spark, sf)
    return R.graph_links(mapped, R.graph_nodes(mapped, unmapped(spark, sf, mapped)))


# how often part brands and return flags meet, as a score
MATRIX = "select p_brand as source, l_returnflag as target, l_discount * 10 as score from lineitem join part on p_partkey = l_partkey"


@query("similarity_matrix", f"""select source, max(score) filter (target = 'A') as "A", max(score) filter (target = 'N') as "N", max(score) filter (target = 'R') as "R" from ({MATRIX}) group by source""")
def similarity_matrix(spark, sf):
    parts = I.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("source"))
    scores = I.table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return R.similarity_matrix(scores.select("source", F.col("l_returnflag").alias("target"), (F.col("l_discount") * 10).alias("score")), ["A", "N", "R"])


EDGES = [(t, k.column, k.ref_table, k.ref_column) for t, spec in SPECS.items() if t != "cust" for k in spec.foreign_keys]


@query("fk_edges", " union all ".join(f"select '{t}' as from_table, '{c}' as from_column, '{rt}' as to_table, '{rc}' as to_column, (select count(*) from {t}) as row_count" for t, c, rt, rc in EDGES))
def fk_edges(spark, sf):
    """Edges of the declared keys, with the rows behind each."""
    data = tables(spark, sf)
    edges = R.fk_edges(profile.column_catalog(spark, data, SPECS))
    return edges.join(profile.table_counts(data).withColumnRenamed("table_name", "from_table"), "from_table")


@query("status_counts", f"with {CHECKS} select status, count(*) as checks from checks group by status")
def status_counts(spark, sf):
    return R.status_counts(suite(spark, sf))


@query("migration_summary", f"""{RESULTS} select cast(sum(records_migrated) as bigint) as migrated, cast(sum(records_failed) as bigint) as failed,
    cast(sum(records_attempted) - sum(records_migrated) - sum(records_failed) as bigint) as skipped, round(sum(records_migrated) * 100.0 / sum(records_attempted), 1) as success_pct from results""")
def migration_summary(spark, sf):
    return R.migration_summary(results(spark, sf))


@query("relationship_types", f"""{PROPOSED}, {UNMAPPED} select case mapping_type when '1:N' then '1:N (Split)' when 'N:1' then 'N:1 (Merge)' else '1:1 Mappings' end as category, count(*) as columns from mappings group by 1
    union all select case when side = 'source' then 'Unmapped Source' else 'Unmapped Target' end, count(*) from unmapped group by side""")
def relationship_types(spark, sf):
    mapped = proposed_mappings(spark, sf)
    return R.relationship_types(mapped, unmapped(spark, sf, mapped))


@query("confidence_histogram", f"{MATCHED} select least(cast(floor(ensemble * 10) as integer) + 1, 10)::bigint as bin, count(*) as n from mappings group by 1")
def confidence_histogram(spark, sf):
    return R.confidence_histogram(mappings(spark, sf), "ensemble")


@query("reject_types", f"{ROUTED} select error_type, count(*) as records from ({REJECTED}) group by 1")
def reject_types(spark, sf):
    return R.reject_types(routed(spark, sf).rejects)


def _after(chain: str, more: str) -> str:
    """Append the steps of another WITH to a chain."""
    return f"{chain}, {more.strip().removeprefix('with').strip()}"


@query("dashboard", f"""{_after(MATCHED, RESULTS)}, {CHECKS} select cast((select sum(records_migrated) from results) as bigint) as migrated, cast((select sum(records_failed) from results) as bigint) as failed,
    count(*) filter (ensemble >= 0.85) as high, count(*) filter (ensemble >= 0.60 and ensemble < 0.85) as medium, count(*) filter (ensemble < 0.60) as low, round(avg(ensemble), 5) as average_score,
    (select count(*) filter (status = 'passed') from checks) as checks_passed, (select count(*) filter (status <> 'passed') from checks) as checks_with_issues from mappings""")
def dashboard(spark, sf):
    return R.dashboard(results(spark, sf), mappings(spark, sf), suite(spark, sf))


@query("schema_side_by_side", f"""{MATCHED}, l as (select s.table_name as source_table, s.column_name as source_column, s.data_type as source_type, target_table, target_column
      from src s left join mappings on source_table = s.table_name and source_column = s.column_name)
    select source_table, source_column, source_type, coalesce(target_table, t.table_name) as target_table, coalesce(target_column, t.column_name) as target_column, t.data_type as target_type
    from l full join tgt t on t.table_name = target_table and t.column_name = target_column""")
def schema_side_by_side(spark, sf):
    return R.side_by_side(mappings(spark, sf), I.legacy_columns(spark, sf), I.modern_columns(spark, sf))


@query("mapping_report", f"""{MATCHED} select source_table, source_column, source_type, target_table, target_column, target_type, round(ensemble, 4) as confidence_score, confidence_level, mapping_type,
    transformation, round(cosine, 4) as cosine, round(proposal, 4) as proposal, round(tfidf, 4) as tfidf, round(domain, 4) as domain, why_mapped from mappings""")
def mapping_report(spark, sf):
    return R.mapping_report(mappings(spark, sf))


@query("platform_summary", f"""{MATCHED} select count(distinct (source_table, target_table)) as table_pairs_mapped, count(*) as total_column_mappings, count(*) filter (ensemble >= 0.85) as high_confidence_mappings,
    printf('%.1f%%', count(*) filter (ensemble >= 0.85) * 100.0 / count(*)) as mapping_confidence_rate from mappings""")
def platform_summary(spark, sf):
    return R.platform_summary(mappings(spark, sf))


# --- explanations ---------------------------------------------------------------
# Pairs of columns that meet in lineitem, scored cheaply: token cosine of the names,
# shared share of their letters' positions is left to the fuzzy score elsewhere.


NAMES, TYPES = ["source_column", "target_column"], ["source_type", "target_type"]


def scores(rows):
    """Scores of the different pairs of names and of types; they are compared once, however many columns have them."""
    bag = lambda name: F.array_distinct(F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " "))
    shared = F.size(F.array_intersect(bag("source_column"), bag("target_column")))
    every = F.size(F.array_union(bag("source_column"), bag("target_column")))
    span = F.greatest(F.length("source_column"), F.length("target_column"))
    alike = stage(
        rows.select(*NAMES).distinct().select(
            *NAMES, F.round(shared / every, 4).alias("semantic"), F.round(1 - F.levenshtein("source_column", "target_column") / span, 4).alias("syntactic")
        ),
        "alike",
    )
    return alike, stage(rows.select(*TYPES).distinct().withColumn("type_score", S.type_score(F.col("source_type"), F.col("target_type"))), "fit")


def scored(rows, alike, fit):
    """Rows with the three scores of their names and types, and their blend."""

    def joined(left, right, on):
        return left.join(right, reduce(Column.__and__, [left[c].eqNullSafe(right[c]) for c in on])).drop(*[right[c] for c in on])

    return joined(joined(rows, alike, NAMES), fit, TYPES).withColumn("overall", F.round(0.5 * F.col("semantic") + 0.3 * F.col("syntactic") + 0.2 * F.col("type_score"), 4))


def judged(spark, sf):
    """Met column pairs with the three scores and their blend."""
    rows = stage(met(spark, sf), "met")
    alike, fit = scores(rows)
    return scored(rows, small(alike, 1_000_000), small(fit))


def judged_in_order(spark, sf, rows: int = 100_000, most: int = 1_000_000):
    """What explanations of the pairs of :func:`judged` read, in the order of the hash of their names, and the pairs as ``(h, a, b)``.

    A pair is dealt by hash as three numbers, its hash and those of name and
    type on both sides, ``rows`` to a partition, and gets words and scores where
    it lies. If these are too many to send to all, the words are sorted.
    """
    pairs, sources, targets = met_pairs(spark, sf)
    by_s, sources = I.numbered(sources, "s", ["source_column", "source_type"], "source_table", "source_column")
    by_t, targets = I.numbered(targets, "t", ["target_column", "target_type"], "target_table", "target_column")
    met_by = pairs.join(by_s.withColumnRenamed("at", "a"), "s").join(small(stage(by_t.withColumnRenamed("at", "b"), "targets"), most), "t")
    thin = stage(met_by.select(F.xxhash64("source_table", "source_column", "target_table", "target_column").alias("h"), "a", "b"), "thin")
    sources, targets = sources.withColumnRenamed("at", "a"), targets.withColumnRenamed("at", "b")
    read, few = [sources, targets], [small(sources, most), small(targets, most)]
    found = scores(thin.join(few[0], "a").join(few[1], "b"))
    read, few = [*read, *found], [*few, small(found[0], most), small(found[1])]

    def told(numbers):
        return scored(numbers.join(few[0], "a").join(few[1], "b"), *few[2:])

    if any(x is y for x, y in zip(read, few, strict=True)):
        return told(thin).orderBy("h"), thin
    return told(thin.repartitionByRange(max(2, -(-thin.count() // rows)), "h")).sortWithinPartitions("h"), thin


def _compat() -> str:
    return ", ".join(f"({quote(a)}, {quote(b)})" for a, bs in L.TYPE_COMPATIBILITY.items() for b in bs)


def _bag(c: str) -> str:
    return f"list_distinct(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '))"


JUDGED = f"""with compat(a, b) as (values {_compat()}), m1 as (select *, trim(split_part(upper(source_type), '(', 1)) as s, trim(split_part(upper(target_type), '(', 1)) as t from ({MET})),
m2 as (select *, case when s = t then 1.0 when (s, t) in (select (a, b) from compat) then 0.8 when (t, s) in (select (a, b) from compat) then 0.6 else 0.2 end::double as type_score,
  round(len(list_intersect({_bag('source_column')}, {_bag('target_column')})) / len(list_distinct(list_concat({_bag('source_column')}, {_bag('target_column')}))), 4) as semantic,
  round(1 - levenshtein(source_column, target_column) / greatest(length(source_column), length(target_column)), 4) as syntactic from m1),
judged as (select *, round(0.5 * semantic + 0.3 * syntactic + 0.2 * type_score, 4) as overall from m2)
"""


def pct(c: str) -> str:
    return f"printf('%.0f%%', round_even({c} * 100, 0))"


@query("recommendations", f"""{JUDGED}, {CHECKS}, low as (select * from judged where overall < 0.6),
    top as (select *, row_number() over (order by overall, source_table, source_column, target_table, target_column) as k from low),
    failed as (select count(*) as n, string_agg('• ' || check_name || ': ' || message, chr(10) order by '• ' || check_name || ': ' || message) as details from checks where status = 'failed')
    select 'recommendation' as kind, 'Review Low-Confidence Mappings' as title, 'Found ' || (select count(*) from low) || ' mapping(s) with low confidence' as summary,
      string_agg('• ' || source_column || ' → ' || target_column || ' (' || {pct('overall')} || ')', chr(10) order by k) as details from top where k <= 5 having count(*) > 0
    union all select 'warning', '⚠ Address Validation Failures Before Migration', 'Found ' || n || ' validation failure(s)', details from failed where n > 0
    union all select 'recommendation', 'Pre-Migration Checklist', 'Recommended steps before executing migration', {quote(chr(10).join(R.CHECKLIST))} where exists (select 1 from judged)""")
def recommendations(spark, sf):
    return R.recommendations(judged(spark, sf), suite(spark, sf), "overall").withColumn("details", F.array_join("details", "\n"))


@query("explain_mapping", f"""{JUDGED} select source_table, source_column, target_table, target_column,
    case when overall >= 0.85 then '✅ ' when overall >= 0.6 then '⚠ ' else '❓ ' end || source_column || ' → ' || target_column as title,
    case when overall >= 0.85 then 'High confidence match (' || {pct('overall')} || ')' when overall >= 0.6 then 'Moderate confidence match (' || {pct('overall')} || ') - Review recommended'
      else 'Low confidence match (' || {pct('overall')} || ') - Manual verification needed' end as summary,
    case when semantic >= 0.8 then '✅ Strong semantic similarity (' || {pct('semantic')} || '): The column names have similar meanings'
      when semantic >= 0.6 then '✓ Moderate semantic similarity (' || {pct('semantic')} || '): The columns appear to represent related concepts'
      when semantic >= 0.4 then '⚠ Weak semantic similarity (' || {pct('semantic')} || '): Limited semantic relationship detected'
      else '❌ Low semantic similarity (' || {pct('semantic')} || '): Names don''t appear semantically related' end || chr(10) ||
    case when syntactic >= 0.8 then '✅ Names are very similar (' || {pct('syntactic')} || '): ''' || source_column || ''' closely matches ''' || target_column || ''''
      when syntactic >= 0.6 then '✓ Names are somewhat similar (' || {pct('syntactic')} || '): Possibly abbreviations or variations'
      else 'ℹ Names differ significantly (' || {pct('syntactic')} || '): Matched primarily on meaning, not spelling' end || chr(10) ||
    case when type_score >= 1 then '✅ Exact type match: Both are ' || source_type when type_score >= 0.8 then '✓ Compatible types: ' || source_type || ' → ' || target_type || ' (safe conversion)'
      when type_score >= 0.6 then '⚠ Type conversion needed: ' || source_type || ' → ' || target_type || ' (review recommended)'
      else '❌ Type mismatch: ' || source_type || ' → ' || target_type || ' (manual review required)' end as details, source_pk, target_pk, source_nullable, target_nullable from judged""")
def explain_mapping(spark, sf):
    return X.explain_mapping(judged(spark, sf)).select(
        "source_table", "source_column", "target_table", "target_column", "title", "summary", F.array_join("details", "\n").alias("details"),
        "source_pk", "target_pk", "source_nullable", "target_nullable",
    )


def _conversions(spark, sf):
    from corroborate.operators import convert

    return convert.conversions(I.name_pairs(spark, sf).select("source_type", "target_type").distinct(), convert.conversion_rules(spark))


@query("explain_conversion", f"""with c as ({conversion_sql()}) select source_type, target_type, 'Transform: ' || source_type || ' → ' || target_type as title,
    case kind when 'direct' then 'No transformation needed - types are compatible' when 'implicit' then 'Safe implicit conversion will be applied' when 'explicit' then 'Explicit conversion required'
      when 'lossy' then '⚠ Potentially lossy conversion' else 'Unknown transformation - manual review required' end as summary,
    array_to_string(list_filter([
      case kind when 'direct' then 'Source type (' || source_type || ') matches target type (' || target_type || ')' when 'implicit' then 'Converting ' || source_type || ' → ' || target_type
        when 'explicit' then 'Must explicitly convert ' || source_type || ' → ' || target_type when 'lossy' then 'Converting ' || source_type || ' → ' || target_type || ' may lose data'
        else 'No predefined rule for ' || source_type || ' → ' || target_type end,
      case when kind = 'implicit' then 'This is a widening conversion and no data will be lost' end,
      case when kind = 'explicit' then 'A SQL CAST or transformation function will be applied' end,
      case when kind = 'lossy' and contains(source_type, 'FLOAT') and contains(target_type, 'INT') then 'Decimal values will be truncated' end,
      case when kind = 'lossy' and contains(source_type, 'TEXT') and contains(target_type, 'VARCHAR') then 'Long text may be truncated' end,
      case when kind = 'lossy' and contains(source_type, 'DATETIME') and contains(target_type, 'DATE') then 'Time component will be lost' end,
      case when potential_loss then '⚠ RECOMMENDATION: Verify sample data before migration' end], lambda x: x is not null), chr(10)) as details from c""")
def explain_conversion(spark, sf):
    return X.explain_conversion(_conversions(spark, sf)).select("source_type", "target_type", "title", "summary", F.array_join("details", "\n").alias("details"))


NOT_PASSED = """select *, coalesce(nullif(regexp_extract(details, 'duplicate_count=([0-9]+)', 1), ''), 'unknown') as dups, coalesce(nullif(regexp_extract(details, 'violations=(.*)$', 1), ''), 'unknown') as viols,
    coalesce(nullif(regexp_extract(details, 'null_counts=(.*)$', 1), ''), 'unknown') as nulls from checks where status in ('failed', 'warning')"""


@query("explain_check", f"""with {CHECKS}, c as ({NOT_PASSED}) select table_name, check_name, '❌ ' || check_name || ' Failed' as title, message as summary,
    message || case when contains(lower(check_name), 'null') then chr(10) || 'Found ' || nulls || ' NULL values' || chr(10) || '💡 Consider adding default values' || chr(10) || '💡 Verify if NULLs are expected in target schema'
      when contains(lower(check_name), 'duplicate') then chr(10) || 'Found ' || dups || ' duplicate records' || chr(10) || '💡 Remove or merge duplicate records' || chr(10) || '💡 Review primary key definition'
      when contains(lower(check_name), 'referential') then chr(10) || 'Found ' || viols || ' orphaned records' || chr(10) || '💡 Ensure parent records exist before migration' || chr(10) || '💡 Consider ON DELETE CASCADE settings'
      when contains(lower(check_name), 'row count') then chr(10) || 'Source: ?, Target: ?' || chr(10) || '💡 Check migration filters' || chr(10) || '💡 Verify no records were skipped' else '' end as lines from c""")
def explain_check(spark, sf):
    bad = suite(spark, sf).where(F.col("status").isin("failed", "warning"))
    return X.explain_check(bad).withColumn("lines", F.array_join("lines", "\n"))


@query("plain_mapping", f"""{JUDGED}, r as (select *, list_filter([case when syntactic >= 0.8 then 'the names are very similar' when syntactic >= 0.5 then 'the names are somewhat similar' end,
      case when semantic >= 0.8 then 'they appear to mean the same thing' when semantic >= 0.5 then 'they seem to represent similar data' end,
      case when upper(source_type) = upper(target_type) then 'they store the same type of data' end], lambda x: x is not null) as reasons from judged)
    select source_table, source_column, target_table, target_column, source_column || ' → ' || target_column as title,
    'The system matched ''' || source_column || ''' from the old database to ''' || target_column || ''' in the new database.' as what_happened,
    case when len(reasons) > 0 then 'This match was made because ' || array_to_string(reasons, ', and ') || '.' else 'This match was made based on overall pattern analysis.' end as why_it_happened,
    case when overall >= 0.85 then 'This is a reliable match. Data will transfer correctly without any issues.' when overall >= 0.6 then 'This match is likely correct, but someone should verify it before the full migration.'
      else 'This match needs manual review. The system is not confident about this pairing.' end as what_it_means,
    case when overall >= 0.85 then null when overall >= 0.6 then 'Please review this mapping before migration.' else '⚠️ Manual verification required before proceeding.' end as action_needed,
    case when overall >= 0.85 then 'High' when overall >= 0.6 then 'Medium' else 'Low' end as confidence_level, case when overall >= 0.85 then '✅' when overall >= 0.6 then '⚠️' else '❓' end as icon from r""")
def plain_mapping(spark, sf):
    return X.plain_mapping(judged(spark, sf))


@query("plain_unmapped", f"""{MATCHED}, {UNMAPPED} select side, table_name, column_name, 'Unmapped: ' || column_name as title,
    case when side = 'source' then 'The column ''' || column_name || ''' in the old database table ''' || table_name || ''' was not matched to any column in the new database.'
      else 'The column ''' || column_name || ''' in the new database table ''' || table_name || ''' was not matched to any column in the old database.' end as what_happened,
    case when side = 'source' then 'The system could not find a column in the new database that is similar enough to this one.' else 'There doesn''t appear to be equivalent data in the old system.' end as why_it_happened,
    case when side = 'source' then 'Data in this column will NOT be migrated unless you manually specify where it should go.' else 'This column will remain empty (or use default values) after migration.' end as what_it_means,
    case when side = 'source' then 'Decide if this data needs to be migrated. If yes, manually map it to a target column.' else 'Verify if this column should receive data from the old system.' end as action_needed from unmapped""")
def plain_unmapped(spark, sf):
    return X.plain_unmapped(unmapped(spark, sf, mappings(spark, sf)))


RULES = [*L.RULE_TEXTS, "something else"]


def _rules_sql() -> str:
    rows = ", ".join(f"({i}, {quote(r)}, {quote(L.RULE_TEXTS.get(r, L.RULE_TEXT_OTHER)[0])}, {quote(L.RULE_TEXTS.get(r, L.RULE_TEXT_OTHER)[1])})" for i, r in enumerate(RULES))
    return f"""with r(i, rule, title, reason) as (values {rows}), c as (select column_name as source_column, 'new_' || column_name as target_column, position from ({I.sql(I.LEGACY_COLUMNS)}))
    select source_column, target_column, rule, 'Transform: ' || source_column as title, 'Data from ''' || source_column || ''' will be converted before going into ''' || target_column || '''.' as what_happened,
      reason as why_it_happened, 'Your data will be automatically adjusted: ' || r.title || '.' as what_it_means from c join r on position % {len(RULES)} = i"""


@query("plain_rules", _rules_sql())
def plain_rules(spark, sf):
    rule = F.element_at(F.array(*map(F.lit, RULES)), (F.col("position") % len(RULES) + 1).cast("int"))
    rows = I.legacy_columns(spark, sf).select(F.col("column_name").alias("source_column"), F.concat(F.lit("new_"), "column_name").alias("target_column"), rule.alias("rule"))
    return X.plain_rule(rows)


def _causes_sql() -> str:
    rows = ", ".join(f"({quote(k)}, {quote(a)}, {quote(b)}, {quote(c)})" for k, (a, b, c) in L.REJECT_CAUSES.items())
    other = L.REJECT_CAUSE_OTHER
    return f"""{ROUTED}, causes(k, a, b, c) as (values {rows}) select record_id, error_type, 'Failed Record #' || record_id as title,
    'Record #' || record_id || ' could not be migrated: ' || coalesce(a, {quote(other[0])}) || '.' as what_happened, coalesce(b, {quote(other[1])}) as why_it_happened,
    'This specific record was NOT moved to the new system.' as what_it_means, coalesce(c, {quote(other[2])}) as action_needed from ({REJECTED}) left join causes on k = error_type"""


@query("reject_cause", _causes_sql())
def reject_cause(spark, sf):
    return X.reject_cause(routed(spark, sf).rejects)


@query("plain_check", f"""with {CHECKS} select table_name, check_name, status,
    case when contains(lower(check_name), 'row count') then case when status = 'passed' then 'Row Count Check' else 'Row Count Mismatch' end
      when contains(lower(check_name), 'null') then case when status = 'passed' then 'Data Completeness Check' else 'Missing Data Found' end
      when contains(lower(check_name), 'duplicate') then case when status = 'passed' then 'Duplicate Check' else 'Duplicates Found' end else check_name end as title,
    case when contains(lower(check_name), 'row count') then case when status = 'passed' then 'All records were successfully migrated.' else 'The old system had ? records, but the new system has ?.' end
      when contains(lower(check_name), 'null') then case when status = 'passed' then 'All required fields have values.' else 'Some fields have empty values that shouldn''t be empty.' end
      when contains(lower(check_name), 'duplicate') then case when status = 'passed' then 'No duplicate records were found.' else 'The same record appears multiple times.' end else 'A validation check was performed.' end as what_happened,
    case when contains(lower(check_name), 'row count') then case when status = 'passed' then '✅ No data was lost during migration.' else '⚠️ Not all data was transferred. Investigation needed.' end
      when contains(lower(check_name), 'null') then case when status = 'passed' then '✅ Data is complete and ready for use.' else '⚠️ Some records may be incomplete in the new system.' end
      when contains(lower(check_name), 'duplicate') then case when status = 'passed' then '✅ Data integrity is maintained.' else '⚠️ You may have redundant data that needs cleanup.' end
      else case when status = 'passed' then '✅ Check passed.' else '⚠️ Check requires attention.' end end as what_it_means,
    case when status = 'passed' then null when contains(lower(check_name), 'row count') then 'Check the failed records report to see what was missed.'
      when contains(lower(check_name), 'null') then 'Review which fields are empty and decide if they need default values.' when contains(lower(check_name), 'duplicate') then 'Identify and remove duplicate records.'
      else 'Review the details and address any issues.' end as action_needed from checks""")
def plain_check(spark, sf):
    return X.plain_check(suite(spark, sf))


@query("executive_summary", f"""{_after(MATCHED, RESULTS)}, {CHECKS}, t as (select (select count(*) from results) as tables, cast((select sum(records_migrated) from results) as bigint) as migrated,
      cast((select sum(records_failed) from results) as bigint) as failed, count(*) filter (confidence_level = 'high') as confident, count(*) filter (confidence_level <> 'high') as to_review,
      (select count(*) filter (status = 'passed') from checks) as checks_passed, (select count(*) filter (status = 'failed') from checks) as checks_failed from mappings)
    select *, round(migrated * 100.0 / (migrated + failed), 6) as success_rate,
      case when failed = 0 and checks_failed = 0 then '✅ SUCCESS' when migrated * 100.0 / (migrated + failed) > 95 then '⚠️ ATTENTION NEEDED' else '❌ ISSUES DETECTED' end as overall,
      case when failed = 0 and checks_failed = 0 then '✅ Great news! The migration completed successfully. All your data has been transferred to the new system without any issues. You can proceed with confidence.'
        when migrated * 100.0 / (migrated + failed) > 99 then '⚠️ Almost there! ' || printf('%.1f', migrated * 100.0 / (migrated + failed)) || '% of your data migrated successfully. A small number of records (' || format('{{:,}}', failed)
          || ') need manual attention. Review the "Failed Records" section below to resolve these issues.'
        when migrated * 100.0 / (migrated + failed) > 95 then '⚠️ Needs Review. Most data (' || printf('%.1f', migrated * 100.0 / (migrated + failed)) || '%) transferred correctly, but ' || format('{{:,}}', failed)
          || ' records require investigation. We recommend reviewing the failures before going live with the new system.'
        else '❌ Action Required. A significant portion of your data (' || format('{{:,}}', failed) || ' records) did not migrate successfully. Please review the detailed report below and work with your technical team to resolve these issues before proceeding.'
      end as meaning from t""")
def executive_summary(spark, sf):
    return X.executive_summary(results(spark, sf), mappings(spark, sf), suite(spark, sf)).withColumn("success_rate", F.round("success_rate", 6))


@query("match_reason", f"""{MATCHED} select source_table, source_column, target_column, {reason_sql('source_column', 'target_column')} as reason from mappings""")
def match_reason(spark, sf):
    reason = match.match_reason(F.col("domain"), F.col("cosine"), F.col("tfidf"), F.col("source_column"), F.col("target_column"))
    return mappings(spark, sf).select("source_table", "source_column", "target_column", reason.alias("reason"))


@query("qa_report", f"""{_after(PROPOSED, ROUTED)}, {UNMAPPED} select 'column_mapping' as topic, 'Why was ''' || source_column || ''' mapped to ''' || target_column || '''?' as question, why_mapped as answer,
    printf('%.1f%%', ensemble * 100) || ' confident' as note from mappings
    union all select 'ignored_column', 'Why was ''' || table_name || '.' || column_name || ''' not mapped?', reason, null from unmapped where side = 'source'
    union all select 'transformation', 'What transformation was applied to ''' || source_column || '''?', transformation, source_type || ' → ' || target_type from mappings where transformation not in ('none', '')
    union all select 'failed_data', 'Why did this record fail to migrate?', error_message, record_data from ({REJECTED})""")
def qa_report(spark, sf):
    mapped = proposed_mappings(spark, sf)
    return X.qa_report(mapped, unmapped(spark, sf, mapped), routed(spark, sf).rejects)


# --- files ----------------------------------------------------------------------


@query("report_json", f"{GROUND}, {GROUND_SCORES} select doc_id, total, supported, round(trust_score, 6) as trust_score from scores")
def report_json(spark, sf):
    """The grounding report as JSON files, read back."""
    from queries.grounding import job

    path = os.path.join(_scratch(spark), "report")
    TB.write_json(job(spark, sf).report(), path)
    return spark.read.json(path).select("doc_id", "total", "supported", F.round("trust_score", 6).alias("trust_score"))


def _report_sql() -> str:
    failed = SQL["explain_check"].replace("where status in ('failed', 'warning')", "where status in ('failed')")
    lines = "list_concat(['### ' || title, '', '**' || summary || '**', ''], list_transform(string_split({}, chr(10)), lambda x: '- ' || x), [''])"
    return f"""with em as ({SQL["explain_mapping"]}), ec as ({failed})
    select unnest({lines.format("details")}) as value from em union all select unnest({lines.format("lines")}) from ec
    union all select '## Column Mappings' where exists (select 1 from em) union all select '## Validation Results' where exists (select 1 from ec)"""


@query("report_text", _report_sql())
def report_text(spark, sf):
    """The explanation report of mappings and checks, as ordered text lines."""
    path = os.path.join(_scratch(spark), "report.md")
    with fleeting_shuffles(spark):
        mapped, pairs = judged_in_order(spark, sf)
        failed = stage(suite(spark, sf).where(F.col("status") == "failed"), "failed").orderBy(F.xxhash64("table_name", "check_name"))
        told = X.explain_mapping(mapped).select(F.lit("mapping").alias("kind"), "title", "summary", "details")
        checked = X.explain_check(failed).select(F.lit("validation").alias("kind"), "title", "summary", F.col("lines").alias("details"))
        TB.write_report([told, checked], path, made_of=[pairs.select(F.lit("mapping").alias("kind")), checked], compression="gzip")
    return spark.read.text(path)


@query("kb_clear", f"{CHUNKED} select 0::bigint as after, count(*) as before from chunks")
def kb_clear(spark, sf):
    """Fill the chunk store, append again without effect, then clear it."""
    from corroborate.operators.chunks import chunk_documents
    from corroborate.sources import corpus as C

    path = os.path.join(_scratch(spark), "store")
    chunks = chunk_documents(I.corpus(spark, sf))
    C.append_chunks(chunks, path)
    C.append_chunks(chunks, path)
    filled = spark.read.parquet(path).count()
    left = C.clear_chunks(spark, path)
    return left.agg(F.count("*").alias("after")).withColumn("before", F.lit(filled))
