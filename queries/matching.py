"""Name, type and column matching queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corroborate.functions import lexicon as L
from corroborate.functions import names as N
from corroborate.functions import similarity as S
from corroborate.functions import types as TY
from corroborate.operators import convert, match, profile
from corroborate.session import stage
from queries import inputs as I
from queries import query
from queries.grounding import lst, tokens_sql
from queries.quality import COLUMNS, SPECS

IDF2 = repr((1 + math.log(1.5)) ** 2)


def quote(v: str) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def map_sql(entries: dict) -> str:
    return "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in entries.items()) + "}"


def get_sql(entries: dict, key: str) -> str:
    return f"list_extract(map_extract({map_sql(entries)}, {key}), 1)"


def expand_sql(c: str, entries: dict) -> str:
    split = rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"
    return f"array_to_string(list_transform({split}, lambda w: coalesce({get_sql(entries, 'w')}, w)), ' ')"


def norm_a_sql(c: str) -> str:
    spaced = rf"trim(lower(regexp_replace(regexp_replace({c}, '([a-z])([A-Z])', '\1 \2', 'g'), '[_\-]+', ' ', 'g')))"
    return expand_sql(spaced, L.ABBREVIATIONS_A)


def norm_b_sql(c: str) -> str:
    return expand_sql(rf"regexp_replace(lower({c}), '[_\-.]', ' ', 'g')", L.ABBREVIATIONS_B)


def stripped_sql(c: str) -> str:
    return f"regexp_replace(lower({c}), '^(?:{'|'.join(L.NAME_PREFIXES)})', '')"


def groups_sql() -> str:
    def term(t: str) -> str:
        return f"contains(norm, '{t}') or contains('{t}', norm) or contains(core, '{t}')"

    cases = ", ".join(f"case when {' or '.join(term(t) for t in terms)} then '{g}' end" for g, terms in L.SEMANTIC_GROUPS.items())
    return f"list_filter([{cases}], lambda g: g is not null)"


def grams_sql(c: str) -> str:
    words = rf"list_transform(list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda w: w <> ''), lambda w: ' ' || w || ' ')"
    each = ", ".join(f"list_transform(range(1, length(p) - {n} + 2), lambda i: substring(p, i, {n}))" for n in (2, 3, 4))
    return f"flatten(list_transform({words}, lambda p: flatten([{each}])))"


BASE_WORD = "coalesce(" + ", ".join(f"case when contains(low, '{w}') then '{w}' end" for w in L.DATE_BASE_WORDS) + ")"
IS_DATE = " or ".join(f"contains(low, '{m}')" for m in L.DATE_MARKERS)

# features of the names in `names(name)`
FEATURES = f"""
f1 as (select name, trim(lower(name)) as low, {norm_b_sql('name')} as norm, {stripped_sql('name')} as stripped from names),
f2 as (select *, {norm_b_sql('stripped')} as core, {get_sql(L.ABBREVIATIONS_B, 'low')} as expansion,
         {get_sql(L.ABBREVIATIONS_B, 'stripped')} as stripped_expansion from f1),
feat as (select *, {groups_sql()} as groups, ({IS_DATE}) as is_date, {BASE_WORD} as base_word,
   list_distinct(string_split(norm, ' ')) as name_words,
   list_distinct(flatten(list_transform(list_distinct(string_split(norm, ' ')), lambda w: case when {get_sql(L.ABBREVIATIONS_B, 'w')} is not null
     then list_concat([w, replace({get_sql(L.ABBREVIATIONS_B, 'w')}, '_', ' ')], string_split({get_sql(L.ABBREVIATIONS_B, 'w')}, '_')) else [w] end))) as open_words
   from f2),
grams as (select name, gram, count(*) as n from (select name, unnest({grams_sql('norm')}) as gram from feat) group by 1, 2),
gram_norm as (select name, sum(n * n) as q from grams group by 1),
bags as (select name, b, count(*) as n from (select name, unnest({tokens_sql('norm')}) as b from feat) group by 1, 2),
bag_norm as (select name, sum(n * n) as q from bags group by 1)
"""

# scores of the pairs in `pairs(source, target)`
SCORED = f"""
shared as (select source, target, sum(a.n * b.n) as dot, sum(a.n * a.n) as ca, sum(b.n * b.n) as cb
   from pairs join grams a on a.name = source join grams b on b.name = target and a.gram = b.gram group by 1, 2),
bagged as (select source, target, sum(a.n * b.n) as dot from pairs join bags a on a.name = source join bags b on b.name = target and a.b = b.b group by 1, 2),
dom as (select p.source, p.target, s.norm = t.norm as same_meaning,
   coalesce({get_sql({f'{a}|{b}': v for a, b, v in L.KNOWN_PAIRS}, "s.low || '|' || t.low")}::double,
    case when s.norm = t.norm then 0.98 end, case when s.core = t.core then 0.95 end,
    case when replace(s.expansion, '_', '') = replace(t.low, '_', '') or s.expansion = t.norm then 0.95 end,
    case when replace(s.stripped_expansion, '_', '') = replace(t.low, '_', '') or replace(s.stripped_expansion, '_', ' ') = replace(t.low, '_', ' ') then 0.95 end,
    case when list_has_any(s.groups, t.groups) then 0.88 end,
    case when s.is_date and t.is_date then case when s.base_word in ('modified', 'modify') and t.base_word in ('updated', 'update') then 0.92
      when regexp_replace(s.base_word, '[de]', '', 'g') = regexp_replace(t.base_word, '[de]', '', 'g') then 0.92
      when s.base_word is not distinct from t.base_word then 0.95 end end,
    case when list_has_any(s.open_words, t.name_words) and (contains(t.core, s.core) or contains(s.core, t.core))
      then greatest(0.75, len(list_intersect(s.open_words, t.name_words)) / len(list_distinct(list_concat(s.open_words, t.name_words)))) end,
    len(list_intersect(s.open_words, t.name_words)) / len(list_distinct(list_concat(s.open_words, t.name_words)))) as domain
   from pairs p join feat s on s.name = p.source join feat t on t.name = p.target),
scored as (select d.source, d.target, same_meaning, round(domain, 6) as domain,
   round(case when b.dot is null then 0.0::double else least(1, b.dot / sqrt(bs.q * bt.q)) end, 6) as cosine,
   round(case when h.dot is null then 0.0::double else least(1, h.dot / sqrt(((gs.q - ca) * {IDF2} + ca) * ((gt.q - cb) * {IDF2} + cb))) end, 6) as tfidf
   from dom d left join shared h using (source, target) left join bagged b using (source, target)
   left join bag_norm bs on bs.name = d.source left join bag_norm bt on bt.name = d.target
   left join gram_norm gs on gs.name = d.source left join gram_norm gt on gt.name = d.target)
"""


# --- fuzzy score ------------------------------------------------------------------


def _chars(c: str) -> str:
    return f"list_filter(string_split({c}, ''), lambda x: x <> '')"


def _masks(x: str, y: str) -> str:
    """For each letter of ``y`` the bits of the places of ``x`` that hold it."""
    places = f"list_transform(list_filter(range(1, length({x}) + 1), lambda i: substring({x}, i::int, 1) = ch), lambda i: 1::hugeint << (i - 1)::int)"
    return f"list_transform({_chars(y)}, lambda ch: coalesce(list_reduce({places}, lambda p, q: p | q, 0::hugeint), 0::hugeint))"


def _common(size: str, masks: str) -> str:
    """Length of the longest common subsequence, from the masks of one string's letters in the other."""
    full = f"((1::hugeint << ({size})::int) - 1)"
    return f"({size} - bit_count(list_reduce({masks}, lambda r, h: ((r + (r & h)) | (r - (r & h))) & {full}, {full})))"


def _ratio_sql(x: str, y: str) -> str:
    return f"case when length({x}) + length({y}) = 0 then 1.0 else 2.0 * {_common(f'length({x})', _masks(x, y))} / (length({x}) + length({y})) end::double"


def _windows_sql(x: str, y: str, masks: str) -> str:
    """Best ratio of ``x`` with a window of its length in ``y``."""
    first, end = "greatest(i, 0)", f"least(i + length({x}), length({y}))"
    window = f"{masks}[{first} + 1:{end}]"
    return f"list_max(list_transform(range(1 - length({x}), length({y})), lambda i: (2.0 * {_common(f'length({x})', window)} / (length({x}) + {end} - {first}))::double))"


def _joined(words: str) -> str:
    return f"array_to_string(list_sort({words}), ' ')"


def fuzzy_steps(pairs: str) -> str:
    """Steps up to ``fuzzy(source, target, score)`` from ``pairs(source, target)`` of names."""
    words = lambda c: rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"
    return f"""
fz_names as (select name, {norm_a_sql('name')} as norm from (select source as name from {pairs} union select target from {pairs})),
fz_pairs as (select distinct a.norm as a, b.norm as b from {pairs} p join fz_names a on a.name = p.source join fz_names b on b.name = p.target),
fz_words as (select a, b, {words('a')} as x, {words('b')} as y, case when length(a) <= length(b) then a else b end as sh, case when length(a) <= length(b) then b else a end as lg from fz_pairs),
fz_sets as (select *, {_joined('list_distinct(list_filter(x, lambda w: list_contains(y, w)))')} as joint, {_joined('list_distinct(list_filter(x, lambda w: not list_contains(y, w)))')} as only_x,
   {_joined('list_distinct(list_filter(y, lambda w: not list_contains(x, w)))')} as only_y, {_joined('x')} as sx, {_joined('y')} as sy, {_masks('sh', 'lg')} as near, {_masks('lg', 'sh')} as back from fz_words),
fz_ends as (select *, trim(joint || ' ' || only_x) as ux, trim(joint || ' ' || only_y) as uy from fz_sets),
fz_parts as (select a, b, case when length(a) + length(b) = 0 then 1.0 else 2.0 * {_common('length(sh)', 'near')} / (length(a) + length(b)) end::double as ratio,
   case when length(sh) = 0 then case when length(lg) = 0 then 1.0 else 0.0 end else greatest({_windows_sql('sh', 'lg', 'near')},
     case when length(sh) = length(lg) then {_windows_sql('lg', 'sh', 'back')} else 0.0 end) end::double as partial,
   {_ratio_sql('sx', 'sy')} as ordered,
   case when len(x) = 0 or len(y) = 0 then 0.0 when joint <> '' and (only_x = '' or only_y = '') then 1.0
     else greatest({_ratio_sql('ux', 'uy')}, case when joint <> '' then 2.0 * length(joint) / (length(joint) + least(length(ux), length(uy))) else 0.0 end) end::double as sets
   from fz_ends),
fuzzy as (select p.source, p.target, round(0.2 * ratio + 0.2 * partial + 0.3 * ordered + 0.3 * sets, 6) as score
   from (select distinct source, target from {pairs}) p join fz_names s on s.name = p.source join fz_names t on t.name = p.target join fz_parts f on f.a = s.norm and f.b = t.norm)
"""


NAME_PAIRS = I.sql(I.NAME_PAIRS)
LEGACY = I.sql(I.LEGACY_COLUMNS)
MODERN = I.sql(I.MODERN_COLUMNS)
ON_PAIRS = f"""with typed as ({NAME_PAIRS}), pairs as (select distinct source, target from typed),
names as (select source as name from pairs union select target from pairs), {FEATURES}, {SCORED}"""
# names are distinct, so every pair can be compared
ON_CATALOGS = f"""with src as ({LEGACY}), tgt as ({MODERN}),
pairs as (select * from (select distinct column_name as source from src) cross join (select distinct column_name as target from tgt)),
names as (select column_name as name from src union select column_name from tgt), {FEATURES}, {SCORED}"""


def _scored(spark, sf):
    pairs = I.name_pairs(spark, sf)
    return match.score_name_pairs(pairs, match.name_features(pairs.select("source"), pairs.select("target")))


# --- profiling ------------------------------------------------------------------

SPECS_TABLES = ["customer", "orders", "lineitem", "nation", "region", "part", "supplier"]


def tables(spark, sf):
    return {n: I.table(spark, sf, n) for n in SPECS_TABLES}


def _catalog_sql() -> str:
    def one(t: str, at: int, c: str) -> str:
        spec = SPECS[t]
        ref = next((f"'{fk.ref_table}.{fk.ref_column}'" for fk in spec.foreign_keys if fk.column == c), "null")
        key, kind = c in spec.primary_key, f"typeof(any_value({c}))"
        return f"""select '{t}' as table_name, '{c}' as column_name, {at} as position, case {kind} when 'VARCHAR' then 'STRING' when 'INTEGER' then 'INT' when 'TIMESTAMP' then 'TIMESTAMP_NTZ' else {kind} end as data_type,
        {str(not key).lower()} as is_nullable, {str(key).lower()} as is_primary_key, {str(ref != "null").lower()} as is_foreign_key, {ref}::varchar as foreign_key_ref, null::varchar as default_value, null::integer as max_length, count(*) as row_count,
        (select string_agg(v, ' | ' order by v) from (select distinct cast({c} as varchar) as v from {t} where {c} is not null order by v limit 5)) as sample_values from {t}"""

    return " union all ".join(one(t, i, c) for t in SPECS_TABLES for i, c in enumerate(COLUMNS[t]))


@query("column_catalog", _catalog_sql())
def column_catalog(spark, sf):
    """Catalog of the tables with row counts and samples."""
    data = tables(spark, sf)
    catalog = profile.column_catalog(spark, data, SPECS, 5).join(profile.table_counts(data), "table_name")
    return catalog.withColumn("sample_values", F.array_join("sample_values", " | "))


@query("table_counts", " union all ".join(f"select '{n}' as table_name, count(*) as row_count from {n}" for n in SPECS_TABLES))
def table_counts(spark, sf):
    return profile.table_counts(tables(spark, sf))


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
SAMPLES = " union all ".join(f"select distinct '{c}' as column_name, cast({c} as varchar) as value from orders where {c} is not null" for c in ORDER_COLUMNS)


@query("sample_values", f"select column_name, value, rank from (select *, cast(row_number() over (partition by column_name order by value) as integer) as rank from ({SAMPLES})) where rank <= 5")
def sample_values(spark, sf):
    return profile.sample_values(I.table(spark, sf, "orders").select(*ORDER_COLUMNS))


@query(
    "schema_compare",
    f"""with s as (select distinct lower(column_name) as name from ({LEGACY})), t as (select distinct lower(column_name) as name from ({MODERN}))
    select name, 'common' as side from s where name in (from t) union all select name, 'source_only' from s where name not in (from t)
    union all select name, 'target_only' from t where name not in (from s)""",
)
def schema_compare(spark, sf):
    return profile.compare_names(I.legacy_columns(spark, sf), I.modern_columns(spark, sf), "column_name")


#: The text columns of the tables; the Spark side takes them from the schemas.
TEXT_COLUMNS = {
    "customer": ["c_name", "c_mktsegment"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "nation": ["n_name"],
    "region": ["r_name"],
    "part": ["p_name", "p_brand", "p_type"],
    "supplier": ["s_name"],
}


def _split_sql() -> str:
    long = " union all ".join(f"select '{c}' as column_name, {c} as value from {t}" for t, cs in TEXT_COLUMNS.items() for c in cs)
    hits = ", ".join(f"count(*) filter (contains(value, '{d}')) as h{i}, sum(len(string_split(value, '{d}'))) / count(*) as a{i}" for i, d in enumerate(L.SPLIT_DELIMITERS))
    rows = " union all ".join(f"select column_name, '{d}' as recommended_delimiter, h{i} as h, a{i} as a, {i} as i, n, example from stats" for i, d in enumerate(L.SPLIT_DELIMITERS))
    return f"""with long as ({long}), stats as (select column_name, count(*) as n, min(value) as example, {hits} from long where value is not null group by 1),
    o as ({rows}), r as (select *, row_number() over (partition by column_name order by h desc, i) as k from o where h > n * 0.5)
    select column_name, recommended_delimiter, round(a, 1) as average_parts, array_to_string(string_split(example, recommended_delimiter), '~') as sample from r where k = 1"""


@query("split_candidates", _split_sql())
def split_candidates(spark, sf):
    found = None
    for df in tables(spark, sf).values():
        each = profile.split_candidates(df, [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"])
        found = each if found is None else found.union(each)
    return found.withColumn("sample", F.array_join("sample", "~"))


def _merge_sql() -> str:
    rows = ", ".join(f"({i}, {lst(c.replace('_', '') for c in cols)}, {quote(t)}, {quote(m)})" for i, (cols, t, m) in enumerate(L.MERGE_PATTERNS))
    return f"""with c as (select table_name, {stripped_sql('column_name')} as column_name, min(position) as position from ({LEGACY}) group by 1, 2), flat as (select table_name, replace(lower(column_name), '_', '') as part, first(column_name order by position, column_name) as column_name from c group by 1, 2),
    p(i, parts, target, template) as (values {rows}),
    t as (select table_name, list(part) as have, map_from_entries(list((part, column_name))) as found from flat group by 1),
    r as (select *, row_number() over (partition by table_name order by i) as k from t join p on list_has_all(have, parts))
    select table_name, array_to_string(list_transform(parts, lambda x: list_extract(map_extract(found, x), 1)), ',') as source_columns,
    target as suggested_target, template as merge_template from r where k = 1"""


@query("merge_candidates", _merge_sql())
def merge_candidates(spark, sf):
    bare = I.legacy_columns(spark, sf).groupBy("table_name", N.strip_prefix(F.col("column_name")).alias("column_name")).agg(F.min("position").alias("position"))
    return profile.merge_candidates(bare).withColumn("source_columns", F.array_join("source_columns", ","))


# --- names ----------------------------------------------------------------------


@query("normalize_name_a", f"select table_name, column_name, {norm_a_sql('column_name')} as normalized from ({LEGACY})")
def normalize_name_a(spark, sf):
    return I.legacy_columns(spark, sf).select("table_name", "column_name", N.normalize_a(F.col("column_name")).alias("normalized"))


@query("normalize_name_b", f"select table_name, column_name, {norm_b_sql('column_name')} as normalized from ({LEGACY})")
def normalize_name_b(spark, sf):
    return I.legacy_columns(spark, sf).select("table_name", "column_name", N.normalize_b(F.col("column_name")).alias("normalized"))


@query("core_term", f"select table_name, column_name, {norm_b_sql(stripped_sql('column_name'))} as core from ({LEGACY})")
def core_term(spark, sf):
    return I.legacy_columns(spark, sf).select("table_name", "column_name", N.core_term(F.col("column_name")).alias("core"))


@query("fuzzy_score", f"""with met as (select distinct source, target from ({NAME_PAIRS})), {fuzzy_steps('met')} select source, target, score from fuzzy""")
def fuzzy_score(spark, sf):
    pairs = I.name_pairs(spark, sf).select("source", "target").distinct()
    return pairs.withColumn("score", F.round(S.fuzzy_score(N.normalize_a(F.col("source")), N.normalize_a(F.col("target"))), 6))


def _compat_sql() -> str:
    rows = ", ".join(f"({quote(a)}, {quote(b)})" for a, bs in L.TYPE_COMPATIBILITY.items() for b in bs)
    return f"""with compat(a, b) as (values {rows}), p as (select distinct source_type, target_type, trim(split_part(upper(source_type), '(', 1)) as s,
      trim(split_part(upper(target_type), '(', 1)) as t from ({NAME_PAIRS}))
    select source_type, target_type, case when s = t then 1.0 when (s, t) in (select (a, b) from compat) then 0.8
      when (t, s) in (select (a, b) from compat) then 0.6 else 0.2 end::double as score from p"""


@query("type_score", _compat_sql())
def type_score(spark, sf):
    pairs = I.name_pairs(spark, sf).select("source_type", "target_type").distinct()
    return pairs.withColumn("score", S.type_score(F.col("source_type"), F.col("target_type")))


TABLE_PAIRS = f"""src as ({LEGACY}), tgt as ({MODERN}),
tables as (select * from (select distinct table_name as source from src) cross join (select distinct table_name as target from tgt)), {fuzzy_steps('tables')},
related as (select source as source_table, target as target_table, score as similarity from fuzzy where score > 0.3)"""


@query("table_pairs", f"with {TABLE_PAIRS} select * from related")
def table_pairs(spark, sf):
    return match.table_pairs(I.legacy_columns(spark, sf), I.modern_columns(spark, sf))


@query("name_cosine", f"{ON_PAIRS} select source, target, cosine::double as cosine from scored")
def name_cosine(spark, sf):
    return _scored(spark, sf).select("source", "target", "cosine")


@query("ngram_cosine", f"{ON_PAIRS} select source, target, tfidf from scored")
def ngram_cosine(spark, sf):
    return _scored(spark, sf).select("source", "target", "tfidf")


@query("domain_score", f"{ON_PAIRS} select source, target, domain from scored")
def domain_score(spark, sf):
    return _scored(spark, sf).select("source", "target", "domain")


@query(
    "date_name_rule",
    f"""{ON_PAIRS} select source, target, case when s.base_word in ('modified', 'modify') and t.base_word in ('updated', 'update') then 0.92
      when regexp_replace(s.base_word, '[de]', '', 'g') = regexp_replace(t.base_word, '[de]', '', 'g') then 0.92
      when s.base_word is not distinct from t.base_word then 0.95 end::double as score
    from pairs join feat s on s.name = source join feat t on t.name = target where s.is_date and t.is_date""",
)
def date_name_rule(spark, sf):
    pairs = I.name_pairs(spark, sf).select("source", "target").distinct()
    s = N.with_name_features(pairs.select(F.col("source").alias("name")), "name").alias("s")
    t = N.with_name_features(pairs.select(F.col("target").alias("name")), "name").alias("t")
    joined = pairs.join(s, F.col("source") == F.col("s.name")).join(t, F.col("target") == F.col("t.name"))
    return joined.where(F.col("s.is_date") & F.col("t.is_date")).select("source", "target", S.date_rule().alias("score"))


# --- matching -------------------------------------------------------------------


def _by_name_sql() -> str:
    """All pairs of names are scored; the shared steps are renamed for columns."""
    fuzzy = fuzzy_steps("name_pairs").replace("fz_", "fc_").replace("fuzzy as", "column_fuzzy as")
    compat = ", ".join(f"({quote(a)}, {quote(b)})" for a, bs in L.TYPE_COMPATIBILITY.items() for b in bs)
    return f"""with {TABLE_PAIRS},
    name_pairs as (select * from (select distinct column_name as source from src) cross join (select distinct column_name as target from tgt)), {fuzzy},
    bag as (select name, unnest({tokens_sql('norm')}) as w from fc_names), counted as (select name, w, count(*) as n from bag group by 1, 2), sized as (select name, sum(n * n) as q from counted group by 1),
    dots as (select a.name as source, b.name as target, sum(a.n * b.n) as dot from counted a join counted b on a.w = b.w group by 1, 2),
    scores as (select f.source, f.target, score as syntactic, round(coalesce(dot / sqrt(x.q * y.q), 0.0)::double, 6) as semantic
      from column_fuzzy f left join dots d on d.source = f.source and d.target = f.target left join sized x on x.name = f.source left join sized y on y.name = f.target),
    compat(a, b) as (values {compat}),
    pairs_t as (select s.table_name as source_table, s.column_name as source_column, s.data_type as source_type, t.table_name as target_table, t.column_name as target_column, t.data_type as target_type, t.position,
      trim(split_part(upper(s.data_type), '(', 1)) as st, trim(split_part(upper(t.data_type), '(', 1)) as tt
      from src s cross join tgt t join related r on r.source_table = s.table_name and r.target_table = t.table_name),
    typed as (select *, case when st = tt then 1.0 when (st, tt) in (select (a, b) from compat) then 0.8 when (tt, st) in (select (a, b) from compat) then 0.6 else 0.2 end::double as type_score from pairs_t),
    whole as (select t.*, semantic, syntactic, floor((5 * round(semantic * 1000000)::bigint + 3 * round(syntactic * 1000000)::bigint + 2 * round(type_score * 1000000)::bigint + 5) / 10) / 1000000 as overall from typed t join scores c on c.source = t.source_column and c.target = t.target_column),
    best as (select *, row_number() over (partition by source_table, target_table, source_column order by overall desc, position, target_column) as k from whole where overall >= 0.4)
    select source_table, source_column, source_type, target_table, target_column, target_type, semantic, syntactic, type_score, overall,
      case when overall >= 0.85 then 'high' when overall >= 0.60 then 'medium' else 'low' end as confidence from best where k = 1"""


@query("match_columns_a", _by_name_sql())
def match_columns_a(spark, sf):
    found = match.match_by_name(I.legacy_columns(spark, sf), I.modern_columns(spark, sf))
    return found.drop("source_pk", "source_nullable", "target_pk", "target_nullable")


LOCAL_STEPS = """
local_rows as (select s.source, t.table_name as target_table, t.column_name as target, t.position, same_meaning, cosine, domain,
    round(0.5 * cosine + 0.2 * tfidf + 0.3 * domain, 6) as score
  from (select distinct column_name as source from src) s join scored using (source) join tgt t on t.column_name = scored.target),
local_best as (select *, row_number() over (partition by source, target_table order by score desc, position, target) as k from local_rows where score > 0.4),
proposed as (select source, target_table, target, round(score, 2)::double as confidence,
    case when same_meaning then '''' || source || ''' expands to same meaning as ''' || target || ''''
      when domain > 0.8 then '''' || source || ''' is an abbreviation for ''' || target || ''''
      when cosine > 0.7 then '''' || source || ''' is semantically similar to ''' || target || ''''
      else 'Pattern matching suggests ''' || source || ''' maps to ''' || target || '''' end as why_mapped
  from local_best where k = 1)
"""


@query("local_proposals", f"{ON_CATALOGS}, {LOCAL_STEPS} select * from proposed")
def local_proposals(spark, sf):
    source, target = I.legacy_columns(spark, sf), I.modern_columns(spark, sf)
    features = match.name_features(source.select("column_name"), target.select("column_name"))
    pairs = match.candidate_pairs(source, target, features, (match.LOCAL_MINIMUM, match.LOCAL_WEIGHTS))
    scored = stage(match.score_name_pairs(pairs, features), "name_scores")
    return match.local_proposals(source, target, scored)


@query(
    "uncertain_columns",
    f"""{ON_CATALOGS}, best as (select source, max(domain * 0.5 + tfidf * 0.5) as b from scored group by 1)
    select table_name, column_name from src join best on column_name = source where b < 0.70""",
)
def uncertain_columns(spark, sf):
    return match.uncertain_columns(I.legacy_columns(spark, sf), I.modern_columns(spark, sf))


MATCHED = f"""{ON_CATALOGS}, {LOCAL_STEPS},
rows_e as (select n.source, t.table_name as target_table, t.position, t.column_name as target, t.data_type as target_type, cosine, tfidf, domain, coalesce(confidence, 0.0) as p, q.why_mapped as hint
  from (select distinct column_name as source from src) n join scored using (source) join tgt t on t.column_name = scored.target
  left join proposed q on q.source = n.source and q.target_table = t.table_name and q.target = t.column_name),
rows_s as (select *, round(case when p >= 0.8 then (0.25 * cosine + 0.30 * p + 0.10 * tfidf + 0.35 * domain) * 0.3 + p * 0.7
   when p > 0 then (0.25 * cosine + 0.30 * p + 0.10 * tfidf + 0.35 * domain) * 0.5 + p * 0.5
   else 0.45 * cosine + 0.20 * tfidf + 0.35 * domain end, 6) as ensemble from rows_e),
best_e as (select *, row_number() over (partition by source order by ensemble desc, target_table, position, target) as k from rows_s where ensemble >= 0.6),
mappings as (select s.table_name as source_table, s.column_name as source_column, s.data_type as source_type, target_table, target as target_column, target_type,
   cosine, p as proposal, tfidf, domain, ensemble, case when ensemble >= 0.8 then 'high' when ensemble >= 0.6 then 'medium' else 'low' end as confidence_level,
   '1:1' as mapping_type, 'none' as transformation, '' as why_not_others,
   case when hint is not null then hint when domain > 0.8 then '''' || s.column_name || ''' is a common abbreviation for ''' || target || ''' in database systems'
     when cosine > 0.8 then '''' || s.column_name || ''' and ''' || target || ''' have very similar semantic meanings'
     when tfidf > 0.7 then '''' || s.column_name || ''' and ''' || target || ''' share similar naming patterns'
     else 'Multiple factors suggest ''' || s.column_name || ''' corresponds to ''' || target || '''' end as why_mapped
  from best_e join src s on s.column_name = source where k = 1)
"""


def reason_sql(source: str, target: str) -> str:
    """The short reason for a match, by the score that dominates."""
    return f"""case when domain > 0.8 then '''' || {source} || ''' is a common abbreviation for ''' || {target} || ''' in database systems'
     when cosine > 0.8 then '''' || {source} || ''' and ''' || {target} || ''' have very similar semantic meanings'
     when tfidf > 0.7 then '''' || {source} || ''' and ''' || {target} || ''' share similar naming patterns'
     else 'Multiple factors suggest ''' || {source} || ''' corresponds to ''' || {target} || '''' end"""


# the same with an outside proposer's answers, which tell tables apart
PROPOSED = f"""{ON_CATALOGS}, given as (select source_table, source_column, target_table, regexp_replace(lower(target_column), '[_-]', '', 'g') as loose, confidence::double as confidence,
   mapping_type, transformation, why_mapped, why_not_others from ({I.sql(I.PROPOSALS)})),
asked as (select g.*, t.column_name as target from given g join tgt t on t.table_name = g.target_table and regexp_replace(lower(t.column_name), '[_-]', '', 'g') = loose),
rows_e as (select s.table_name as source_table, s.column_name as source, s.data_type as source_type, t.table_name as target_table, t.position, t.column_name as target, t.data_type as target_type,
   cosine, tfidf, domain, coalesce(confidence, 0.0) as p, a.mapping_type, a.transformation, a.why_mapped, a.why_not_others
  from src s join scored on scored.source = s.column_name join tgt t on t.column_name = scored.target
  left join asked a on a.source_table = s.table_name and a.source_column = s.column_name and a.target_table = t.table_name and a.target = t.column_name),
rows_s as (select *, round(case when p >= 0.8 then (0.25 * cosine + 0.30 * p + 0.10 * tfidf + 0.35 * domain) * 0.3 + p * 0.7
   when p > 0 then (0.25 * cosine + 0.30 * p + 0.10 * tfidf + 0.35 * domain) * 0.5 + p * 0.5
   else 0.45 * cosine + 0.20 * tfidf + 0.35 * domain end, 6) as ensemble from rows_e),
best_e as (select *, row_number() over (partition by source_table, source order by ensemble desc, target_table, position, target) as k from rows_s where ensemble >= 0.6),
mappings as (select source_table, source as source_column, source_type, target_table, target as target_column, target_type, cosine, p as proposal, tfidf, domain, ensemble,
   case when ensemble >= 0.8 then 'high' else 'medium' end as confidence_level, coalesce(mapping_type, '1:1') as mapping_type, coalesce(transformation, 'none') as transformation,
   coalesce(why_mapped, {reason_sql('source', 'target')}) as why_mapped, coalesce(why_not_others, '') as why_not_others
  from best_e where k = 1)
"""


def proposed_mappings(spark, sf):
    return match.match_columns(I.legacy_columns(spark, sf), I.modern_columns(spark, sf), proposals=I.proposals(spark, sf))


@query("match_proposed", f"{PROPOSED} select * from mappings")
def match_proposed(spark, sf):
    """Mappings with an outside proposer's confidence, kind, transformation and reasons."""
    return proposed_mappings(spark, sf)


MET_TABLES = f"select distinct source_table, target_table from ({I.sql(I.PROPOSALS)})"
UNSURE = f"""{ON_CATALOGS}, asked_pairs as ({MET_TABLES}),
sure as (select distinct s.source, t.table_name as target_table from scored s join tgt t on t.column_name = s.target where domain * 0.5 + tfidf * 0.5 >= 0.70),
unsure as (select p.source_table, p.target_table, c.column_name, c.position from asked_pairs p join src c on c.table_name = p.source_table
   where not exists (select 1 from sure where sure.source = c.column_name and sure.target_table = p.target_table))"""


def met_tables(spark, sf):
    return I.proposals(spark, sf).select("source_table", "target_table").distinct()


@query("uncertain_by_tables", f"{UNSURE} select source_table, target_table, column_name from unsure")
def uncertain_by_tables(spark, sf):
    """What each pair of tables that meets in lineitem would ask about."""
    return match.uncertain_columns(I.legacy_columns(spark, sf), I.modern_columns(spark, sf), pairs=met_tables(spark, sf)).select("source_table", "target_table", "column_name")


@query(
    "ask_lists",
    f"""{UNSURE}, f as (select *, row_number() over (partition by source_table, target_table order by position, column_name) as k, count(*) over (partition by source_table, target_table) as n from unsure),
    t as (select table_name, column_name, row_number() over (partition by table_name order by position, column_name) as k from tgt),
    tl as (select table_name, string_agg(column_name, ',' order by k) as target_columns from t where k <= 10 group by 1)
    select source_table, target_table, max(n) as uncertain, string_agg(column_name, ',' order by k) as source_columns, any_value(target_columns) as target_columns
    from f join tl on tl.table_name = target_table where k <= 10 group by 1, 2""",
)
def ask_lists(spark, sf):
    asked = match.ask_lists(I.legacy_columns(spark, sf), I.modern_columns(spark, sf), met_tables(spark, sf))
    return asked.withColumns({c: F.array_join(c, ",") for c in ("source_columns", "target_columns")})


def mappings(spark, sf):
    return match.match_columns(I.legacy_columns(spark, sf), I.modern_columns(spark, sf))


@query("match_columns_b", f"{MATCHED} select source_table, source_column, target_table, target_column, cosine, proposal, tfidf, domain, ensemble, confidence_level from mappings")
def match_columns_b(spark, sf):
    return mappings(spark, sf).select("source_table", "source_column", "target_table", "target_column", "cosine", "proposal", "tfidf", "domain", "ensemble", "confidence_level")


# scores as they come: the share of the document's length in 10,000 characters, and of the quality labels
SCORES = "select doc_id, least(n_chars / 5000.0, 1.0) as score from documents"


def _document_scores(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("score"))


@query(
    "confidence_band",
    f"""select doc_id, case when score >= 0.85 then 'high' when score >= 0.60 then 'medium' when score >= 0.40 then 'low' else 'none' end as name_band,
    case when score >= 0.8 then 'high' when score >= 0.6 then 'medium' else 'low' end as ensemble_band from ({SCORES})""",
)
def confidence_band(spark, sf):
    return _document_scores(spark, sf).select("doc_id", S.name_band(F.col("score")).alias("name_band"), S.ensemble_band(F.col("score")).alias("ensemble_band"))


@query(
    "match_stats",
    f"""{MATCHED} select count(*) as total_mappings, count(*) filter (confidence_level = 'high') as high_confidence, count(*) filter (confidence_level = 'medium') as medium_confidence,
    count(*) filter (confidence_level = 'low') as low_confidence, round(avg(ensemble), 5) as average_score from mappings""",
)
def match_stats(spark, sf):
    return match.match_stats(mappings(spark, sf)).withColumn("average_score", F.round("average_score", 5))


UNMAPPED = """unmapped as (
  select 'source' as side, table_name, column_name,
    case when regexp_matches(lower(column_name), 'created|updated|modified|_at|_by') then 'This appears to be an audit/tracking column not present in target schema'
      when regexp_matches(lower(column_name), 'old_|legacy_|deprecated') then 'This appears to be a legacy column that has been retired'
      when regexp_matches(lower(column_name), 'temp_|tmp_|backup_') then 'This appears to be a temporary/backup column not needed in target'
      else 'No sufficiently similar column found in target schema' end as reason
  from src where not exists (select 1 from mappings m where m.source_table = table_name and m.source_column = column_name)
  union all select 'target', table_name, column_name,
    case when regexp_matches(lower(column_name), 'created|updated|modified|_at') then 'This is likely an auto-generated audit column'
      when lower(column_name) like '%id' then 'This appears to be a new identifier that will be auto-generated'
      else 'This is a new column in the target schema - may need default value or manual mapping' end
  from tgt where not exists (select 1 from mappings m where m.target_table = table_name and m.target_column = column_name))
"""


@query("unmapped_columns", f"{MATCHED}, {UNMAPPED} select * from unmapped")
def unmapped_columns(spark, sf):
    source, target = I.legacy_columns(spark, sf), I.modern_columns(spark, sf)
    return match.unmapped_columns(source, target, match.match_columns(source, target))


# pairs of columns that meet in lineitem, as if they had been mapped
MET_TEXT = f"""select distinct l.table_name as source_table, l.column_name as source_column, l.data_type as source_type, l.is_primary_key as source_pk, l.is_nullable as source_nullable,
    m.table_name as target_table, m.column_name as target_column, m.data_type as target_type, m.is_primary_key as target_pk, m.is_nullable as target_nullable
    from {{lineitem}} join ({I.LEGACY}) as l on l_partkey = p_partkey join ({I.MODERN}) as m on l_suppkey = s_suppkey"""

MET = I.sql(MET_TEXT)


MET_SIDE = ["table_name", "column_name", "data_type", "is_primary_key", "is_nullable"]


def met_pairs(spark, sf, rows: int = 250_000):
    """Different pairs ``(s, t)`` of numbers of columns that meet in lineitem, and the columns by number.

    Most pairs occur once, so they are dealt before they are told apart, ``rows`` lines to a partition.
    """
    (parts, sources), (suppliers, targets) = I.numbered(I.derived(spark, sf, I.LEGACY), "p_partkey", MET_SIDE), I.numbered(I.derived(spark, sf, I.MODERN), "s_suppkey", MET_SIDE)
    dealt = max(2, -(-I.table(spark, sf, "lineitem").count() // rows))
    pairs = I.met_numbers(spark, sf, parts, suppliers).repartition(dealt, "s", "t").distinct()
    names = [f"{{0}}_{c}" for c in ("table", "column", "type", "pk", "nullable")]

    def side(columns, name, key):
        return columns.toDF(*[n.format(name) for n in names], key)

    return pairs, side(sources, "source", "s"), side(targets, "target", "t")


def met(spark, sf, rows: int = 250_000):
    """MET_TEXT; lines are told apart by numbers of columns, and the columns are joined to the different ones."""
    pairs, sources, targets = met_pairs(spark, sf, rows)
    return pairs.join(sources, "s").join(targets, "t").drop("s", "t")


@query(
    "match_warnings",
    _compat_sql().split("select source_type, target_type, case")[0].replace("p as (select distinct source_type, target_type,", f"met as ({MET}), p as (select *,").replace(f"from ({NAME_PAIRS}))", "from met)")
    + """, w as (select *, case when s = t then 1.0 when (s, t) in (select (a, b) from compat) then 0.8 when (t, s) in (select (a, b) from compat) then 0.6 else 0.2 end as type_score from p)
    select source_table, source_column, target_table, target_column, source_type, target_type, array_to_string(list_filter([
      case when type_score < 0.6 then 'Type mismatch: ' || source_type || ' → ' || target_type end,
      case when source_pk and not target_pk then 'Source is PK but target is not' end,
      case when not source_nullable and target_nullable then 'Source is NOT NULL but target allows NULL' end], lambda x: x is not null), '; ') as warnings,
      source_pk, target_pk, source_nullable, target_nullable from w""",
)
def match_warnings(spark, sf):
    rows = met(spark, sf).withColumn("type_score", S.type_score(F.col("source_type"), F.col("target_type")))
    return match.match_warnings(rows).withColumn("warnings", F.array_join("warnings", "; ")).drop("type_score")


@query("mapping_search", f"{MATCHED} select source_table, source_column, target_table, target_column from mappings where (contains(lower(source_column), 'name') or contains(lower(target_column), 'name')) and confidence_level = 'high'")
def mapping_search(spark, sf):
    return match.search_mappings(mappings(spark, sf), "name", "high").select("source_table", "source_column", "target_table", "target_column")


def _kind_sql() -> str:
    num, text = "int|float|real|numeric|decimal|double|bool", "text|varchar|char|string"
    return f"""select source_table, source_column, target_table, target_column, source_type, target_type, source_pk, source_nullable, target_pk, target_nullable, case when s <> t and (regexp_matches(s, '{num}') <> regexp_matches(t, '{num}') or regexp_matches(s, '{text}') <> regexp_matches(t, '{text}')) then 'cast'
    when source_pk then 'transform' else 'direct' end as kind from (select *, lower(source_type) as s, lower(target_type) as t from ({MET}))"""


@query("mapping_kind", _kind_sql())
def mapping_kind(spark, sf):
    how = F.when(F.col("source_pk"), "split on blank").otherwise("none")
    return met(spark, sf).select(
        "source_table", "source_column", "target_table", "target_column", "source_type", "target_type", "source_pk", "source_nullable", "target_pk", "target_nullable",
        match.mapping_kind(F.col("source_type"), F.col("target_type"), how, F.lit("1:1")).alias("kind"),
    )


# --- types ----------------------------------------------------------------------


def norm_type_sql(c: str) -> str:
    base = rf"upper(trim(regexp_replace({c}, '\([^)]*\)', '', 'g')))"
    return f"coalesce({get_sql(L.TYPE_ALIASES, base)}, {base})"


@query("normalize_type", f"select table_name, column_name, data_type, {norm_type_sql('data_type')} as normalized from ({LEGACY})")
def normalize_type(spark, sf):
    return I.legacy_columns(spark, sf).select("table_name", "column_name", "data_type", TY.normalize_type(F.col("data_type")).alias("normalized"))


@query("type_size", rf"select table_name, column_name, data_type, try_cast(nullif(regexp_extract(data_type, '\((\d+)\)', 1), '') as integer) as size from ({LEGACY})")
def type_size(spark, sf):
    return I.legacy_columns(spark, sf).select("table_name", "column_name", "data_type", TY.declared_size(F.col("data_type")).alias("size"))


def conversion_sql(custom=()) -> str:
    rules = {(s, t): (k, d, "false") for s, t, k, d in L.CONVERSION_RULES} | {(s, t): (k, d, "true") for s, t, k, d in custom}
    rows = ", ".join(f"({quote(s)}, {quote(t)}, {quote(k)}, {quote(d)}, {c})" for (s, t), (k, d, c) in rules.items())
    size = r"try_cast(nullif(regexp_extract({}, '\((\d+)\)', 1), '') as integer)"
    return f"""with rules(a, b, kind, description, custom) as (values {rows}),
    p as (select distinct source_type, target_type, {norm_type_sql('source_type')} as s, {norm_type_sql('target_type')} as t,
       {size.format('source_type')} as ss, {size.format('target_type')} as ts from ({NAME_PAIRS})),
    j as (select *, kind is not null and not custom and ss > ts and ts > 0 as shrinks from p left join rules on a = s and b = t)
    select source_type, target_type, case when kind is not null then kind when s = t then 'direct' else 'custom' end as kind,
      case when kind is not null then description when s = t then 'Types are equivalent' else 'Unknown conversion: ' || s || ' → ' || t end as description,
      coalesce(kind = 'lossy' or shrinks, false) as potential_loss,
      case when shrinks then printf('Source size (%d) > target size (%d). Data may be truncated.', ss, ts)
        when kind is null and s <> t then 'Manual review recommended' end as warning from j"""



def _type_pairs(spark, sf):
    return I.name_pairs(spark, sf).select("source_type", "target_type").distinct()


@query("type_conversion", conversion_sql())
def type_conversion(spark, sf):
    return convert.conversions(_type_pairs(spark, sf), convert.conversion_rules(spark))


@query("custom_conversion", conversion_sql([("FLOAT", "DOUBLE", "explicit", "Rounded by hand")]))
def custom_conversion(spark, sf):
    return convert.conversions(_type_pairs(spark, sf), convert.conversion_rules(spark, [("FLOAT", "DOUBLE", "explicit", "Rounded by hand")]))
