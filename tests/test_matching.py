"""Names, types, pair scores and matching."""

import math

import pytest
from pyspark.sql import functions as F

from corroborate.functions import lexicon as L
from corroborate.functions import names as N
from corroborate.functions import similarity as S
from corroborate.functions import types as TY
from corroborate.operators import convert, match

CATALOG = "table_name string, column_name string, position int, data_type string, is_nullable boolean, is_primary_key boolean"
CUST = ["cust_id", "cust_fname", "cust_lname", "cust_email", "cust_ph", "cust_addr", "cust_city", "cust_state", "cust_zip", "cust_type", "cust_status", "created_dt", "modified_dt"]
CUSTOMERS = [
    "customer_id", "first_name", "last_name", "email_address", "phone_number", "street_address", "city", "state_code", "postal_code", "customer_type", "is_active",
    "created_at", "updated_at",
]


def catalog(spark, table, names):
    return spark.createDataFrame([(table, n, i, "TEXT", True, i == 0) for i, n in enumerate(names)], CATALOG)


def test_golden_name_pairs(spark):
    pairs = spark.createDataFrame([(a, b) for a, b, _ in L.KNOWN_PAIRS], "source string, target string")
    scored = match.score_name_pairs(pairs, match.name_features(pairs.select("source"), pairs.select("target")))
    got = {(r.source, r.target): r.domain for r in scored.collect()}
    assert got == {(a, b): v for a, b, v in L.KNOWN_PAIRS} and min(got.values()) >= 0.85


def test_normalizers(spark):
    df = spark.createDataFrame([("orderDt",), ("ord_dt",), ("ph_no",)], "n string")
    got = df.select(N.normalize_a(F.col("n")).alias("a"), N.normalize_b(F.col("n")).alias("b"), N.core_term(F.col("n")).alias("c")).collect()
    assert (got[0].a, got[0].b) == ("order date", "orderdt")
    assert (got[1].a, got[1].b, got[1].c) == ("order date", "order date", "date")
    assert (got[2].a, got[2].b, got[2].c) == ("phone number", "customer number", "number")


def test_fuzzy_golden():
    assert S.fuzzy("customer name", "customer name") == pytest.approx(1.0)
    assert S.fuzzy("name customer", "customer name") > 0.75
    assert S._indel("abcd", "abed") == pytest.approx(0.75)
    assert S._indel("", "") == 1.0
    assert S._partial("name", "customer name") == 1.0
    assert S._token_set("customer name", "customer name code") == 1.0
    assert S.fuzzy("abc", "xyz") == 0.0


def test_gram_cosine_matches_definition(spark):
    def grams(text):
        out = []
        for word in text.split():
            w = f" {word} "
            out += [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
        return out

    names = ["order_total", "total orders", "x", "customer", "customers customers"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "source string, target string")
    scored = match.score_name_pairs(pairs, match.name_features(pairs.select("source"), pairs.select("target")))
    for r in scored.collect():
        a, b = (grams({"order_total": "order total"}.get(x, x)) for x in (r.source, r.target))
        weight = {g: 1.0 if g in a and g in b else 1 + math.log(1.5) for g in a + b}
        va, vb = ({g: x.count(g) * weight[g] for g in x} for x in (a, b))
        dot = sum(va[g] * vb.get(g, 0) for g in va)
        want = dot / math.sqrt(sum(v * v for v in va.values()) * sum(v * v for v in vb.values()))
        assert r.tfidf == pytest.approx(min(1, want), abs=2e-6)


def test_types(spark):
    df = spark.createDataFrame(
        [("INTEGER", "BIGINT"), ("VARCHAR(100)", "VARCHAR(50)"), ("DATETIME", "DATE"), ("TEXT", "JSON"), ("BIGINT", "INTEGER"), ("FLOAT", "DECIMAL(10,2)")],
        "source_type string, target_type string",
    )
    got = {(r.source_type, r.target_type): r for r in convert.conversions(df, convert.conversion_rules(spark)).collect()}
    assert {k: v.kind for k, v in got.items()} == {
        ("INTEGER", "BIGINT"): "implicit", ("VARCHAR(100)", "VARCHAR(50)"): "direct", ("DATETIME", "DATE"): "lossy", ("TEXT", "JSON"): "explicit",
        ("BIGINT", "INTEGER"): "lossy", ("FLOAT", "DECIMAL(10,2)"): "custom",
    }
    assert got[("VARCHAR(100)", "VARCHAR(50)")].potential_loss and "100" in got[("VARCHAR(100)", "VARCHAR(50)")].warning
    assert got[("FLOAT", "DECIMAL(10,2)")].warning == "Manual review recommended"
    sizes = spark.createDataFrame([("VARCHAR(255)",), ("DECIMAL(10,2)",), ("TEXT",)], "t string").select(TY.declared_size(F.col("t")).alias("s")).collect()
    assert [r.s for r in sizes] == [255, None, None]


def test_candidates_lose_no_match(spark):
    """Prefix-filtered candidates hold every pair that reaches the threshold."""
    source, target = catalog(spark, "cust", CUST + ["ord_total", "x", "id", "notes"]), catalog(spark, "customers", CUSTOMERS + ["total", "note", "y_id"])
    features = match.name_features(match._names(source), match._names(target))
    every = match._names(source).withColumnRenamed("name", "source").crossJoin(match._names(target).withColumnRenamed("name", "target"))
    for threshold, weights in ((0.5, match.PLAIN_WEIGHTS), (0.4, match.LOCAL_WEIGHTS), (0.6, match.PLAIN_WEIGHTS), (0.35, match.PLAIN_WEIGHTS), (0.3, match.PLAIN_WEIGHTS), (0.2, match.LOCAL_WEIGHTS), (0.05, match.PLAIN_WEIGHTS), (0.0, match.LOCAL_WEIGHTS)):
        scored = match.score_name_pairs(every, features).where(match._blend(weights) >= threshold)
        want = {(r.source, r.target) for r in scored.collect()}
        have = {(r.source, r.target) for r in match.candidate_pairs(source, target, features, (threshold, weights)).collect()}
        assert want and want <= have


def test_matching_end_to_end(spark):
    source, target = catalog(spark, "cust", CUST), catalog(spark, "customers", CUSTOMERS)
    got = {r.source_column: r.target_column for r in match.match_columns(source, target, threshold=0.4, use_local=False).collect()}
    right = sum(got.get(a) == b for a, b in zip(CUST, CUSTOMERS))
    assert right >= 8
    given = spark.createDataFrame(
        [("cust", "cust_status", "customers", "Is-Active", 0.95)], "source_table string, source_column string, target_table string, target_column string, confidence double"
    )
    proposed = {r.source_column: r for r in match.match_columns(source, target, proposals=given).collect()}
    assert proposed["cust_status"].target_column == "is_active" and proposed["cust_status"].confidence_level == "high"
    loose = match.unmapped_columns(source, target, match.match_columns(source, target, proposals=given))
    assert loose.where("side = 'source' and column_name = 'cust_status'").count() == 0


def test_proposals_speak_for_their_mapping(spark):
    source, target = catalog(spark, "cust", ["cust_status", "cust_city", "full"]), catalog(spark, "customers", ["is_active", "city", "name_parts"])
    rows = [
        ("cust", "cust_status", "customers", "Is-Active", 0.95, "N:1", "merge", "said so", "nothing else"),
        ("cust", "cust_status", "customers", "is_active", 0.70, "1:N", "split", "less sure", None),
        ("cust", "full", "customers", "name_parts", 0.9, None, "split on blank", None, None),
        ("other", "cust_city", "customers", "name_parts", 0.99, "1:N", "x", "of another table", None),
    ]
    given = spark.createDataFrame(rows, "source_table string, source_column string, target_table string, target_column string, confidence double, mapping_type string, transformation string, why_mapped string, why_not_others string")
    got = {r.source_column: r for r in match.match_columns(source, target, proposals=given).collect()}
    said = got["cust_status"]
    assert (said.target_column, said.mapping_type, said.transformation, said.why_mapped, said.why_not_others) == ("is_active", "N:1", "merge", "said so", "nothing else")
    assert (got["full"].target_column, got["full"].mapping_type, got["full"].transformation) == ("name_parts", "1:1", "split on blank")
    assert got["cust_city"].target_column == "city" and got["cust_city"].why_not_others == "" and "city" in got["cust_city"].why_mapped


def test_each_pair_of_tables_asks_for_its_own_columns(spark):
    source = catalog(spark, "cust", ["cust_city", *[f"odd{k}" for k in range(12)]])
    target = catalog(spark, "a", ["city"]).union(catalog(spark, "b", [f"thing_{k}" for k in range(11)]))
    pairs = spark.createDataFrame([("cust", "a"), ("cust", "b")], "source_table string, target_table string")
    asked = {(r.target_table, r.column_name) for r in match.uncertain_columns(source, target, pairs=pairs).collect()}
    assert ("a", "cust_city") not in asked and ("b", "cust_city") in asked and len(asked) == 12 + 13
    lists = {r.target_table: r for r in match.ask_lists(source, target, pairs).collect()}
    assert lists["a"].source_columns == [f"odd{k}" for k in range(10)] and lists["a"].target_columns == ["city"] and lists["a"].uncertain == 12
    assert lists["b"].source_columns[0] == "cust_city" and lists["b"].target_columns == [f"thing_{k}" for k in range(10)] and lists["b"].uncertain == 13


def test_fuzzy_batches_equal_the_scalar_score(spark):
    words = ["customer", "order", "id", "a", "é", "total", "", "first name"]
    pairs = [(" ".join(words[(k * 7 + i) % 8] for i in range(k % 4)).strip(), " ".join(words[(k * 3 + 2 * i) % 8] for i in range(k % 3)).strip()) for k in range(200)] + [("x" * 80, "x" * 70 + " y"), ("abc", "bca")]
    got = S.fuzzy_scores(*zip(*pairs, strict=True))
    assert all(abs(g - S.fuzzy(a, b)) < 1e-12 for g, (a, b) in zip(got, pairs, strict=True))
    rows = spark.createDataFrame([*pairs, (None, "a")], "a string, b string").select("a", "b", S.fuzzy_score("a", "b").alias("f"), S.fuzzy_bound(F.col("a"), F.col("b")).alias("most")).collect()
    for r in rows:
        assert (r.f is None) == (r.a is None)
        if r.a is not None and not set(r.a.split()) & set(r.b.split()):
            assert r.f <= r.most + 1e-9


def test_name_matcher_misses_no_pair(spark):
    """Bounded candidates hold every pair that all pairs of names would give."""
    source, target = catalog(spark, "customer_old", [*CUST, "orderTotal", "x", "ph"]), catalog(spark, "customers", [*CUSTOMERS, "total_order", "y", "phase"])
    for threshold in (0.2, 0.4, 0.55):
        got = {(r.source_column, r.target_column): r.overall for r in match.match_by_name(source, target, threshold).collect()}
        a, b = (match._worded(c, "column_name") for c in (source, target))
        every = match._scored_names(a, b, match._all_pairs(a, b)).collect()
        best = {}
        for r in every:
            overall = 0.5 * r.semantic + 0.3 * r.syntactic + 0.2
            if overall >= threshold - 1e-6:
                best[r.source] = max(best.get(r.source, 0), overall)
        assert {s for s, _ in got} == set(best) and all(abs(best[s] - v) < 1e-5 for (s, _), v in got.items())


def test_name_matcher(spark):
    source, target = catalog(spark, "customer_old", CUST), catalog(spark, "customers", CUSTOMERS)
    got = {r.source_column: r.target_column for r in match.match_by_name(source, target).collect()}
    assert got["cust_id"] == "customer_id" and got["cust_city"] == "city" and got["cust_type"] == "customer_type"


def test_search_and_kind(spark):
    rows = spark.createDataFrame([("a_name", "b", "high"), ("c", "d", "low")], "source_column string, target_column string, confidence_level string")
    assert match.search_mappings(rows, "NAME").count() == 1 and match.search_mappings(rows, "", "low").count() == 1
    kinds = spark.createDataFrame([("TEXT", "INTEGER", "none"), ("TEXT", "VARCHAR(5)", "split"), ("TEXT", "TEXT", "none")], "s string, t string, h string")
    got = [r.k for r in kinds.select(match.mapping_kind(F.col("s"), F.col("t"), F.col("h"), F.lit("1:1")).alias("k")).collect()]
    assert got == ["cast", "transform", "direct"]


def test_dictionary_file(spark, tmp_path):
    path = tmp_path / "more.csv"
    path.write_text("short,long,score\nzz,zebra,\nzz_no,zebra_number,0.97\n")
    d = N.Dictionary.read(spark, str(path))
    assert d.abbreviations["zz"] == "zebra" and ("zz_no", "zebra_number", 0.97) in d.known_pairs and len(d.abbreviations) > 100


def test_proposals_are_decided_without_all_rows_of_a_name(spark):
    """A column looks at the offers to its name and its own proposals; the result is that of all rows."""
    source = catalog(spark, "old_0", ["cust_id", "cust_email", "qty"])
    for i in range(1, 8):
        source = source.union(catalog(spark, f"old_{i}", ["cust_id", "cust_email", "qty"]))
    target = catalog(spark, "a", ["customer_id", "email", "quantity"]).union(catalog(spark, "b", ["customer_id", "email_address", "id"])).union(catalog(spark, "b", ["customer_id"]))
    rows = [("old_1", "cust_id", "a", "customer_id", 0.1), ("old_2", "cust_id", "a", "customer_id", 0.05), ("old_2", "cust_id", "b", "customer_id", 0.1), ("old_3", "cust_email", "b", "id", 0.99),
            ("old_4", "cust_id", "a", "customer_id", 0.0), ("old_4", "cust_id", "b", "id", None), ("none", "cust_id", "a", "customer_id", 0.99), ("old_5", "cust_email", "b", "email_address", 0.2)]
    hints = spark.createDataFrame(rows, "source_table string, source string, target_table string, target string, p double")
    said = [F.lit("said" if c == "why_mapped" else None).cast("string").alias(c) for c in match.SAID]
    hints = hints.select("source_table", "source", "target_table", "target", F.struct("p", *said).alias("hint"))
    names = source.select(F.col("column_name").alias("source")).distinct()
    t = target.select(F.col("table_name").alias("target_table"), F.col("column_name").alias("target"), "position", F.col("data_type").alias("target_type"))
    pairs = names.crossJoin(t.select("target").distinct())
    scored = match.stage(match.score_name_pairs(pairs, match.name_features(names, t.select("target"))), "scored")
    for accept in (0.05, 0.6):
        got = match._best_told_apart(source, names, scored, t, hints, accept)
        every = source.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source")).join(scored, "source").join(t, "target")
        every = match._offers(every.join(hints, ["source_table", "source", "target_table", "target"], "left"), accept)
        want = every.groupBy("source_table", "source").agg(F.min("offer").alias("b"))
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
        assert got.count() > (20 if accept < 0.1 else 8)


def test_proposals_are_counted_by_numbers_of_columns(spark, sf):
    """The rows of the text, though lineitem never carries a name through a shuffle."""
    from queries import inputs as I

    got = I.proposals(spark, "/root/testdata/sf0.01")
    want = I.derived(spark, "/root/testdata/sf0.01", I.PROPOSALS)
    want = want.withColumn("confidence", want.confidence.cast("double"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0
    wide = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in line and "count(" in line]
    assert wide and not any("table_name" in line for line in wide)


def test_best_targets_are_found_per_name_and_type(spark):
    """A hundred tables with the same columns cost the types' scores of one; lists of targets leave last."""
    one = catalog(spark, "order_0", ["order_id", "order_date", "note"])
    many = spark.range(100).crossJoin(one.drop("table_name")).withColumn("table_name", F.format_string("order_%d", "id")).select(*one.columns)
    target = catalog(spark, "orders_new", ["order_id", "order_dt", "customer"]).union(catalog(spark, "order_rows", ["order_id", "notes"]))
    found = match.match_by_name(many, target)
    single = match.match_by_name(one, target).drop("source_table").distinct()
    assert found.count() == 100 * single.count() > 200
    assert sorted(map(str, found.drop("source_table").distinct().collect())) == sorted(map(str, single.collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # all that is left to do is to hand out staged lists: no score is computed per column and target table
    assert "found" in plan and "min(" not in plan


def test_names_and_types_of_met_pairs_are_compared_once(spark, sf):
    from queries.reports import judged

    rows = judged(spark, sf)
    assert "levenshtein" not in rows._jdf.queryExecution().optimizedPlan().toString()
    keys = ["source_table", "source_column", "target_table", "target_column"]
    assert rows.count() == rows.select(*keys, "source_type", "target_type", "source_pk", "target_pk", "source_nullable", "target_nullable").distinct().count() > 0
    assert rows.where("overall is null or semantic is null or type_score is null").isEmpty() and rows.columns[-4:] == ["semantic", "syntactic", "type_score", "overall"]
