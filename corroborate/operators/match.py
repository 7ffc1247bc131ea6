"""Column matching across catalogs.

A catalog has ``table_name, column_name, position, data_type`` and key flags.
Scores depend on names and types only, so they are computed once per distinct
pair of names and joined back to the columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions import similarity as S
from corroborate.functions.literals import literal_map
from corroborate.functions.names import Dictionary, normalize_a, with_name_features
from corroborate.functions.text import tokens
from corroborate.session import small, spread, stage

DIGITS = 6


def name_features(*names: DataFrame, dictionary: Dictionary | None = None, embedder=None) -> DataFrame:
    """Features of all distinct names of one-column frames, staged: every score reads them."""
    every = reduce(DataFrame.union, [n.toDF("name") for n in names]).distinct()
    features = with_name_features(spread(every), "name", dictionary)
    if embedder is not None:
        features = features.withColumn("vector", embedder("norm"))
    return stage(features, "name_features")


def score_name_pairs(pairs: DataFrame, features: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """Distinct ``(source, target)`` with cosine, n-gram and domain scores.

    The cosine is that of ``features.vector`` if there, else of the token bags.
    """
    d = dictionary or Dictionary()
    if "vector" in features.columns:
        cosine = S.vector_cosine(F.col("s.vector"), F.col("t.vector"))
    else:
        cosine = S.token_cosine(F.col("s.tokens"), F.col("t.tokens"))
    # the pairs must stay the streamed side, or scoring would run where the features lie
    features = small(features)
    s, t = features.alias("s"), features.alias("t")
    distinct = spread(pairs.select("source", "target").distinct())
    joined = distinct.join(s, F.col("source") == F.col("s.name")).join(t, F.col("target") == F.col("t.name"))
    grams = S.gram_cosine(F.col("s.grams"), F.col("s.gram_counts"), F.col("t.grams"), F.col("t.gram_counts"))
    return joined.select(
        "source",
        "target",
        F.round(F.coalesce(cosine, F.lit(0.0)), DIGITS).alias("cosine"),
        F.round(grams, DIGITS).alias("tfidf"),
        F.round(S.domain_score(d.known_pairs), DIGITS).alias("domain"),
        (F.col("s.norm") == F.col("t.norm")).alias("same_meaning"),
    )


#: What a gram in one name alone weighs more than one in both, squared (see similarity.gram_cosine).
GRAM_PENALTY = S.UNSHARED_IDF**2


def _share(theta: float, penalty: float) -> float:
    """Least share of a name's weight that lies on common keys, if the cosine is ``theta``."""
    return theta**2 * penalty / (1 + theta**2 * (penalty - 1))


@dataclass(frozen=True)
class _Index:
    """Keys of names of one kind, tokens or n-grams, and the cosine that pairs met by them must have."""

    counts: str
    theta: float
    penalty: float = 1.0


def _met(named: DataFrame, *kinds: _Index) -> DataFrame:
    """Pairs of names that may have the cosine of one of the kinds: they meet at a rare key with enough weight from there on.

    An inverted index holds every name under its rarest keys, until the rest is
    too light to reach theta: two names whose cosine is at least theta share a
    key among these (prefix filtering for all-pairs similarity), so frequent
    keys are hardly ever joined. All common keys of a pair lie at or after its
    rarest one, so there the shares a and b of both names' weights from the key
    on bound the cosine: f(a) f(b) >= theta squared, f(a) = a / (penalty -
    (penalty - 1) a). This filters by position and, as the shares of a long and
    a short name differ, by length.
    """
    kinds = [k for k in kinds if k.theta <= 1]
    if not kinds:
        return named.select(F.col("name").alias("source"), F.col("name").alias("target")).limit(0)

    def per_kind(values: list[float]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("kind") + 1)

    def listed(kind: int, counts: str) -> Column:
        return F.transform(F.map_entries(counts), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("key"), e["value"].alias("n")))

    lists = [listed(k, x.counts) for k, x in enumerate(kinds)]
    each = named.select("name", "sides", F.explode(F.concat(*lists)).alias("e")).select("name", "sides", "e.kind", "e.key", "e.n")
    frequency = each.groupBy("kind", "key").agg(F.count("*").alias("df"), F.bit_or("sides").alias("seen")).where("seen = 3")
    weight = F.col("n") * F.col("n")
    # keys of one side alone still weigh; they come last, since nothing meets there
    ranked = each.join(frequency.drop("seen"), ["kind", "key"], "left")
    whole = Window.partitionBy("name", "kind")
    onwards = whole.orderBy(F.asc_nulls_last("df"), "key").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    apart = F.sum(F.when(F.col("df").isNull(), weight).otherwise(0)).over(whole)
    rest = (F.sum(weight).over(onwards) - apart) / F.sum(weight).over(whole)
    postings = ranked.withColumn("rest", rest).where(F.col("df").isNotNull() & (F.col("rest") >= per_kind([_share(k.theta, k.penalty) for k in kinds]) - 1e-9))
    s = postings.where(F.col("sides").bitwiseAND(1) > 0).select(F.col("name").alias("source"), "kind", "key", F.col("rest").alias("a"))
    t = postings.where(F.col("sides").bitwiseAND(2) > 0).select(F.col("name").alias("target"), "kind", "key", F.col("rest").alias("b"))
    penalty = per_kind([k.penalty for k in kinds])
    bound = lambda c: F.col(c) / (penalty - (penalty - 1) * F.col(c))
    return s.join(t, ["kind", "key"]).where(bound("a") * bound("b") >= per_kind([k.theta**2 for k in kinds]) - 1e-9).select("source", "target")


def _names(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.col("column_name").alias("name")).distinct()


def _sided(source: DataFrame, target: DataFrame, features: DataFrame) -> DataFrame:
    """The features with ``sides``: 1 for a source column's name, 2 for a target's, 3 for both."""
    names = _names(source).withColumn("side", F.lit(1)).union(_names(target).withColumn("side", F.lit(2)))
    return features.join(names.groupBy("name").agg(F.bit_or("side").alias("sides")), "name")


def _meeting(s: DataFrame, t: DataFrame, left: Column, right: Column) -> DataFrame:
    """Pairs of names with an equal key on both sides; a null key meets none."""
    a = s.select(F.col("name").alias("source"), left.alias("key"))
    b = t.select(F.col("name").alias("target"), right.alias("key"))
    return a.join(b, "key").select("source", "target")


def _all_pairs(s: DataFrame, t: DataFrame, lanes: int = 64) -> DataFrame:
    """Every pair of names, for thresholds that all of them reach; dealt into lanes."""
    return _meeting(s, t, F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))), F.pmod(F.xxhash64("name"), F.lit(lanes)).cast("int"))


def _rule_keys(d: Dictionary, rules: set[str]) -> tuple[Column, Column]:
    """What a source and a target name are joined by, an array of tagged keys a side: one tag per rule of the domain score.

    Known pair, equal meaning, equal core and the expansions are always there;
    ``rules`` adds shared words, groups and base words of dates.
    """
    known = literal_map(_listed(d.known_pairs), "array<string>")

    def tagged(tag: str, key: Column) -> Column:
        return F.concat(F.lit(tag), key)

    def each(tag: str, keys: Column) -> Column:
        return F.transform(keys, lambda x: F.concat(F.lit(tag), x))

    def flat(c: str) -> Column:
        return F.replace(F.col(c), F.lit("_"), F.lit(""))

    def spaced(c: str) -> Column:
        return F.replace(F.col(c), F.lit("_"), F.lit(" "))

    norm, core = tagged("n:", F.col("norm")), tagged("c:", F.col("core"))
    nothing = F.array().cast("array<string>")
    left = [
        F.coalesce(each("l:", F.try_element_at(known, F.col("low"))), nothing),
        F.array(norm, core, tagged("n:", F.col("expansion")), tagged("f:", flat("expansion")), tagged("f:", flat("stripped_expansion")), tagged("s:", spaced("stripped_expansion"))),
    ]
    right = [F.array(tagged("l:", F.col("low")), norm, core, tagged("f:", flat("low")), tagged("s:", spaced("low")))]
    if "word" in rules:
        left.append(each("w:", F.col("open_words")))
        right.append(each("w:", F.col("name_words")))
    if "group" in rules:
        left.append(each("g:", F.col("groups")))
        right.append(each("g:", F.col("groups")))
    if "date" in rules:
        base = F.when(F.col("is_date"), F.coalesce(F.regexp_replace(F.regexp_replace("base_word", "^modif.*", "updated"), "[de]", ""), F.lit("-")))
        left.append(F.array(tagged("d:", base)))
        right.append(F.array(tagged("d:", base)))
    return F.explode(F.array_compact(F.array_distinct(F.concat(*left)))), F.explode(F.array_compact(F.array_distinct(F.concat(*right))))


def _listed(pairs) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for a, b, _ in pairs:
        out.setdefault(a, []).append(b)
    return out


#: Highest scores of the domain rules that are no equalities: word overlap, dates, groups.
OVERLAP_MOST, DATE_MOST, GROUP_MOST = 1.0, 0.95, 0.88


def candidate_pairs(source: DataFrame, target: DataFrame, features: DataFrame, *demands: tuple[float, tuple[float, float, float]], dictionary: Dictionary | None = None) -> DataFrame:
    """Distinct name pairs that can meet one of the demands; no other pair can.

    A demand is a threshold with the weights of cosine, n-grams and domain, of
    any size. Each rule of the domain score has keys of its own in one equality
    join: pairs of the rules of equality are all candidates. Where a rule's highest score leaves
    something to reach, the pair has a large enough token cosine or a large
    enough n-gram cosine, and is found through shared rare keys; where it leaves
    nothing, all pairs of the rule are joined on its key, and the index serves
    pairs that no rule knows. Holds for the token-bag cosine; with dense vectors
    give the pairs yourself.
    """
    cosine = gram = 2.0
    whole = set()
    for threshold, (w_cos, w_gram, w_domain) in demands:
        for rule, most in (("word", OVERLAP_MOST), ("date", DATE_MOST), ("group", GROUP_MOST)):
            need = threshold - w_domain * most
            if need <= 0:
                whole.add(rule)
            else:
                cosine, gram = min(cosine, need / 2 / w_cos), min(gram, need / 2 / w_gram)
        cosine, gram = min(cosine, threshold / 2 / w_cos), min(gram, threshold / 2 / w_gram)
        if threshold <= 0:
            whole.add("all")
    named = _sided(source, target, features)
    s, t = (named.where(F.col("sides").bitwiseAND(side) > 0) for side in (1, 2))
    if "all" in whole:
        return _all_pairs(s, t)
    left, right = _rule_keys(dictionary or Dictionary(), whole)
    met = _met(named, _Index("token_counts", cosine), _Index("gram_counts", gram, GRAM_PENALTY))
    return _meeting(s, t, left, right).union(met).distinct()


LOCAL_WEIGHTS = (0.5, 0.2, 0.3)
PLAIN_WEIGHTS = (0.45, 0.20, 0.35)
LOCAL_MINIMUM = 0.4


#: What a proposal may say about its mapping besides its confidence.
SAID = ["mapping_type", "transformation", "why_mapped", "why_not_others"]


def _least_local(accept: float) -> float:
    """No pair whose local score is below this has an ensemble score of ``accept``.

    With local score q and domain score d, a proposed pair (p = q) scores
    0.94 q + 0.06 d from 0.8 on and 0.9 q + 0.1 d below, another one at most
    q + 0.05 d; half a hundredth is what rounding p may add.
    """
    return min((accept - 0.1) / 0.9, accept - 0.05) - 0.006


def _blend(weights: tuple[float, float, float]) -> Column:
    return weights[0] * F.col("cosine") + weights[1] * F.col("tfidf") + weights[2] * F.col("domain")


def local_proposals(source: DataFrame, target: DataFrame, scored: DataFrame, minimum: float = LOCAL_MINIMUM) -> DataFrame:
    """Best target column per source name and target table, if it scores above ``minimum``.

    Proposals depend on the source column's name only, so they carry no source
    table; join on the name.
    """
    s = source.select(F.col("column_name").alias("source")).distinct()
    t = target.select(F.col("table_name").alias("target_table"), F.col("column_name").alias("target"), "position")
    score = F.round(_blend(LOCAL_WEIGHTS), DIGITS)
    rows = s.join(scored, "source").withColumn("score", score).where(F.col("score") > minimum).join(t, "target")
    best = F.min(F.struct((-F.col("score")).alias("order"), "position", "target", "cosine", "domain", "same_meaning"))
    picked = rows.groupBy("source", "target_table").agg(best.alias("b"))
    quote = "'%s' "
    reason = (
        F.when(F.col("b.same_meaning"), F.format_string(quote + "expands to same meaning as '%s'", "source", "b.target"))
        .when(F.col("b.domain") > 0.8, F.format_string(quote + "is an abbreviation for '%s'", "source", "b.target"))
        .when(F.col("b.cosine") > 0.7, F.format_string(quote + "is semantically similar to '%s'", "source", "b.target"))
        .otherwise(F.format_string("Pattern matching suggests '%s' maps to '%s'", "source", "b.target"))
    )
    return picked.select("source", "target_table", F.col("b.target").alias("target"), F.round(-F.col("b.order"), 2).alias("confidence"), reason.alias("why_mapped"))


def _sure_pairs(source: DataFrame, target: DataFrame, known: float, dictionary: Dictionary | None) -> DataFrame:
    """Pairs of names whose half-and-half local score reaches ``known``; such a pair has an n-gram cosine of at least 2·known − 1, so only those are scored."""
    features = name_features(_names(source), _names(target), dictionary=dictionary)
    if known > 0.5:
        pairs = _met(_sided(source, target, features), _Index("gram_counts", 2 * known - 1, GRAM_PENALTY)).distinct()
    else:
        pairs = candidate_pairs(source, target, features, (known, (1e-9, 0.5, 0.5)), dictionary=dictionary)
    scored = score_name_pairs(pairs, features, dictionary)
    return scored.where(F.col("domain") * 0.5 + F.col("tfidf") * 0.5 >= known).select("source", "target")


def uncertain_columns(source: DataFrame, target: DataFrame, known: float = 0.70, dictionary: Dictionary | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Source columns whose best half-and-half local score is below ``known``: those to ask about.

    With ``pairs(source_table, target_table)`` each pair of tables decides for
    itself, from the columns of its target table alone, and rows carry both
    tables and the column's position.
    """
    sure = _sure_pairs(source, target, known, dictionary)
    if pairs is None:
        return source.select("table_name", "column_name").join(sure.select(F.col("source").alias("column_name")).distinct(), "column_name", "left_anti")
    in_table = target.select(F.col("table_name").alias("target_table"), F.col("column_name").alias("target"))
    known_in = sure.join(in_table, "target").select(F.col("source").alias("column_name"), "target_table").distinct()
    columns = source.select(F.col("table_name").alias("source_table"), "column_name", "position")
    return pairs.select("source_table", "target_table").distinct().join(columns, "source_table").join(known_in, ["column_name", "target_table"], "left_anti")


def ask_lists(source: DataFrame, target: DataFrame, pairs: DataFrame, known: float = 0.70, most: int = 10, dictionary: Dictionary | None = None) -> DataFrame:
    """What an outside proposer is asked, a row per pair of tables with uncertain columns.

    ``(source_table, target_table, uncertain, source_columns, target_columns)``:
    how many columns are uncertain, the first ``most`` of them by position, and
    the first ``most`` columns of the target table. The answers are the
    ``proposals`` of :func:`match_columns`.
    """

    def first(rows: DataFrame, *keys: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("position", "column_name"))
        best = rows.withColumn("_rank", rank).where(F.col("_rank") <= most)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "column_name"))), lambda x: x["column_name"])
        return best.groupBy(*keys).agg(listed.alias("listed"))

    asked = uncertain_columns(source, target, known, dictionary, pairs)
    keys = ["source_table", "target_table"]
    counted = asked.groupBy(*keys).agg(F.count("*").alias("uncertain"))
    of_target = first(target.withColumnRenamed("table_name", "target_table"), "target_table").withColumnRenamed("listed", "target_columns")
    return counted.join(first(asked, *keys).withColumnRenamed("listed", "source_columns"), keys).join(of_target, "target_table").select(*keys, "uncertain", "source_columns", "target_columns")


def ensemble(p: Column) -> Column:
    """Weighted score; ``p`` is the proposal's confidence, 0 when not proposed."""
    base = 0.25 * F.col("cosine") + 0.30 * p + 0.10 * F.col("tfidf") + 0.35 * F.col("domain")
    proposed = F.when(p >= 0.8, base * 0.3 + p * 0.7).otherwise(base * 0.5 + p * 0.5)
    return F.round(F.when(p > 0, proposed).otherwise(_blend(PLAIN_WEIGHTS)), DIGITS)


def _loose(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[_\\-]", "")


def match_reason(domain: Column, cosine: Column, tfidf: Column, source: Column, target: Column) -> Column:
    return (
        F.when(domain > 0.8, F.format_string("'%s' is a common abbreviation for '%s' in database systems", source, target))
        .when(cosine > 0.8, F.format_string("'%s' and '%s' have very similar semantic meanings", source, target))
        .when(tfidf > 0.7, F.format_string("'%s' and '%s' share similar naming patterns", source, target))
        .otherwise(F.format_string("Multiple factors suggest '%s' corresponds to '%s'", source, target))
    )


#: A proposal's confidence and what it says, null where there is none.
_HINT = "struct<p:double," + ",".join(f"{c}:string" for c in SAID) + ">"


def _offers(rows: DataFrame, accept: float) -> DataFrame:
    """Rows whose ensemble score reaches ``accept``, with ``offer``: its fields, so ordered that the least is the best."""
    scored = rows.withColumn("p", F.coalesce("hint.p", F.lit(0.0))).withColumn("ensemble", ensemble(F.col("p"))).where(F.col("ensemble") >= accept)
    fields = ["target_table", "position", "target", "target_type", "cosine", "p", "tfidf", "domain", *(F.col(f"hint.{c}").alias(c) for c in SAID)]
    return scored.withColumn("offer", F.struct((-F.col("ensemble")).alias("order"), *fields))


def _best_told_apart(source: DataFrame, names: DataFrame, scored: DataFrame, t: DataFrame, hints: DataFrame, accept: float) -> DataFrame:
    """``(source_table, source, b)``: the best offer to every source column, where proposals tell columns of one name apart.

    Without a proposal the offers depend on the name alone, so they are ranked
    once per name. A column with n proposals looks at the first n + 1 of its
    name: n of them at most are its own proposals, which count with their own
    scores instead. So the rows joined are the columns and the proposals, not
    the columns times their candidates.
    """
    at = ["target_table", "target"]
    left = source.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source")).distinct()
    # of a target column that is listed twice only the earlier can win
    once = t.groupBy(*at).agg(F.min(F.struct("position", "target_type")).alias("c")).select(*at, "c.position", "c.target_type")
    own = stage(hints.join(left, ["source_table", "source"]), "own-hints")
    plain = _offers(names.join(scored, "source").join(once, "target").withColumn("hint", F.lit(None).cast(_HINT)), accept)
    counts = own.groupBy("source_table", "source").agg(F.count("*").alias("n"))
    looks = counts.groupBy("source").agg((F.max("n") + 1).alias("looks"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("offer"))
    ranked = plain.join(looks, "source", "left").withColumn("rank", rank).where(F.col("rank") <= F.coalesce("looks", F.lit(1)))
    ranked = small(stage(ranked.select("source", "rank", *at, "offer"), "ranked-offers"))
    free = left.join(counts, ["source_table", "source"], "left_anti").join(ranked.where("rank = 1"), "source").select("source_table", "source", "offer")
    looked = counts.withColumn("rank", F.explode(F.sequence(F.lit(1), F.col("n").cast("int") + 1))).join(ranked, ["source", "rank"])
    others = looked.join(own.select("source_table", "source", *at), ["source_table", "source", *at], "left_anti").select("source_table", "source", "offer")
    told = _offers(own.join(scored, ["source", "target"]).join(once, at), accept).select("source_table", "source", "offer")
    picked = others.union(told).groupBy("source_table", "source").agg(F.min("offer").alias("b"))
    return free.withColumnRenamed("offer", "b").union(picked)


def match_columns(
    source: DataFrame,
    target: DataFrame,
    threshold: float = 0.6,
    proposals: DataFrame | None = None,
    use_local: bool = True,
    dictionary: Dictionary | None = None,
) -> DataFrame:
    """Best target column, over all target tables, for every source column.

    ``proposals(source_table, source_column, target_table, target_column,
    confidence)`` come from outside; without them the local proposer stands in
    (``use_local``). Source columns of the same name share one result unless
    outside proposals tell them apart. What else a proposal says about the
    mapping that is chosen goes with it, where it has the columns:
    ``mapping_type``, ``transformation``, ``why_mapped``, ``why_not_others``.
    Of several proposals for one mapping the most confident speaks.
    """
    accept = threshold if proposals is not None or use_local else max(0.4, threshold - 0.1)
    features = name_features(_names(source), _names(target), dictionary=dictionary)
    demands = [(accept, PLAIN_WEIGHTS)]
    if use_local and proposals is None:
        demands.append((max(LOCAL_MINIMUM, _least_local(accept)), LOCAL_WEIGHTS))
    pairs = candidate_pairs(source, target, features, *demands, dictionary=dictionary)
    t = target.select(
        F.col("table_name").alias("target_table"), F.col("column_name").alias("target"), "position", F.col("data_type").alias("target_type")
    )
    names = source.select(F.col("column_name").alias("source")).distinct()
    hints = None
    if proposals is not None:
        said = [F.col(c) if c in proposals.columns else F.lit(None).cast("string").alias(c) for c in SAID]
        given = proposals.select("source_table", F.col("source_column").alias("source"), "target_table", _loose(F.col("target_column")).alias("loose"), "confidence", *said)
        asked = stage(given.join(t.withColumn("loose", _loose(F.col("target"))), ["target_table", "loose"]), "asked")
        pairs = pairs.union(asked.select("source", "target"))
        hints = asked.groupBy("source_table", "source", "target_table", "target").agg(F.max(F.struct(F.col("confidence").alias("p"), *SAID)).alias("hint"))
    scored = stage(score_name_pairs(pairs, features, dictionary), "name_scores")
    if hints is not None:
        best, keys = _best_told_apart(source, names, scored, t, hints, accept), ["source_table", "source"]
    else:
        keys = ["source"]
        rows = names.join(scored, "source").join(t, "target")
        if use_local:
            unsaid = [F.lit(None).cast("string").alias(c) for c in SAID if c != "why_mapped"]
            hints = local_proposals(source, target, scored)
            hints = hints.select("source", "target_table", "target", F.struct(F.col("confidence").alias("p"), "why_mapped", *unsaid).alias("hint"))
            rows = rows.join(hints, [*keys, "target_table", "target"], "left")
        else:
            rows = rows.withColumn("hint", F.lit(None).cast(_HINT))
        best = _offers(rows, accept).groupBy(*keys).agg(F.min("offer").alias("b"))
    columns = source.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source"), F.col("data_type").alias("source_type"))
    score = -F.col("b.order")
    return columns.join(best, keys).select(
        "source_table",
        F.col("source").alias("source_column"),
        "source_type",
        "b.target_table",
        F.col("b.target").alias("target_column"),
        "b.target_type",
        "b.cosine",
        F.col("b.p").alias("proposal"),
        "b.tfidf",
        "b.domain",
        score.alias("ensemble"),
        S.ensemble_band(score).alias("confidence_level"),
        F.coalesce("b.mapping_type", F.lit("1:1")).alias("mapping_type"),
        F.coalesce("b.transformation", F.lit("none")).alias("transformation"),
        F.coalesce("b.why_mapped", match_reason(F.col("b.domain"), F.col("b.cosine"), F.col("b.tfidf"), F.col("source"), F.col("b.target"))).alias("why_mapped"),
        F.coalesce("b.why_not_others", F.lit("")).alias("why_not_others"),
    )


def match_stats(mappings: DataFrame) -> DataFrame:
    def band(name: str) -> Column:
        return F.count_if(F.col("confidence_level") == name).alias(f"{name}_confidence")

    return mappings.agg(
        F.count("*").alias("total_mappings"), band("high"), band("medium"), band("low"),
        F.coalesce(F.avg("ensemble"), F.lit(0.0)).alias("average_score"),
    )


def _has(c: Column, parts: list[str]) -> Column:
    return F.regexp_like(F.lower(c), F.lit("|".join(parts)))


def unmapped_columns(source: DataFrame, target: DataFrame, mappings: DataFrame) -> DataFrame:
    """Columns of both sides without a mapping, with a likely reason."""
    name = F.col("column_name")
    why_source = (
        F.when(_has(name, ["created", "updated", "modified", "_at", "_by"]), "This appears to be an audit/tracking column not present in target schema")
        .when(_has(name, ["old_", "legacy_", "deprecated"]), "This appears to be a legacy column that has been retired")
        .when(_has(name, ["temp_", "tmp_", "backup_"]), "This appears to be a temporary/backup column not needed in target")
        .otherwise("No sufficiently similar column found in target schema")
    )
    why_target = (
        F.when(_has(name, ["created", "updated", "modified", "_at"]), "This is likely an auto-generated audit column")
        .when(F.endswith(F.lower(name), F.lit("id")), "This appears to be a new identifier that will be auto-generated")
        .otherwise("This is a new column in the target schema - may need default value or manual mapping")
    )

    def rest(catalog: DataFrame, side: str, reason: Column) -> DataFrame:
        used = mappings.select(F.col(f"{side}_table").alias("table_name"), F.col(f"{side}_column").alias("column_name"))
        free = catalog.join(used, ["table_name", "column_name"], "left_anti")
        return free.select(F.lit(side).alias("side"), "table_name", "column_name", reason.alias("reason"))

    return rest(source, "source", why_source).unionByName(rest(target, "target", why_target))


def _worded(names: DataFrame, column: str) -> DataFrame:
    """``(name, norm, bag)`` of the distinct names: what the fuzzy score and the token cosine read."""
    norm = normalize_a(F.col("name"))
    each = spread(names.select(F.col(column).alias("name")).where("name is not null").distinct()).withColumn("norm", norm)
    return each.withColumn("bag", tokens(F.col("norm")))


def _fuzzy_candidates(s: DataFrame, t: DataFrame, least: float) -> DataFrame:
    """Pairs ``(source, target)`` that share a token, and those without one that may have a fuzzy score of ``least``.

    Without a common token only common letters make a score, so lengths of both
    names lie within a ratio: the pairs are joined on the length, and the
    letters that they have in common bound the score before it is computed.
    """
    token = F.explode(F.array_distinct("bag"))
    shared = _meeting(s, t, token, token)
    ratio = (least - 0.2) / 0.8
    if ratio <= 0.05:
        return _all_pairs(s, t)
    size = F.length("norm")
    low, high = F.ceil(size * ratio / (2 - ratio) - 1e-9).cast("int"), F.floor(size * (2 - ratio) / ratio + 1e-9).cast("int")
    a = s.select(F.col("name").alias("source"), F.col("norm").alias("a"), F.explode(F.sequence(low, high)).alias("size"))
    b = t.select(F.col("name").alias("target"), F.col("norm").alias("b"), size.alias("size"))
    near = a.join(b, "size").where(S.fuzzy_bound(F.col("a"), F.col("b")) >= least - 1e-9)
    return shared.union(near.select("source", "target")).distinct()


def _scored_names(s: DataFrame, t: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(source, target, syntactic, semantic)`` of the pairs: fuzzy score and token cosine of the normalised names."""
    a = s.select(F.col("name").alias("source"), F.col("norm").alias("a"), F.col("bag").alias("x"))
    b = t.select(F.col("name").alias("target"), F.col("norm").alias("b"), F.col("bag").alias("y"))
    read = spread(pairs).join(small(a), "source").join(small(b), "target")
    return read.select("source", "target", F.round(S.fuzzy_score("a", "b"), DIGITS).alias("syntactic"), F.round(S.token_cosine(F.col("x"), F.col("y")), DIGITS).alias("semantic"))


def table_pairs(source: DataFrame, target: DataFrame, minimum: float = 0.3, pairs: DataFrame | None = None) -> DataFrame:
    """Pairs of tables whose names look alike (fuzzy score above ``minimum``), of ``pairs(source_table, target_table)`` if given.

    With a bar as low as the default most pairs pass, so without ``pairs`` the
    result itself is in proportion to the pairs of tables.
    """
    s, t = (stage(_worded(c, "table_name"), "worded") for c in (source, target))
    if pairs is None:
        asked = _fuzzy_candidates(s, t, minimum)
    else:
        asked = pairs.select(F.col("source_table").alias("source"), F.col("target_table").alias("target")).distinct()
    scored = _scored_names(s, t, asked)
    return scored.where(F.col("syntactic") > minimum).select(F.col("source").alias("source_table"), F.col("target").alias("target_table"), F.col("syntactic").alias("similarity"))


def match_by_name(source: DataFrame, target: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Best target per source column within every pair of related tables.

    0.5 token cosine + 0.3 fuzzy + 0.2 type; ties go to the earlier column. A
    pair of names whose parts cannot add up to ``threshold`` is never scored:
    without a common token its fuzzy score must make up for the cosine. Whether
    two tables are related is asked last, of the pairs that still have columns.
    """
    s = source.select(
        F.col("table_name").alias("source_table"), F.col("column_name").alias("source"), F.col("data_type").alias("source_type"),
        F.col("is_primary_key").alias("source_pk"), F.col("is_nullable").alias("source_nullable"),
    )
    t = target.select(
        F.col("table_name").alias("target_table"), F.col("column_name").alias("target"), "position", F.col("data_type").alias("target_type"),
        F.col("is_primary_key").alias("target_pk"), F.col("is_nullable").alias("target_nullable"),
    )
    a, b = (stage(_worded(c, "column_name"), "worded") for c in (source, target))
    scored = _scored_names(a, b, _fuzzy_candidates(a, b, (threshold - 0.2) / 0.3)) if threshold <= 0.5 else _scored_names(a, b, _shared_only(a, b))
    part = 0.5 * F.col("semantic") + 0.3 * F.col("syntactic")
    scored = stage(scored.where(part + 0.2 >= threshold - 1e-6), "fuzzy_scores")
    type_score = S.type_score(F.col("source_type"), F.col("target_type"))
    # in whole millionths, so that halves are rounded up whatever the binary fraction
    millionths = [w * F.round(F.col(c) * 1_000_000).cast("long") for w, c in ((5, "semantic"), (3, "syntactic"), (2, "type_score"))]
    overall = F.floor((millionths[0] + millionths[1] + millionths[2] + 5) / 10) / 1_000_000
    # the best target in a table depends on the column's name and type alone
    kinds = s.select("source", "source_type").distinct()
    # heavy per row on few bytes: dealt before the names meet the tables, which stay the small side
    good = spread(kinds.join(scored, "source")).join(small(stage(t, "targets")), "target").withColumn("type_score", type_score).withColumn("overall", overall).where(F.col("overall") >= threshold)
    fields = ["position", "target", "target_type", "target_pk", "target_nullable", "semantic", "syntactic", "type_score"]
    best = F.min(F.struct((-F.col("overall")).alias("order"), *fields))
    picked = good.groupBy("source", "source_type", "target_table").agg(best.alias("b"))
    found = stage(picked.groupBy("source", "source_type").agg(F.collect_list(F.struct("target_table", "b")).alias("found")), "matched-names")
    found = small(found)
    met = s.select("source_table", "source", "source_type").distinct().join(found.select("source", "source_type", "found.target_table"), ["source", "source_type"])
    # dealt by source table once, so that pairs of tables are told apart where they lie
    pairs = met.select("source_table", "target_table").repartition("source_table").select("source_table", F.explode("target_table").alias("target_table")).distinct()
    related = table_pairs(source, target, pairs=stage(pairs, "met-tables")).groupBy("source_table").agg(F.collect_set("target_table").alias("related"))
    # targets leave their lists last: no shuffle carries a row per column and target table
    listed = s.distinct().join(related, "source_table").join(found, ["source", "source_type"])
    each = listed.withColumn("f", F.explode(F.filter("found", lambda x: F.array_contains("related", x["target_table"])))).select("*", "f.*")
    return each.select(
        "source_table", F.col("source").alias("source_column"), "source_type", "source_pk", "source_nullable", "target_table",
        F.col("b.target").alias("target_column"), "b.target_type", "b.target_pk", "b.target_nullable",
        "b.semantic", "b.syntactic", "b.type_score", (-F.col("b.order")).alias("overall"),
        S.name_band(-F.col("b.order")).alias("confidence"),
    )


def _shared_only(s: DataFrame, t: DataFrame) -> DataFrame:
    token = F.explode(F.array_distinct("bag"))
    return _meeting(s, t, token, token).distinct()


def match_warnings(mappings: DataFrame) -> DataFrame:
    """Type mismatch, lost primary key, NOT NULL turned nullable."""
    mismatch = F.when(F.col("type_score") < 0.6, F.concat(F.lit("Type mismatch: "), "source_type", F.lit(" → "), "target_type"))
    key = F.when(F.col("source_pk") & ~F.col("target_pk"), F.lit("Source is PK but target is not"))
    null = F.when(~F.col("source_nullable") & F.col("target_nullable"), F.lit("Source is NOT NULL but target allows NULL"))
    return mappings.withColumn("warnings", F.array_compact(F.array(mismatch, key, null)))


def search_mappings(mappings: DataFrame, term: str, band: str = "all") -> DataFrame:
    """Mappings with ``term`` in either column name, of one band or of all."""
    low = F.lit(term.lower())
    hit = F.contains(F.lower("source_column"), low) | F.contains(F.lower("target_column"), low)
    return mappings.where(hit if band == "all" else hit & (F.col("confidence_level") == band))


def mapping_kind(source_type: Column, target_type: Column, transformation: Column, mapping_type: Column) -> Column:
    """cast when the types are of different families, transform, else direct."""
    src, tgt = F.lower(source_type), F.lower(target_type)

    def differs(pattern: str) -> Column:
        return F.regexp_like(src, F.lit(pattern)) != F.regexp_like(tgt, F.lit(pattern))

    cast = (src != tgt) & (src != "") & (tgt != "") & (differs("int|float|real|numeric|decimal|double|bool") | differs("text|varchar|char|string"))
    how = F.lower(F.coalesce(transformation, F.lit("")))
    moved = ~how.isin("", "none", "direct") & (
        F.regexp_like(how, F.lit("split|merge|concat|convert|map|transform")) | F.contains(F.lower(F.coalesce(mapping_type, F.lit(""))), F.lit("transform"))
    )
    return F.when(cast, "cast").when(moved, "transform").otherwise("direct")
