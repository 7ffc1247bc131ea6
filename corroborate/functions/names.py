"""Column-name normalisation and the features that name scores need."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.functions import lexicon as L
from corroborate.functions.literals import literal_map, literal_rows
from corroborate.functions.text import tokens


@dataclass(frozen=True)
class Dictionary:
    """Abbreviations and known pairs. Extend with :meth:`read` or :meth:`extended`."""

    abbreviations: dict[str, str] = field(default_factory=lambda: dict(L.ABBREVIATIONS_B))
    known_pairs: tuple[tuple[str, str, float], ...] = tuple(L.KNOWN_PAIRS)

    def extended(self, abbreviations: dict[str, str] | None = None, known_pairs=()) -> Dictionary:
        """Later entries win, as in a dictionary literal with repeated keys."""
        return Dictionary({**self.abbreviations, **(abbreviations or {})}, self.known_pairs + tuple(known_pairs))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Dictionary:
        """Add the rows of a ``short,long,score`` CSV: with a score, a known pair.

        A dictionary is a hand-kept file of some hundred lines; it becomes a
        literal in the plan, so a file of more than 20,000 rows is refused.
        """
        limit = 20_000
        rows = spark.read.schema("short string, long string, score double").csv(path, header=True).take(limit + 1)
        if len(rows) > limit:
            raise ValueError(f"dictionary has more than {limit} rows")
        return cls().extended(
            {r.short: r.long for r in rows if r.score is None},
            [(r.short, r.long, r.score) for r in rows if r.score is not None],
        )


def _lookup(entries: dict[str, str], key: Column) -> Column:
    if not entries:
        return F.lit(None).cast("string")
    return F.try_element_at(literal_map(entries), key)


def _expand(text: Column, entries: dict[str, str]) -> Column:
    parts = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.coalesce(_lookup(entries, w), w)), " ")


def normalize_a(name: Column) -> Column:
    """camelCase and separators to words, lower case, 49 abbreviations expanded."""
    spaced = F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")
    return _expand(F.trim(F.lower(F.regexp_replace(spaced, "[_\\-]+", " "))), L.ABBREVIATIONS_A)


def normalize_b(name: Column, dictionary: Dictionary | None = None) -> Column:
    """Lower case, ``_ - .`` to blanks, words expanded; expansions keep underscores."""
    entries = (dictionary or Dictionary()).abbreviations
    return _expand(F.regexp_replace(F.lower(name), "[_\\-.]", " "), entries)


def strip_prefix(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), f"^(?:{'|'.join(L.NAME_PREFIXES)})", "")


def core_term(name: Column, dictionary: Dictionary | None = None) -> Column:
    return normalize_b(strip_prefix(name), dictionary)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def semantic_groups(norm: Column, core: Column) -> Column:
    """Groups one of whose terms is in the name, contains it, or is in its core."""
    terms = literal_rows([{"group": g, "term": t} for g, ts in L.SEMANTIC_GROUPS.items() for t in ts], "group:string,term:string")
    # a higher-order function over one literal keeps the generated code small enough to be compiled
    hits = F.filter(terms, lambda x: F.contains(norm, x["term"]) | F.contains(x["term"], norm) | F.contains(core, x["term"]))
    return F.array_distinct(F.transform(hits, lambda x: x["group"]))


def date_base(low: Column) -> Column:
    """The first listed base word in the name, or NULL."""
    return F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in L.DATE_BASE_WORDS])


def char_grams(norm: Column) -> Column:
    """2- to 4-grams of every word padded with a blank on each side, with repeats."""
    padded = F.transform(
        F.filter(F.split(F.lower(norm), "\\s+"), lambda w: w != ""),
        lambda w: F.concat(F.lit(" "), w, F.lit(" ")),
    )

    def grams(word: Column, n: int) -> Column:
        positions = F.sequence(F.lit(1), F.length(word) - (n - 1))
        return F.when(F.length(word) >= n, F.transform(positions, lambda i: F.substr(word, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>")
        )

    return F.flatten(F.transform(padded, lambda w: F.concat(grams(w, 2), grams(w, 3), grams(w, 4))))


def _counts(distinct: str, every: str) -> Column:
    return F.map_from_arrays(distinct, F.transform(distinct, lambda g: F.size(F.filter(every, lambda x: x == g))))


def with_name_features(names: DataFrame, column: str, dictionary: Dictionary | None = None) -> DataFrame:
    """One row per distinct name with everything the pair scores read.

    Scores compare names, never rows: features are computed once per distinct
    name and joined back.
    """
    d = dictionary or Dictionary()
    c = F.col(column)
    low = F.trim(F.lower(c))
    grams = char_grams(F.col("norm"))
    base = (
        names.select(column)
        .where(c.isNotNull())
        .distinct()
        .withColumn("low", low)
        .withColumn("norm", normalize_b(c, d))
        .withColumn("stripped", strip_prefix(c))
        .withColumn("core", core_term(c, d))
        .withColumn("expansion", _lookup(d.abbreviations, F.col("low")))
        .withColumn("stripped_expansion", _lookup(d.abbreviations, F.col("stripped")))
    )
    parts = F.array_distinct(F.split(F.col("norm"), " "))
    opened = F.flatten(
        F.transform(
            parts,
            lambda w: F.when(
                _lookup(d.abbreviations, w).isNotNull(),
                F.concat(
                    F.array(w, F.replace(_lookup(d.abbreviations, w), F.lit("_"), F.lit(" "))),
                    F.split(_lookup(d.abbreviations, w), "_"),
                ),
            ).otherwise(F.array(w)),
        )
    )
    return (
        base.withColumn("groups", semantic_groups(F.col("norm"), F.col("core")))
        .withColumn("is_date", _any([F.contains(F.col("low"), F.lit(m)) for m in L.DATE_MARKERS]))
        .withColumn("base_word", date_base(F.col("low")))
        .withColumn("name_words", parts)
        .withColumn("open_words", F.array_distinct(opened))
        .withColumn("tokens", tokens(F.col("norm")))
        .withColumn("distinct_tokens", F.array_distinct("tokens"))
        .withColumn("all_grams", grams)
        .withColumn("grams", F.array_distinct("all_grams"))
        .withColumn("gram_counts", _counts("grams", "all_grams"))
        .withColumn("token_counts", _counts("distinct_tokens", "tokens"))
        .drop("all_grams")
    )
