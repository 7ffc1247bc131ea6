"""How filters act on each other: every order of them, by a recursive walk over prefixes of the order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import ceil, factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.llm.common import query, table
from corroborate.session import stage

#: Letters of the text filters, in the order of their bits; the last one needs the whole table.
LETTERS = "ABCDE"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = b"#$%&*|"
_SLICE = 1000
#: Rows that one recursive query may return, by Spark's default, with room for uneven hashing.
_ROWS = 500_000


def text_mask(data: bytes, code_points: int) -> int:
    """Bits 1, 2, 4 and 8 for a text that fails A, B, C and D: short, repetitive, capitals, symbols."""
    words = data.split()
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * (len(data) - len(data.translate(None, _UPPER))) > 3 * code_points) << 2
        | (len(data.translate(None, _SYMBOLS)) < len(data)) << 3
    )


def text_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(id, part, mask, digest)`` per row: bits of the filters that a text alone decides, and its SHA-256. A null text is empty, a null part too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(start, _SLICE)
                texts = batch.column(2).cast(pa.binary())
                masks, digests = [], []
                for data, size in zip(texts, pc.utf8_length(batch.column(2)), strict=True):
                    data = data.as_py()
                    masks.append(text_mask(data, size.as_py()))
                    digests.append(hashlib.sha256(data).digest())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["id", "part", "mask", "digest"])

    kind = docs.schema[id_col].dataType.simpleString()
    empty = F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), empty).alias("part"), F.coalesce(text_col, empty).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, part string, mask int, digest binary")


def mask_cells(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id", last: int = 16) -> DataFrame:
    """``(part, mask, n, good, toxic)``: how many rows have a mask, with bit ``last`` for texts that a smaller id has too.

    Rows of one text are counted by id first, then by cell with the smallest
    id's count beside the total, so a text that most rows share is a few rows
    in the shuffle and no copy is joined to the others. Rows of null ids never
    fail the last filter, nor do they make others fail; rows of one id are no
    copies of each other. Labels of one id are joined: one of them suffices.
    """
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.expr("quality = 1")).alias("good"), F.max(F.expr("toxic = 1")).alias("toxic"))
    yes = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rows = masks.join(marks, "id", "left").select("id", "digest", "part", "mask", yes("good"), yes("toxic"))
    cell = ["digest", "part", "mask", "good", "toxic"]
    each = rows.groupBy("id", *cell).agg(F.count("*").alias("k"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "k"))).alias("least")
    cells = each.groupBy(*cell).agg(F.sum("k").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("k")).otherwise(0)).alias("none"), least)
    lowest = F.min("least.id").over(Window.partitionBy("digest"))
    firsts = F.col("none") + F.when(F.col("least.id") == lowest, F.col("least.k")).otherwise(0)
    split = cells.withColumn("firsts", firsts).select(
        "part",
        "good",
        "toxic",
        F.explode(F.array(F.struct("mask", F.col("firsts").alias("n")), F.struct(F.col("mask").bitwiseOR(last).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))).alias("c"),
    )
    count = lambda c: F.sum(F.when(F.col(c), F.col("c.n")).otherwise(0)).alias(c)
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), count("good"), count("toxic"))


def _spread(cells: DataFrame, size: int) -> DataFrame:
    """One row per part with its cells as arrays by mask, zeros included."""
    held = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("held")
    at = lambda name: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.coalesce(F.col("held")[m][name], F.lit(0).cast("long"))).alias(name)
    return cells.groupBy("part").agg(held).select("part", at("n"), at("good"), at("toxic"))


def _sum(array: str, rule: str, size: int) -> str:
    return f"aggregate(sequence(0, {size - 1}), 0L, (s, m) -> s + IF({rule}, c.{array}[m], 0L))"


def walk_sql(letters: str) -> str:
    """The recursive query over ``{cells}``: a level extends each prefix by each unused letter and appends that step's counts."""
    size = 1 << len(letters)
    choices = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << k})" for k, x in enumerate(letters))
    fails, gone = "m & x.bit <> 0", "m & w.bits <> 0"
    counts = {
        "kept": _sum("n", "m & (w.bits | x.bit) = 0", size),
        "removed": _sum("n", f"{fails} AND NOT {gone}", size),
        "redundant": _sum("n", f"{fails} AND {gone}", size),
        "unique_fails": "c.n[x.bit]",
        "good_lost": _sum("good", f"{fails} AND NOT {gone}", size),
        "toxic_lost": _sum("toxic", f"{fails} AND NOT {gone}", size),
    }
    shape = "array<struct<letter: string, " + ", ".join(f"{k}: bigint" for k in counts) + ">>"
    step = "named_struct('letter', x.letter, " + ", ".join(f"'{k}', {v}" for k, v in counts.items()) + ")"
    return f"""
WITH RECURSIVE walk(part, prefix, bits, steps) AS (
    SELECT part, '', 0, CAST(array() AS {shape}) FROM {{cells}}
    UNION ALL
    SELECT w.part, concat(w.prefix, x.letter), w.bits | x.bit, concat(w.steps, array({step}))
    FROM (SELECT *, explode(filter(array({choices}), l -> bits & l.bit = 0)) AS x FROM walk) w JOIN {{cells}} c ON w.part = c.part)
SELECT part, prefix AS filter_order, posexplode(steps) AS (at, s) FROM walk WHERE length(prefix) = {len(letters)}"""


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Per part, order of the filters and step: what the step keeps and removes, and each filter's share over all orders.

    ``cells`` has ``(part, mask, n, good, toxic)``; bit k of a mask is the
    filter of letter k. A recursive query extends prefixes of the order by
    unused letters, joins the part's mask cells and carries the applied bits;
    each level emits its step's counts. Its work depends on parts and letters
    alone, not on documents. Parts are dealt to as many such queries as Spark's
    limit on rows of a recursion asks for, one as a rule. No cells give no rows.
    """
    k = len(letters)
    wide = stage(_spread(cells, 1 << k), "audit-cells")
    prefixes = sum(factorial(k) // factorial(i) for i in range(k + 1))
    lots = max(1, ceil(wide.count() * prefixes / _ROWS))
    found = None
    for lot in range(lots):
        some = wide if lots == 1 else wide.where(F.pmod(F.xxhash64("part"), F.lit(lots)) == lot)
        steps = wide.sparkSession.sql(walk_sql(letters), cells=some)
        found = steps if found is None else found.unionByName(steps)
    share: Column = F.sum("s.removed").over(Window.partitionBy("part", "s.letter")).alias("shapley")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return found.select("part", "filter_order", (F.col("at") + 1).alias("step"), *(F.col(f"s.{n}").alias(n) for n in names), share)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """:func:`interactions` of the five text filters over ``docs``: one row per part, order and step.

    A: under 200 words. B: fewer different words than half. C: over 3 %
    capitals. D: a symbol of ``#$%&*|``. E: a text that a smaller id has too
    (equal SHA-256). Null texts are empty, null parts the empty string; labels
    of unknown ids count nothing; an empty table gives no rows.
    """
    masks = text_masks(docs, id_col, text_col, part_col)
    return interactions(mask_cells(masks, labels, id_col))


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(LETTERS))
AUDIT_SQL = rf"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (
    SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
           100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
           coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS e
    FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
r AS (
    SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
           coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM f LEFT JOIN l ON f.doc_id = l.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM r GROUP BY part, fails),
orders AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS before FROM (VALUES {_ORDERS}) AS o(filter_order), (VALUES (1), (2), (3), (4), (5)) AS s(step)),
m AS (
    SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS hit, fails = letter AS alone,
           before <> '' AND fails <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone
    FROM orders, cells),
g AS (
    SELECT part, filter_order, step, letter, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM m GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM g
"""


@query("op11_audit", AUDIT_SQL)
def op11_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
