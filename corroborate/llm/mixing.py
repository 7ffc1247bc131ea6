"""Mixing sources to target weights: thresholds on a hash, found by histograms of nested hash ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.llm.common import WORD, query, table
from corroborate.session import stage

#: Bits of the hash, and of one level of the histogram.
BITS, STEP = 60, 12
MOST = 3


def unit(id_col: str, text_col: str) -> Column:
    """A 60-bit hash of id and text; rows that agree in both share their fate."""
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources in code point order, null last, weigh 1, 2, 3 and so on again. The
    share per weight rises until the targets that stop at three times their
    source and the others add up to all sizes. Three numbers per round reach
    the driver.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    weighed = stage(sizes.withColumn("weight", ((rank - 1) % 3 + 1).cast("long")), "mix-sources")
    total, weights = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    share = total / weights if weights else 0.0
    most = F.col("source_size") * MOST
    while total:
        over = F.lit(share) * F.col("weight") > most
        held, free = weighed.agg(F.coalesce(F.sum(F.when(over, most)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        now = (total - held) / free if free else share
        if now <= share:
            break
        share = now
    return weighed.select("source", "source_size", F.least(most.cast("double"), F.lit(float(share)) * F.col("weight")).alias("target"))


def thresholds(units: DataFrame) -> DataFrame:
    """``(source, source_size, target, passes, threshold)`` from rows ``(source, size, h)``.

    A source is taken whole ``passes`` times, and once more where ``h`` is under
    the threshold: the hash at which the running sum of sizes is nearest to what
    is left of the target. A level sums sizes per source and hash range and
    finds the range in which the budget runs out; the next splits that range
    alone. Rows are never sorted.
    """
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(0).cast("long")
    goal = goal.withColumn("passes", whole).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    state = stage(goal.withColumn("before", F.lit(0).cast("long")).withColumn("prefix", F.lit(0).cast("long")).withColumn("own", F.lit(0).cast("long")), "mix-level")
    rows = units
    for left in range(BITS - STEP, -1, -STEP):
        part = F.shiftright("h", left)
        inside = rows.select(F.col("source").alias("_source"), part.alias("range"), "size").groupBy("_source", "range").agg(F.sum("size").alias("own_"))
        lead = state.where("budget > 0").select(F.col("source").alias("s"), F.col("prefix").alias("p"), F.col("before").alias("b"), F.col("budget").alias("g"))
        held = inside.join(lead, inside["_source"].eqNullSafe(lead["s"]) & (F.shiftright("range", STEP) == F.col("p")))
        running = F.sum("own_").over(Window.partitionBy("s").orderBy("range")) + F.col("b")
        found = held.withColumn("after", running).where("after > g and after - own_ <= g")
        found = found.select(F.col("s"), F.col("range"), (F.col("after") - F.col("own_")).alias("b"), "own_")
        state = stage(
            state.join(found, state["source"].eqNullSafe(found["s"]), "left").select(
                "source", "source_size", "target", "passes", "budget", F.coalesce("b", "before").alias("before"), F.coalesce("range", F.shiftleft("prefix", STEP)).alias("prefix"), F.coalesce("own_", F.lit(0)).alias("own")
            ),
            "mix-level",
        )
        if left:
            edge = state.where("budget > 0").select(F.col("source").alias("s"), F.col("prefix").alias("p"))
            rows = rows.join(edge, rows["source"].eqNullSafe(edge["s"]) & (F.shiftright("h", left) == F.col("p"))).select("source", "size", "h")
            if left == BITS - STEP:
                rows = stage(rows, "mix-edge")
    nearer = (F.col("own") > 0) & (2 * (F.col("budget") - F.col("before")) >= F.col("own"))
    threshold = F.when(F.col("budget") > 0, F.col("prefix") + nearer.cast("long")).otherwise(0)
    return state.select("source", "source_size", "target", "passes", threshold.cast("long").alias("threshold"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    units = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(text_col).alias("size"), unit(id_col, text_col).alias("h"))
    units = stage(units, "mix-units")
    return units, stage(thresholds(units), "mix-plan").withColumnRenamed("source", "_source")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, size, source_size, target, taken)`` for every row of ``docs``.

    ``taken`` is a whole multiple, 0 to 3, of the row's words. Null and empty
    texts have size 0. A null source is a source of its own. Rows alike in id
    and text are taken together. An empty table gives no rows.
    """
    units, plan = _planned(docs, id_col, text_col, source_col)
    times = F.col("passes") + (F.col("h") < F.col("threshold")).cast("long")
    out = units.join(plan, units["source"].eqNullSafe(plan["_source"]))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the texts are not shuffled unless there are very many sources."""
    _, plan = _planned(docs, id_col, text_col, source_col)
    rows = docs.select(F.col(source_col).alias("source"), unit(id_col, text_col).alias("h"), F.struct("*").alias("row"))
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["_source"]))
    times = (F.col("passes") + (F.col("h") < F.col("threshold")).cast("long")).cast("int")
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("time")).select("row.*")


MIX_SQL = """
WITH RECURSIVE u AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
           ('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 15))::BIGINT AS h
    FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM u GROUP BY source),
share(x) AS (
    SELECT sum(source_size)::DOUBLE / sum(w)::DOUBLE FROM s
    UNION
    SELECT greatest(x, (sum(source_size) - coalesce(sum(3 * source_size) FILTER (WHERE x * w > 3 * source_size), 0))::DOUBLE
                       / sum(w) FILTER (WHERE NOT x * w > 3 * source_size)::DOUBLE)
    FROM share, s GROUP BY x),
g AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, (SELECT max(x) FROM share) * w) AS target FROM s),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS passes FROM g),
c AS (
    SELECT u.doc_id, u.size, b.source_size, b.target, b.passes, b.target - b.passes * b.source_size AS budget,
           sum(u.size) OVER (PARTITION BY u.source ORDER BY u.h RANGE UNBOUNDED PRECEDING) AS after,
           sum(u.size) OVER (PARTITION BY u.source, u.h) AS own
    FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN budget > 0 AND (after <= budget OR (after - own <= budget AND 2 * (budget - (after - own)) >= own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


@query("op5_mixing", MIX_SQL)
def op5_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
