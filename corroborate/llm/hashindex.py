"""Approximate nearest neighbours by multi-index hashing of learned binary codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.llm.common import query, table
from corroborate.session import stage

_PAIRS = 1 << 22
#: Rounding of a matrix product, beyond which scores are told apart by the exact measure.
_NEAR = 1e-9


@dataclass(frozen=True)
class Coder:
    """Binary codes: the signs of centred unit vectors after a learned rotation; and the radius to search."""

    mean: np.ndarray
    rotation: np.ndarray
    parts: int
    radius: int

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def spans(self) -> list[tuple[int, int]]:
        """Shift and width of each substring, the first one lowest."""
        cuts = [self.bits * k // self.parts for k in range(self.parts + 1)]
        return [(a, b - a) for a, b in zip(cuts, cuts[1:])]

    def budgets(self, radius: int) -> list[int]:
        """A code within ``radius`` is within its budget in one substring at least; -1: never there."""
        each, rest = divmod(radius, self.parts)
        return [each if k <= rest else each - 1 for k in range(self.parts)]

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        signs = (unit(vectors) - self.mean) @ self.rotation > 0
        return (signs.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to between 0.5 and 1: squares neither vanish nor overflow, and no cosine changes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True, initial=0))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def learn(vectors: np.ndarray, k: int = 5, parts: int = 4, share: float = 0.99, rounds: int = 40) -> Coder:
    """Rotate principal components towards their signs, and choose the radius.

    The radius holds ``share`` of the ``k`` nearest neighbours within the
    sample. Neighbours among all vectors are nearer than those in a sample, so
    it is on the safe side.
    """
    units = unit(vectors)
    mean = units.mean(axis=0)
    centred = units - mean
    bits = min(64, vectors.shape[1])
    parts = min(parts, bits)
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    projected = centred @ axes
    turn = np.linalg.qr(np.random.default_rng(7).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        signs = np.where(projected @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ projected)
        turn = (left @ right).T
    coder = Coder(mean, axes @ turn, parts, bits)
    codes, near = coder(vectors), []
    for start in range(0, len(units), 512):
        scores = units[start : start + 512] @ units.T
        scores[np.arange(len(scores)), start + np.arange(len(scores))] = -np.inf
        best = np.argpartition(-scores, min(k, scores.shape[1] - 1) - 1, axis=1)[:, : min(k, len(units) - 1)]
        near.append(np.bitwise_count(codes[start : start + 512, None] ^ codes[best]).ravel())
    near = np.concatenate(near) if len(units) > 1 else np.empty(0)
    radius = int(np.quantile(near, share, method="higher")) if len(near) else bits
    return Coder(mean, axes @ turn, parts, radius)


def usable(column: str) -> Column:
    """True for vectors that are there, not zero, and have no null or non-finite component."""
    v = F.col(column)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(odd, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64))


def _search(rows: DataFrame, coder: Coder, radius: int, k: int, block: int, n: int, parts: list[int]) -> DataFrame:
    """The ``k`` nearest within ``radius``, for each query and unit of work.

    ``rows(id, code, vector, is_query, is_row)``. A substring's leading bits,
    as many as make blocks of about ``block`` codes, name the unit that indexes
    it; a query visits the units whose leading bits differ in no more than the
    substring's budget. Large units are a grid of blocks of rows and of
    queries. A pair belongs to the first substring that finds it.
    """
    spans, budgets = coder.spans(), coder.budgets(radius)
    lead = max(0, min(min(w for _, w in spans), math.ceil(math.log2(max(1, n) / block)))) if n > block else 0

    def prefix(part: int) -> Column:
        shift, width = spans[part]
        return F.shiftrightunsigned("code", shift + width - lead).bitwiseAND((1 << lead) - 1).cast("long")

    def masks(part: int) -> Column:
        return F.array(*(F.lit(m).cast("long") for m in range(1 << lead) if m.bit_count() <= budgets[part]))

    live = [p for p in parts if budgets[p] >= 0]
    index, visits = None, None
    for p in live:
        own = rows.where("is_row").select(F.lit(p).alias("part"), prefix(p).alias("lead"), F.lit(False).alias("asks"), "id", "code", "vector")
        ask = rows.where("is_query").withColumn("mask", F.explode(masks(p))).select(F.lit(p).alias("part"), prefix(p).bitwiseXOR(F.col("mask")).alias("lead"), F.lit(True).alias("asks"), "id", "code", "vector")
        index = own if index is None else index.unionByName(own)
        visits = ask if visits is None else visits.unionByName(ask)
    both = index.unionByName(visits)
    # the sizes of the units: one row per substring and leading bits
    sizes = both.groupBy("part", "lead").agg(F.count_if(~F.col("asks")).alias("of_rows"), F.count_if("asks").alias("of_asks"))
    sizes = sizes.select("part", "lead", F.ceil(F.col("of_rows") / (4 * block)).cast("int").alias("tall"), F.ceil(F.col("of_asks") / (4 * block)).cast("int").alias("wide")).where("tall > 0 and wide > 0")
    dealt = both.join(sizes, ["part", "lead"])
    line = F.when(F.col("asks"), F.pmod(F.xxhash64("id", "code"), F.col("wide"))).otherwise(F.pmod(F.xxhash64("id", "code"), F.col("tall"))).cast("int")
    across = F.when(F.col("asks"), F.col("tall")).otherwise(F.col("wide"))
    dealt = dealt.withColumn("line", line).withColumn("other", F.explode(F.sequence(F.lit(0), across - 1)))
    dealt = dealt.select("part", "lead", F.when(F.col("asks"), F.col("other")).otherwise(F.col("line")).alias("row_block"), F.when(F.col("asks"), F.col("line")).otherwise(F.col("other")).alias("ask_block"), "asks", "id", "code", "vector")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        asks = group.column("asks").to_numpy()
        ids, codes, vectors = group.column("id").to_numpy(), group.column("code").to_numpy().view(np.uint64), _matrix(group.column("vector"))
        q, x = np.flatnonzero(asks), np.flatnonzero(~asks)
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        found: list[tuple[np.ndarray, ...]] = []
        step = max(1, _PAIRS // max(1, len(x)))
        units = vectors[x] / norms[x, None]
        for start in range(0, len(q) if len(x) else 0, step):
            mine = q[start : start + step]
            differ = codes[mine, None] ^ codes[None, x]
            good = np.bitwise_count(differ) <= radius
            for p in live:
                shift, width = spans[p]
                near = np.bitwise_count((differ >> np.uint64(shift)) & np.uint64((1 << width) - 1)) <= budgets[p]
                good &= near if p == part else ~near
                if p == part:
                    break
            good &= ids[mine, None] != ids[None, x]
            scores = np.where(good, (vectors[mine] / norms[mine, None]) @ units.T, -np.inf)
            last = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(mine), -np.inf)
            i, j = np.nonzero(good & (scores >= last[:, None] - _NEAR))
            a, b = mine[i], x[j]
            exact = (vectors[a] * vectors[b]).sum(axis=1) / (norms[a] * norms[b])
            order = np.lexsort((ids[b], -exact, i))
            i, b, exact = i[order], b[order], exact[order]
            first = np.searchsorted(i, i)
            top = np.arange(len(i)) - first < k
            found.append((ids[mine[i[top]]], ids[b[top]], exact[top]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(columns, schema=schema)

    return dealt.groupBy("part", "lead", "row_block", "ask_block").applyInArrow(run, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = 4096,
    parts: int = 4,
    block: int = 4096,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows nearest by cosine to each row where ``queries`` holds.

    The code is learned on ``sample`` vectors at most; every usable row is
    indexed. A query finds every code within the learned radius and is ranked
    on the original vectors in double precision, ties to the smaller id. A
    query that finds fewer than ``k`` is searched again without a radius, in
    blocks against all rows.

    Rows whose vector is null, zero, or has null or non-finite components, or
    whose id is null, take no part. Vectors of each length are searched among
    themselves, with a code of their own: there is no cosine of others. A row
    with the query's id is the query's own. Repeated ids are ranked each. An
    empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(queries, F.lit(False)).alias("is_query")).where(usable("vector") & F.col("id").isNotNull())
    found = None
    for width, n in rows.groupBy(F.size("vector").alias("width")).count().orderBy("width").collect():
        each = _nearest(rows.where(F.size("vector") == width), n, k, sample, parts, block)
        found = each if found is None else found.unionByName(each)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def _nearest(rows: DataFrame, n: int, k: int, sample: int, parts: int, block: int) -> DataFrame:
    """:func:`nearest` of ``n`` rows ``(id, vector, is_query)`` of one length."""
    hashed = F.shiftrightunsigned(F.xxhash64("id"), 1) / float(2**63)
    drawn = rows.where(hashed <= min(1.0, 2.0 * sample / n)).orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    coder = learn(scaled(np.array([r["vector"] for r in drawn], dtype=np.float64)), k, parts)
    shared = rows.sparkSession.sparkContext.broadcast(coder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = shared.value(_matrix(batch.column(1))).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], names=["id", "vector", "is_query", "code"])

    kind = rows.schema["vector"].dataType.simpleString()
    coded = stage(rows.mapInArrow(encode, f"id long, vector {kind}, is_query boolean, code long").withColumn("is_row", F.lit(True)), "codes")
    found = stage(_best(_search(coded, coder, coder.radius, k, block, n, list(range(coder.parts))), k), "nearest")
    held = found.groupBy("query_id").agg(F.count("*").alias("held"))
    asked = coded.where("is_query").join(held, F.col("id") == F.col("query_id"), "left")
    short = stage(asked.where(F.coalesce("held", F.lit(0)) < min(k, n - 1)).select("id", "vector", "code"), "short")
    if short.isEmpty():
        return found
    again = coded.select("id", "code", "vector", F.lit(False).alias("is_query"), "is_row").unionByName(short.select("id", "code", "vector", F.lit(True).alias("is_query"), F.lit(False).alias("is_row")))
    whole = _best(_search(again, coder, coder.bits * coder.parts, k, block, n, [0]), k)
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(whole)


@query("op4_nearest")
def op4_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
