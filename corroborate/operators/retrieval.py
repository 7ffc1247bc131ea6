"""Embedding and exact top-k evidence search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corroborate.functions.text import embed_text
from corroborate.session import light_batches, stage

SCORE_DIGITS = 6
#: Blocks in a row group of a packed store.
GROUP_BLOCKS = 4


def embed(df: DataFrame, text: str = "text", embedder: Callable[[Column], Column] = embed_text) -> DataFrame:
    """Add ``embedding``; rows without a vector are left out.

    ``embedder`` maps a text column to an ``array<float>`` column, normally an
    iterator pandas UDF that loads its model once per worker.
    """
    # exploded, as a filter goes below a plain column, and the vectors would be made twice: for it and for the rows
    return df.withColumn("embedding", F.explode(F.array(embedder(F.col(text))))).where(F.col("embedding").isNotNull())


def _blocks(df: DataFrame, key: str, rows: int, prefix: str) -> DataFrame:
    """Pack vectors into matrices of at most ``rows`` rows, within partitions; a block is numbered by partition and place."""
    dtype = df.schema[key].dataType
    block, ids, matrix = f"{prefix}_block", f"{prefix}_ids", f"{prefix}_matrix"
    schema = T.StructType([T.StructField(block, T.LongType()), T.StructField(ids, T.ArrayType(dtype)), T.StructField(matrix, T.BinaryType())])

    out = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                part = part.take(pc.sort_indices(part, [("id", "ascending")]))
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
                cells = [[number], [part.column(0).to_pylist()], [vectors.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, out, strict=True)], schema=out)
                number += 1

    return df.select(F.col(key).alias("id"), "embedding").mapInArrow(pack, schema)


@dataclass(frozen=True)
class Packed:
    """A store's vectors as matrix blocks in a folder, a version beside the other."""

    path: str
    version: int
    key: str
    rows: int

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/version={self.version}")


def pack(store: DataFrame, path: str, key: str = "chunk_id", block_rows: int = 1024, version: int = 0) -> Packed:
    """Write the store's vectors as blocks once; every search of that version reads them as they lie.

    A new version is written beside the old ones, so a search that runs goes on
    reading its own. Writing a version again replaces it.
    """
    blocks = _blocks(store, key, block_rows, "c")
    with light_batches(store.sparkSession):
        # a row group is read into memory as a whole, and is as large as 128 MB by default
        blocks.write.mode("overwrite").option("parquet.block.row.count.limit", GROUP_BLOCKS).parquet(f"{path}/version={version}")
    packed = Packed(path, version, key, 0)
    rows = packed.blocks(store.sparkSession).agg(F.coalesce(F.sum(F.size("c_ids")), F.lit(0))).first()[0]
    return Packed(path, version, key, int(rows))


def evidence_topk(
    queries: DataFrame,
    store: DataFrame | Packed,
    k: int = 5,
    query_key: str = "query_id",
    store_key: str = "chunk_id",
    lanes: int | None = None,
    query_lanes: int | None = None,
    block_rows: int = 1024,
    query_block_rows: int = 256,
    send_bytes: int = 64 << 20,
    lane_blocks: int = 64,
) -> DataFrame:
    """Exact top-k by ``1 - squared L2 distance``: ``(query, store id, score, rank)``.

    Vectors are packed into blocks; every query block meets every store block
    once, by an equality join on lane numbers. Queries whose blocks are at most
    ``send_bytes`` are broadcast, and the store is read where it lies. Beyond
    that both are dealt into lanes of about ``lane_blocks`` blocks: the store is
    shuffled once per lane of queries and the queries once per lane of the
    store, so a task's share does not grow with either. A task holds two blocks
    and the k best so far of its queries; ties go to the smaller id. Rows that
    repeat a query id are one query: its k best over all its vectors. A store
    that was packed before (:func:`pack`) is not packed again.
    """
    spark = queries.sparkSession
    c = store.blocks(spark) if isinstance(store, Packed) else _blocks(store, store_key, block_rows, "c")
    id_q, id_c = queries.schema[query_key].dataType, c.schema["c_ids"].dataType.elementType
    with light_batches(spark):
        q = stage(_blocks(queries, query_key, query_block_rows, "q"), "query-blocks")
    n_q, sent = q.agg(F.count("*"), F.coalesce(F.sum(F.length("q_matrix")), F.lit(0))).first()
    few = sent <= send_bytes and lanes is None and query_lanes is None
    if few:
        lanes = query_lanes = 1
    else:
        lanes = lanes or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(store.rows if isinstance(store, Packed) else store.count()) // (block_rows * lane_blocks)))
        query_lanes = query_lanes or max(1, -(-n_q // lane_blocks))
    q = q.withColumn("q_lane", F.pmod(F.xxhash64("q_block"), F.lit(query_lanes)).cast("int")).withColumn(
        "c_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    )
    c = c.withColumn("c_lane", F.pmod(F.xxhash64("c_block"), F.lit(lanes)).cast("int")).withColumn(
        "q_lane", F.explode(F.sequence(F.lit(0), F.lit(query_lanes - 1)))
    )
    met = c.join(F.broadcast(q) if few else q, ["q_lane", "c_lane"]).select("q_block", "q_ids", "q_matrix", "c_ids", "c_matrix")
    schema = T.StructType(
        [T.StructField(query_key, id_q), T.StructField(store_key, id_c), T.StructField("score", T.DoubleType())]
    )

    def best_cells(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best cells of every row; a tie at the edge goes to the left one.

        Ids are sorted inside a block, so left means smaller id.
        """
        width = scores.shape[1]
        if width <= k:
            return np.nonzero(np.ones_like(scores, dtype=bool))
        edge = np.partition(scores, width - k, axis=1)[:, width - k]
        keep = scores >= edge[:, None]
        for row in np.nonzero(keep.sum(axis=1) > k)[0]:
            keep[row] = False
            keep[row, np.argsort(-scores[row], kind="stable")[:k]] = True
        return np.nonzero(keep)

    out = to_arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}  # by number of the query block: ids of the queries, scores and store ids of their best
        for batch in batches:
            # matrices are read where Arrow holds them; only ids are copied, or they would keep their batch
            blocks, q_all, q_vectors, c_all, c_vectors = batch.columns
            for at in range(batch.num_rows):
                block = blocks[at].as_py()
                q_ids, c_ids = (np.array(x[at].values.to_numpy(zero_copy_only=False)) for x in (q_all, c_all))
                qm = np.frombuffer(q_vectors[at].as_buffer(), np.float32).reshape(len(q_ids), -1).astype(np.float64)
                cm = np.frombuffer(c_vectors[at].as_buffer(), np.float32).reshape(len(c_ids), -1).astype(np.float64)
                distance = (qm * qm).sum(1)[:, None] + (cm * cm).sum(1)[None, :] - 2 * (qm @ cm.T)
                scores = np.round(1 - distance, SCORE_DIGITS)
                rows, columns = best_cells(scores)
                found, ids = scores[rows, columns].reshape(len(q_ids), -1), c_ids[columns].reshape(len(q_ids), -1)
                if block in best:
                    found, ids = np.hstack([best[block][1], found]), np.hstack([best[block][2], ids])
                    by_id = np.argsort(ids, axis=1, kind="stable")
                    found, ids = np.take_along_axis(found, by_id, 1), np.take_along_axis(ids, by_id, 1)
                    top = np.argsort(-found, axis=1, kind="stable")[:, :k]
                    found, ids = np.take_along_axis(found, top, 1), np.take_along_axis(ids, top, 1)
                best[block] = (q_ids, found, ids)
                del qm, cm
            # or two batches lie side by side while the next is read
            del batch, blocks, q_all, q_vectors, c_all, c_vectors
        for q_ids, found, ids in best.values():
            columns = [np.repeat(q_ids, found.shape[1]), ids.ravel(), found.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.col(store_key))
    return (
        met.mapInArrow(search, schema)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def evidence_approx(queries: DataFrame, store: DataFrame, max_distance: float, bucket_length: float = 0.5, tables: int = 4, seed: int = 42, **keys) -> DataFrame:
    """Opt-in approximate search: random-projection buckets (Spark ML), then top-k.

    Pairs closer than ``max_distance`` that share a bucket; not exact.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    k = keys.get("k", 5)
    query_key, store_key = keys.get("query_key", "query_id"), keys.get("store_key", "chunk_id")

    def vectors(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"))

    lsh = BucketedRandomProjectionLSH(inputCol="vector", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed)
    q, c = vectors(queries, query_key), vectors(store, store_key)
    joined = lsh.fit(c).approxSimilarityJoin(q, c, max_distance, "distance")
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.col(store_key))
    return (
        joined.select(
            F.col(f"datasetA.{query_key}").alias(query_key),
            F.col(f"datasetB.{store_key}").alias(store_key),
            F.round(1 - F.col("distance") * F.col("distance"), SCORE_DIGITS).alias("score"),
        )
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def gate(evidence: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Keep evidence above a retrieval score."""
    return evidence.where(F.col("score") > min_score)
