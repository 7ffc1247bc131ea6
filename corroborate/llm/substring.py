"""Exact removal of passages that repeat across documents, by level-wise doubling of repeated windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import join_windows, mix, query, table, window_hashes, word_hashes
from corroborate.session import stage

_LONG = pa.list_(pa.int64())
_EMPTY = hashlib.sha256(b"").hexdigest()


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the least one, the first among equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    best, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        size += step
    return best[:n]


def anchors(windows: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` half windows the place of its anchor.

    The least of rehashed values: equal runs have equal anchors, wherever they
    stand. So if a long window repeats, the half window at its anchor does.
    """
    return sliding_argmin(mix(windows ^ np.uint64(0x5851F42D4C957F2D)), width)


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)))


def _sketch(docs: DataFrame, length: int, kind: str) -> DataFrame:
    """Per row: number of words, digest of all words, and the hashes of its anchors at half the length."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                counts, digests, found = [], [], []
                for text in batch.column(3):
                    text = text.as_py() or ""
                    words = word_hashes(text)
                    counts.append(len(words))
                    digests.append(hashlib.sha256(b" ".join(text.encode().split())).hexdigest())
                    windows = window_hashes(words, half)
                    found.append(np.unique(_signed(windows[anchors(windows, length - half + 1)])))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), _lists(found)], names=["id", "t", "t2", "n_words", "digest", "anchors"])

    return docs.select("id", F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("t2"), "text").mapInArrow(run, f"id {kind}, t long, t2 long, n_words long, digest string, anchors array<long>")


def _mark(t: str) -> Column:
    """31 bits that tell texts of one id apart."""
    return F.shiftrightunsigned(t, 33).alias("mark")


def _extend(candidates: DataFrame, length: int, kind: str) -> DataFrame:
    """Windows of the full length whose anchor repeats at half of it: ``(id, spot, h, h2)``; ``spot`` holds the text's mark and the place."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = word_hashes(batch.column(2)[k].as_py())
                windows = window_hashes(words, half)
                live = np.isin(_signed(windows), batch.column(3)[k].values.to_numpy())
                full = len(words) - length + 1
                place = np.flatnonzero(live[anchors(windows, length - half + 1)][:full])
                h = join_windows(windows[place], windows[place + length - half])
                if length % 2:
                    h = join_windows(h, words[place + half])
                h2 = mix(h ^ words[place]) ^ mix(words[place + half] * np.uint64(3) + words[place + length - 1])
                for at in range(0, len(place), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    key = batch.column(0).take(pa.array(np.full(len(place[part]), k)))
                    yield pa.RecordBatch.from_arrays([key, pa.array(place[part] | (batch.column(1)[k].as_py() << 32)), pa.array(_signed(h[part])), pa.array(_signed(h2[part]).astype(np.int32))], names=["id", "spot", "h", "h2"])

    return candidates.select("id", _mark("t"), "text", "live").mapInArrow(run, f"id {kind}, spot long, h long, h2 int")


def _cut(rows: DataFrame, length: int, kind: str) -> DataFrame:
    """``(id, t, n_removed, digest, kept)`` from ``(id, t, text, places)`` of windows to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, texts = [], [], []
            for text, places in zip(batch.column(2), batch.column(3)):
                words = text.as_py().encode().split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                places = places.values.to_numpy()
                np.add.at(edge, places, 1)
                np.add.at(edge, places + length, -1)
                covered = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(words[i] for i in np.flatnonzero(~covered))
                removed.append(int(covered.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["id", "t", "n_removed", "digest", "kept"])

    return rows.select("id", "t", "text", "places").mapInArrow(run, f"id {kind}, t long, n_removed long, digest string, kept string")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256, kept)`` per row of ``docs``.

    A word goes if it lies in a window of ``length`` words whose sequence also
    starts in a document with a smaller id. ``kept`` is the remaining text,
    words joined by one space, where something was removed, and null where the
    text stays as it is.

    The first level takes windows of half the length at their anchors, about
    one in thirteen. Those found in one text alone end there; only windows of
    the full length whose anchor repeats are hashed at the second level. Equal
    texts are read once: every window of a copy starts in its first document.

    Null texts have no words. A null id is never smaller, so such rows neither
    remove nor lose words. Rows with the same id are no copies of each other.
    Texts shorter than a window stay whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketch = stage(_sketch(rows, length, kind), "passages-sketch")
    firsts = sketch.where(f"id is not null and n_words >= {length}").groupBy("t", "t2").agg(F.min("id").alias("first"))

    each = sketch.where("id is not null").select(F.explode("anchors").alias("anchor"), "t")
    repeated = each.groupBy("anchor").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low < high").select("anchor")
    live = each.distinct().join(repeated, "anchor").groupBy("t").agg(F.collect_list("anchor").alias("live"))
    wanted = live.join(firsts, "t").select(F.col("t").alias("_t"), F.col("first").alias("_id"), "live")

    texts = rows.where("id is not null").withColumn("t", F.xxhash64("text"))
    candidates = stage(texts.join(wanted, (texts["t"] == wanted["_t"]) & (texts["id"] == wanted["_id"])).select("id", "t", "text", "live"), "passages-texts")

    # hashed anew for the join: less than a copy of all windows; the table of repeated ones lets Spark split hot windows
    windows = _extend(candidates, length, kind)
    smallest = windows.groupBy("h", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h", "h2", "low")
    again = windows.join(stage(smallest, "passages-repeated"), ["h", "h2"]).where("id > low")
    places = again.groupBy("id", F.shiftright("spot", 32).alias("mark")).agg(F.collect_list(F.col("spot").bitwiseAND(0xFFFFFFFF).cast("int")).alias("places"))
    cut = _cut(candidates.withColumn("mark", _mark("t")).join(places, ["id", "mark"]), length, kind)

    lost = cut.dropDuplicates(["id", "t"]).select(F.col("id").alias("_id"), F.col("t").alias("_t"), "n_removed", F.col("digest").alias("_digest"), "kept")
    known = sketch.drop("anchors").join(firsts, ["t", "t2"], "left")
    out = known.join(lost, (known["id"] == lost["_id"]) & (known["t"] == lost["_t"]), "left")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("_digest", "digest")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


PASSAGES_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
x AS (SELECT doc_id, i, words[i] AS word, CASE WHEN i + 49 <= len(words) THEN md5(array_to_string(words[i:i + 49], ' ')) END AS h FROM p),
m AS (SELECT h, min(doc_id) AS low FROM x WHERE h IS NOT NULL GROUP BY h),
f AS (
    SELECT x.doc_id, i, word, max(CASE WHEN low < x.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY x.doc_id ORDER BY i ROWS 49 PRECEDING) AS gone
    FROM x LEFT JOIN m ON x.h = m.h),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM f GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""


@query("op10_passages", PASSAGES_SQL)
def op10_passages(spark, sf_dir):
    return dedup_passages(table(spark, sf_dir, "documents")).drop("kept")
