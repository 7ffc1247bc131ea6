"""Best-fit packing planned over a histogram of lengths; documents take the planned slots by rank within their length."""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.llm.common import query, table
from corroborate.session import stage

#: Strings between white space whose ids a worker keeps: the first ones, mostly the frequent, for good; others until there are too many.
_FIRST, _MEMO = 150_000, 500_000
#: Words of letters that are encoded as one text.
_GROUP = 256
_MARKS = b".,;:!?#$%&*"
_SPECIAL = b"<|"


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    # tasks fill the cores; more threads in each would only wait for one another
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def _lasts(path: str) -> np.ndarray | None:
    """Which ids are a word's last token; None if the vocabulary does not mark them."""
    tokenizer = _tokenizer(path)
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    lasts = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    lasts[[at for token, at in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
    return lasts


def _halves(part: bytes) -> tuple[bytes, bytes, bool]:
    """A string as letters in lower case and marks after them, which this tokenizer never joins; else whole. And if the first is letters alone.

    Its normalizer folds case itself, and its splitter parts letters from other signs.
    """
    if _SPECIAL in part:
        return part, b"", False
    low = part.lower()
    letters = low.rstrip(_MARKS)
    if letters.isalpha() or not letters.isascii() and (word := letters.decode()).isalpha() and max(word) < "\u0100":
        return letters, low[len(letters) :], True
    return low, b"", False


class Encoder:
    """Token ids of whole texts, from ids of their parts between white space, which no token spans."""

    def __init__(self, path: str, end: int = 0):
        self.path, self.end, self.memo, self.first = path, np.array([end], dtype="<u4"), {b"": b""}, {}

    def _ids(self, words: list[bytes], plain: bool) -> list[bytes]:
        """Ids of each word. Plain ones, of letters alone, are encoded many to a text and told apart by their last tokens."""
        tokenizer = _tokenizer(self.path)

        def encoded(texts: list[str]) -> list[np.ndarray]:
            return [np.array(found.ids, dtype="<u4") for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        lasts = _lasts(self.path)
        if not plain or lasts is None:
            return [ids.tobytes() for ids in encoded([w.decode() for w in words])]
        out = []
        groups = [words[at : at + _GROUP] for at in range(0, len(words), _GROUP)]
        for group, ids in zip(groups, encoded([b" ".join(g).decode() for g in groups]), strict=True):
            cuts = (4 * (np.flatnonzero(lasts[ids]) + 1)).tolist()
            if len(cuts) != len(group):
                out += self._ids(group, False)
                continue
            raw = ids.tobytes()
            out += [raw[begin:end] for begin, end in zip([0, *cuts], cuts)]
        return out

    def _learn(self, fresh: list[bytes]) -> None:
        memo, split, new = self.memo, [], ({}, {})
        for part in fresh:
            letters, marks, plain = _halves(part)
            if letters not in memo:
                new[plain][letters] = None
            if marks and marks not in memo:
                new[False][marks] = None
            if marks or letters != part:
                split.append((part, letters, marks))
        for plain, words in enumerate(new):
            words = list(words)
            for start in range(0, len(words), 50_000):
                some = words[start : start + 50_000]
                memo.update(zip(some, self._ids(some, bool(plain)), strict=True))
        for part, letters, marks in split:
            memo[part] = memo[letters] + memo[marks]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, without end ids, and the bounds of each text in them; null texts are empty.

        Every different part of the texts is looked up once.
        """
        texts = pc.fill_null(texts, "")
        # special tokens are told by their case
        texts = pc.if_else(pc.match_substring(texts, _SPECIAL.decode()), texts, pc.ascii_lower(texts))
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        parts = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        if len(self.memo) > _FIRST and not self.first:
            self.first = dict(self.memo)
        if len(self.memo) > _MEMO:
            self.memo = dict(self.first)
        self._learn([part for part in parts if part not in self.memo])
        found = [self.memo[part] for part in parts]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.frombuffer(b"".join(found), dtype="<u4")))
        at = coded.indices
        before = np.append(0, np.cumsum(sizes[at.to_numpy()]))
        return lists.take(at).flatten().to_numpy(), before[words.offsets.to_numpy()]

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        ids, bounds = self.encode(pa.array(texts, pa.string()))
        for begin, end in zip(bounds[:-1], bounds[1:]):
            yield np.concatenate([ids[begin:end], self.end])


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One per worker, so that its tasks share what it has learned."""
    return Encoder(path)


def _slices(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with ``size`` bytes of text, and a text more at most."""
    group = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for begin, end in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(begin, end - begin)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: the texts' token ids, an end id after each, cut only where longer than ``capacity``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        end = encode.end.tobytes()
        for whole in batches:
            for batch in _slices(whole):
                ids, bounds = encode.encode(batch.column(1))
                raw = memoryview(ids).cast("B")
                sizes = np.diff(bounds) + 1
                number = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), number)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(capacity, sizes[owner] - start)
                begin = bounds[owner] + start
                last = piece == number[owner] - 1
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length - last).tolist())]
                crc = [zlib.crc32(end, c) if done else c for c, done in zip(crc, last.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths: runs ``(length, from_rank, to_rank, sequence, each, offset)``.

    Ranks of a run fill consecutive sequences from ``sequence``, ``each`` to a
    sequence, from ``offset`` in it. Sequences with the same room form a
    group; a length takes the group with the least room that fits, whole if it
    can, so the number of runs depends on the lengths, not on the documents.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    fresh = 0

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in rooms:
                bisect.insort(order, room)
                rooms[room] = []
            rooms[room].append((first, number))

    def fill(length: int, rank: int, left: int, room: int, first: int, number: int) -> tuple[int, int]:
        """Fill up to ``number`` sequences; returns the rank reached and the sequences used."""
        each = room // length
        full = min(number, left // each)
        if full:
            runs.append((length, rank, rank + full * each, first, each, capacity - room))
            put(room - full_room(each, length), first, full)
            rank, left = rank + full * each, left - full * each
        if left and full < number:
            runs.append((length, rank, rank + left, first + full, left, capacity - room))
            put(room - left * length, first + full, 1)
            return rank + left, full + 1
        return rank, full

    def full_room(each: int, length: int) -> int:
        return each * length

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                number = -(-(count - rank) // each)
                rank, _ = fill(length, rank, count - rank, capacity, fresh, number)
                fresh += number
                continue
            room = order[at]
            first, number = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            rank, used = fill(length, rank, count - rank, room, first, number)
            put(room, first + used, number - used)
    return runs


def pack(parts: DataFrame, capacity: int = 2048, bucket: int = 2000, order: tuple[str, ...] = ("id", "piece", "ids_crc32")) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; ``length`` is at most ``capacity``.

    Only the histogram of lengths, ``capacity`` numbers at most, comes to the
    driver, and the plan over it goes back. The rank within a length is made of
    buckets of about ``bucket`` rows: rank in the bucket plus the sizes of the
    buckets before, so a length that a third of all rows share is no hot key.
    Rows that agree in ``order`` are interchangeable.
    """
    spark: SparkSession = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(counts, capacity)
    splits = spark.createDataFrame([(int(k), max(1, -(-n // bucket))) for k, n in counts.items()], "length long, buckets long")
    slots = spark.createDataFrame(runs, "length long, from_rank long, to_rank long, first long, each long, begin long")

    rows = parts.join(F.broadcast(splits), "length").withColumn("bucket", F.pmod(F.xxhash64(*order), F.col("buckets"))).drop("buckets")
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    placed = ranked.join(F.broadcast(slots), "length").where("rank >= from_rank and rank < to_rank")
    step = F.col("rank") - F.col("from_rank")
    return placed.select(
        *parts.columns,
        (F.col("first") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("begin") + (step % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)`` for every row of ``docs``.

    Null and empty texts are one end id. Repeated rows are packed each. An
    empty table gives no rows.
    """
    parts = stage(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    return pack(parts, capacity).withColumnRenamed("id", id_col)


@query("op2_packing")
def op2_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
