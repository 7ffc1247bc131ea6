"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query under ``key``, with the SQL that must give the same rows."""

    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def held_out(id_col: str, modulus: int) -> Column:
    """True where the remainder is 2; false for a null id."""
    return F.coalesce(remainder(id_col, modulus) == 2, F.lit(False))


def with_guess(rows: DataFrame, keys: DataFrame, columns: list[str], words: int = 1 << 20) -> DataFrame:
    """``rows`` with ``guess``: false only where ``keys`` has no row of the same ``columns``.

    A filter of one bit per hash, in at most ``words`` words of 64 bits, is
    broadcast, so its size is bounded whatever ``keys`` holds (some million
    keys more, and more guesses are wrong). Only guessed rows need the join.
    ``keys`` should be staged: it is counted first. Nulls are values.
    """
    size = min(words, max(64, 1 << (keys.count() // 4).bit_length()))
    place = F.pmod(F.xxhash64(*columns, F.lit(7)), F.lit(64 * size))
    word, bit = F.shiftright(place, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    filled = keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    met = rows.withColumns({"_at": word, "_bit": bit}).join(F.broadcast(filled), F.col("_at") == F.col("_word"), "left")
    return met.withColumn("guess", F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).drop("_at", "_bit", "_word", "_bits")


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_PIECE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit hashes over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    letters = raw[inside]
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), _STEP, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    return mix(np.add.reduceat(_BYTE[letters] * powers[place], first) + lengths.astype(np.uint64) * _ODD)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash per word of the whole text, in order; long texts are taken in pieces cut at white space."""
    data = (text or "").encode()
    if len(data) <= _PIECE:
        return _hashes(data)
    parts, start = [], 0
    while start < len(data):
        end = min(start + _PIECE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_hashes(data[start:end]))
        start = end
    return np.concatenate(parts)


def join_windows(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of windows made of two neighbouring ones."""
    return mix(left * _ODD + (right ^ (right >> np.uint64(29))) * _STEP + np.uint64(1))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash for every window of ``length`` words, by doubling; empty if the text is shorter."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, done, power, size = None, 0, words, 1
    while True:
        if length & size:
            out = power if out is None else join_windows(out[: len(words) - done - size + 1], power[done : len(words) - size + 1])
            done += size
        if done == length:
            return out[:n]
        power = join_windows(power[: len(power) - size], power[size:])
        size *= 2
