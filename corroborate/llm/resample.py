"""Importance resampling towards a target distribution of hashed word n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corroborate.llm.common import query, table
from corroborate.session import stage

#: Bytes: A-Z to lower case, all others of ASCII that are no digits or letters to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text that are interned at once.
CHUNK = 2 << 20
_WIDE = 64
_U = np.uint64
#: The primes of XXH64 (fixed values).
_P1, _P2, _P3, _P4, _P5 = _U(0x9E3779B185EBCA87), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x85EBCA77C2B2AE63), _U(0x27D4EB2F165667C5)


def _rotate(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << _U(bits)) | (x >> _U(64 - bits))


class Spans:
    """Features of some texts as spans of one buffer, in which a single space follows each word."""

    def __init__(self, texts: list[bytes], longest: int) -> None:
        raw = np.frombuffer(b" ".join(texts).translate(_FOLD), dtype=np.uint8)
        word = raw != 32
        after = np.zeros(len(raw), dtype=bool)
        after[1:] = word[:-1]
        firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        doc = np.searchsorted(firsts, np.flatnonzero(word & ~after), side="right") - 1
        kept = raw[word | after]
        inside = np.concatenate([[False], kept != 32, [False]])
        starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        self.words = np.bincount(doc, minlength=len(texts))
        self.bytes = np.concatenate([kept, np.zeros(_WIDE, dtype=np.uint8)])
        self.lanes = np.ndarray(shape=(len(self.bytes) - 7,), dtype="<u8", buffer=self.bytes, strides=(1,))
        runs = [np.flatnonzero(doc[n:] == doc[: len(doc) - n]) for n in range(min(longest, len(doc)))]
        self.first = np.concatenate([np.empty(0, np.int64), *runs])
        self.doc = doc[self.first]
        self.start = starts[self.first]
        self.size = np.concatenate([np.empty(0, np.int64), *(ends[i + n] - starts[i] for n, i in enumerate(runs))])
        self.last_word = np.concatenate([np.empty(0, np.int64), *(i + n for n, i in enumerate(runs))])
        self.ends = list(zip(starts[1 - longest :].tolist(), ends[1 - longest :].tolist(), strict=True)) if longest > 1 else []

    def hashes(self) -> np.ndarray:
        """XXH64 of every span: short ones lane by lane for all at once, the few of 32 bytes and more by the library."""
        h = self.size.astype(np.uint64) + _P5
        at, left = self.start.copy(), np.where(self.size < 32, self.size, 0)
        for _ in range(3):
            some = np.flatnonzero(left >= 8)
            mixed = _rotate(self.lanes[at[some]] * _P2, 31) * _P1
            h[some] = _rotate(h[some] ^ mixed, 27) * _P1 + _P4
            at[some] += 8
            left[some] -= 8
        some = np.flatnonzero(left >= 4)
        h[some] = _rotate(h[some] ^ ((self.lanes[at[some]] & _U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at[some] += 4
        left[some] -= 4
        for _ in range(3):
            some = np.flatnonzero(left > 0)
            h[some] = _rotate(h[some] ^ (self.bytes[at[some]] * _P5), 11) * _P1
            at[some] += 1
            left[some] -= 1
        h = (h ^ (h >> _U(33))) * _P2
        h = (h ^ (h >> _U(29))) * _P3
        h ^= h >> _U(32)
        for i in np.flatnonzero(self.size >= 32):
            h[i] = xxh64_intdigest(self.of(i))
        return h

    def tail(self) -> list[bytes]:
        """The last words, one less than the longest feature has."""
        return [self.bytes[a:b].tobytes() for a, b in self.ends]

    def of(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans ``a`` and ``b`` of the same sizes have the same bytes."""
        size = self.size[a]
        same = np.ones(len(a), dtype=bool)
        for at in range(0, _WIDE, 8):
            some = np.flatnonzero(same & (size > at) & (size <= _WIDE))
            if not len(some):
                break
            differ = self.lanes[self.start[a[some]] + at] ^ self.lanes[self.start[b[some]] + at]
            rest = np.minimum(size[some] - at, 8).astype(np.uint64)
            same[some] = (differ << (_U(64) - _U(8) * rest)) == 0
        for i in np.flatnonzero(size > _WIDE):
            same[i] = self.of(a[i]) == self.of(b[i])
        return same


class Interned:
    """An open-addressed table of the different features among :class:`Spans`.

    A slot holds a key (XXH64), the span that claimed it, its bucket and its
    count. Occurrences probe together, step by step: a free slot goes to one of
    those that want it, the others compare key and bytes with its holder and
    move on if they differ. ``slot`` has the slot of every occurrence.
    """

    def __init__(self, spans: Spans, buckets: int) -> None:
        keys, n = spans.hashes(), len(spans.start)
        bits = max(4, int(2 * n).bit_length())
        holder = np.full(1 << bits, -1, dtype=np.int64)
        self.key = np.zeros(1 << bits, dtype=np.uint64)
        self.slot = (keys >> _U(64 - bits)).astype(np.int64)
        pending = np.arange(n)
        while len(pending):
            at = self.slot[pending]
            free = np.flatnonzero(holder[at] < 0)
            holder[at[free]] = pending[free]
            held = holder[at]
            self.key[at[free]] = keys[held[free]]
            same = (self.key[at] == keys[pending]) & (spans.size[held] == spans.size[pending])
            asked = np.flatnonzero(same & (held != pending))
            same[asked] = spans.equal(held[asked], pending[asked])
            pending = pending[~same]
            self.slot[pending] = (self.slot[pending] + 1) & ((1 << bits) - 1)
        self.used = np.flatnonzero(holder >= 0)
        view, owner = memoryview(spans.bytes), holder[self.used]
        ends = (spans.start[owner] + spans.size[owner]).tolist()
        self.bucket = np.zeros(1 << bits, dtype=np.int64)
        self.bucket[self.used] = [zlib.crc32(view[a:b]) % buckets for a, b in zip(spans.start[owner].tolist(), ends, strict=True)]
        self.count = np.bincount(self.slot, minlength=1 << bits)


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in pieces of about :data:`CHUNK` bytes that end at a byte outside words."""
    start = 0
    while start < len(data):
        end = min(start + CHUNK, len(data))
        while end < len(data) and _FOLD[data[end]] != 32:
            end += 1
        yield data[start:end]
        start = end


def interned(texts: pa.Array, buckets: int, longest: int) -> Iterator[tuple[np.ndarray, Spans, Interned, np.ndarray]]:
    """The texts' features by chunks: rows of the chunk's texts, spans, table, and which occurrences count.

    Of a text in pieces, the last ``longest`` - 1 words of what went before
    lead the next piece; features of these alone do not count again.
    """

    def made(rows: list[int], some: list[bytes], led: int = 0):
        spans = Spans(some, longest)
        spans.words = spans.words - led
        return np.array(rows), spans, Interned(spans, buckets), spans.last_word >= led

    rows, some, held = [], [], 0
    for row, text in enumerate(texts.cast(pa.binary())):
        data = text.as_py()
        if len(data) > CHUNK:
            lead: list[bytes] = []
            for piece in _pieces(data):
                chunk = made([row], [b" ".join([*lead, piece])], len(lead))
                yield chunk
                lead = chunk[1].tail()
            continue
        rows.append(row)
        some.append(data)
        held += len(data)
        if held >= CHUNK:
            yield made(rows, some)
            rows, some, held = [], [], 0
    if rows:
        yield made(rows, some)


def _texts(docs: DataFrame, text_col: str, *more) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def bucket_counts(docs: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """How many feature occurrences of the whole table each bucket holds. A task adds up its batches; ``buckets`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, table, counts in interned(batch.column(0), buckets, longest):
                if not counts.all():
                    table.count = np.bincount(table.slot[counts], minlength=len(table.count))
                np.add.at(total, table.bucket[table.used], table.count[table.used])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    found = _texts(docs, text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(buckets, dtype=np.int64)
    counts[found["bucket"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the logarithm of target to source probability, with one added to each count, in thousandths rounded down."""
    buckets = len(source)
    above = (target + 1).astype(np.float64) * float(int(source.sum()) + buckets)
    below = (source + 1).astype(np.float64) * float(int(target.sum()) + buckets)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 2) -> DataFrame:
    """``(id, n_words, n_features, weight)`` per row: ``weight`` is the mean gain of the text's features, rounded down; 0 without any."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, features, total = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for rows, spans, table, counts in interned(batch.column(1), buckets, longest):
                each = np.where(counts, gain[table.bucket][table.slot], 0)
                words[rows] += spans.words
                features[rows] += np.bincount(spans.doc[counts], minlength=len(rows))
                total[rows] += np.bincount(spans.doc, weights=each, minlength=len(rows)).astype(np.int64)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, text_col, F.col(id_col).alias("id")).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def draw(weights: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """``(id, n_words, n_features, weight, score, rank)`` per row: Gumbel noise from a hash of the id is added, the highest scores are drawn.

    Scores are whole numbers; a count per score, of which there are some
    100,000 at most (the noise has 26,000 values, a mean gain lies within
    45,000 either side), tells where each score's ranks begin. Only rows of
    drawn scores are sorted, each score apart. Rows of one id draw ranks of
    their own. A null id has no score and is not drawn.
    """
    part = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((part + 0.5) / 4294967296.0))).cast("long")
    scored = stage(weights.withColumn("score", F.col("weight") + noise), "resample-scores")
    fit = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    held = scored.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("score"))
    running = held.select("score", (F.sum("n").over(down) - F.col("n")).alias("before"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("wanted"))
    cut = stage(running.where("before < wanted"), "resample-cut")
    marked = scored.withColumn("fit", fit).join(F.broadcast(cut), "score", "left")
    drawn = F.col("fit") & F.col("before").isNotNull()
    rank = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy("id"))
    names = ["id", "n_words", "n_features", "weight", "score"]
    inside = marked.where(drawn).select(*names, F.when(rank <= F.col("wanted"), rank).cast("long").alias("rank"))
    return inside.unionByName(marked.where(~drawn).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = 10_000,
    longest: int = 2,
    percent: int = 25,
    least_words: int = 20,
    seed: int = 7,
) -> DataFrame:
    """``(id, n_words, n_features, weight, score, rank)`` per row of ``docs``, drawn towards the texts of ``target``.

    Features are runs of 1 to ``longest`` words, hashed into buckets; each
    batch interns them in an open-addressed table, so bytes are hashed by CRC
    once per different feature. Texts are read twice, once to count and once
    to weigh; no feature leaves its task. Null and empty texts have no
    features, weight 0, and are too short to be drawn; copies have one weight
    and noise of their own. An empty table gives no rows; an empty target has
    flat counts.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text_col, buckets, longest))
    return draw(weigh(docs, gain, id_col, text_col, longest), percent, least_words, seed).withColumnRenamed("id", id_col)


RESAMPLE_SQL = r"""
WITH codes AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS codes),
words AS (
    SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL
    SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
each AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM words),
own AS (SELECT side, id, feature, count(*) AS n FROM each GROUP BY side, id, feature),
features AS (SELECT feature, hex(encode(feature)) AS h FROM own GROUP BY feature),
hashed AS (
    SELECT feature, xor(list_reduce(range(len(h) // 2), lambda c, i: xor(codes[(xor(c, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
    FROM features, codes),
held AS (SELECT side, id, bucket, sum(n) AS n FROM own JOIN hashed ON own.feature = hashed.feature GROUP BY side, id, bucket),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::BIGINT AS t FROM held GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM counts),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM held JOIN gain ON held.bucket = gain.bucket WHERE side = 'd' GROUP BY id),
scored AS (
    SELECT words.id, len(w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || words.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM words LEFT JOIN weights ON words.id = weights.id WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, id) AS r, sum(CASE WHEN fit THEN 1 ELSE 0 END) OVER () AS n FROM scored)
SELECT id AS doc_id, n_features, weight, score, CASE WHEN fit AND r <= 25 * n // 100 THEN r END AS rank FROM ranked
"""


@query("op13_resample", RESAMPLE_SQL)
def op13_resample(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")
