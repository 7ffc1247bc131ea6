"""Likelihood of texts under a unigram model over an existing subword vocabulary, summed over all segmentations."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import held_out, query, table
from corroborate.session import stage

#: The symbol before every word; bytes are the symbols 0 to 255.
MARK = 256
_MARK = "▁"
_FLUSH = 200_000
_BATCH = 20_000


@lru_cache(maxsize=1)
def vocabulary(path: str) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Pieces of the SentencePiece file as symbols, and weights from the file's scores.

    A score of a merge vocabulary is minus the rank of the merge; by rank r
    the first weight of a piece is 1 / (r + 10). Pieces that no lower-cased
    word can hold (A to Z, a mark elsewhere than in front, control pieces) are
    left out; every single byte is there, so any text has a segmentation.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights: dict[tuple[int, ...], float] = {}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k):
            continue
        piece = model.id_to_piece(k)
        rest = piece.removeprefix(_MARK)
        symbols = ((MARK,) if rest != piece else ()) + tuple(rest.encode())
        if _MARK not in rest and not any(65 <= s <= 90 for s in symbols):
            weights[symbols] = 1 / (10 - model.get_score(k))
    least = min(weights.values(), default=1.0)
    for symbol in range(MARK + 1):
        weights.setdefault((symbol,), least)
    pieces = sorted(weights)
    return pieces, np.array([weights[p] for p in pieces])


@lru_cache(maxsize=1)
def trie(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Transitions ``next[node, symbol]`` (0: none; the root is 1), the piece that ends at a node (-1: none), and the longest piece."""
    pieces, _ = vocabulary(path)
    nodes: dict[tuple[int, ...], int] = {(): 1}
    for piece in pieces:
        for k in range(1, len(piece) + 1):
            nodes.setdefault(piece[:k], len(nodes) + 1)
    follow = np.zeros((len(nodes) + 1, MARK + 1), dtype=np.int32)
    ends = np.full(len(nodes) + 1, -1, dtype=np.int32)
    for symbols, node in nodes.items():
        if symbols:
            follow[nodes[symbols[:-1]], symbols[-1]] = node
    for k, piece in enumerate(pieces):
        ends[nodes[piece]] = k
    return follow, ends, max(map(len, pieces))


def forward(words: list[bytes], follow: np.ndarray, ends: np.ndarray, longest: int, scores: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Natural log marginal of each word over all segmentations, and with ``counts`` the expected uses of each piece.

    Words of the same length are taken together: ``alpha[j]`` is the log sum
    over all segmentations of the first j symbols, extended from every place by
    all pieces that the trie finds there.
    """
    out = np.empty(len(words))
    used = np.zeros(len(scores))
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        symbols = np.full((size + 1, len(rows)), MARK, dtype=np.int32)
        if size:
            symbols[1:] = np.frombuffer(b"".join(words[r] for r in rows), dtype=np.uint8).reshape(len(rows), size).T
        alpha = np.full((size + 2, len(rows)), -np.inf)
        alpha[0] = 0
        edges = []
        for j in range(size + 1):
            alive, node = np.arange(len(rows)), np.ones(len(rows), dtype=np.int32)
            for k in range(j, min(size + 1, j + longest)):
                node = follow[node, symbols[k][alive]]
                if not node.all():
                    alive, node = alive[node > 0], node[node > 0]
                    if not len(alive):
                        break
                piece = ends[node]
                hit = piece >= 0
                if hit.all():
                    at, piece = alive, piece
                else:
                    at, piece = alive[hit], piece[hit]
                if len(at):
                    alpha[k + 1, at] = np.logaddexp(alpha[k + 1, at], alpha[j, at] + scores[piece])
                    if counts is not None:
                        edges.append((j, k + 1, at, piece))
        out[rows] = alpha[-1]
        if counts is not None:
            beta = np.full((size + 2, len(rows)), -np.inf)
            beta[-1] = 0
            for j, k, at, piece in reversed(edges):
                beta[j, at] = np.logaddexp(beta[j, at], beta[k, at] + scores[piece])
            for j, k, at, piece in edges:
                share = np.exp(alpha[j, at] + scores[piece] + beta[k, at] - alpha[-1, at]) * counts[rows[at]]
                used += np.bincount(piece, weights=share, minlength=len(used))
    return out, used


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, _BATCH):
        yield batch.slice(start, _BATCH)


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, count)`` of all words of ``texts(text, learn)``: uses in texts to learn from, 0 for words of others alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "count"])
            seen.clear()
            return out

        for batch in batches:
            for text, learn in zip(batch.column(0), batch.column(1)):
                words = (text.as_py() or "").encode().lower().split()
                if learn.as_py():
                    seen.update(words)
                else:
                    for word in words:
                        if word not in seen:
                            seen[word] = 0
                if len(seen) > _FLUSH:
                    yield flush()
        yield flush()

    return texts.select("text", "learn").mapInArrow(run, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


def train(words: DataFrame, path: str, rounds: int = 4, smoothing: float = 0.01) -> tuple[np.ndarray, float]:
    """Natural log scores of the pieces, and the expected pieces in all, after ``rounds`` of expectation maximization over all words that were learned.

    A round adds up, over every distinct word, the expected uses of each piece
    times the word's count. Only these sums, one per piece of the fixed
    vocabulary, come to the driver.
    """
    weights = vocabulary(path)[1]
    scores, uses = np.log(weights / weights.sum()), np.zeros(1)
    for _ in range(rounds):
        now = scores

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(now))
            for whole in batches:
                for batch in _batches(whole):
                    total += forward(batch.column(0).to_pylist(), *trie(path), now, batch.column(1).to_numpy())[1]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["piece", "uses"])

        sums = words.where("count > 0").select("word", "count").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        uses = np.full(len(weights), smoothing)
        for row in sums.collect():  # one row per piece at most
            uses[row["piece"]] += row["uses"]
        scores = np.log(uses / uses.sum())
    return scores, float(uses.sum())


def _word_scores(words: DataFrame, path: str, scores: np.ndarray) -> DataFrame:
    """``(word, count, lattice)``: the log10 marginal of each distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _batches(whole):
                values = forward(batch.column(0).to_pylist(), *trie(path), scores)[0] / math.log(10)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=["word", "count", "lattice"])

    return words.select("word", "count").mapInArrow(run, "word binary, count long, lattice double")


def _split(texts: DataFrame, frequent, kind: str) -> DataFrame:
    """Per text the sums over its frequent words, and its other words with their numbers."""
    fields = "id {kind}, held_out boolean, row long, n_tokens long, known long, base double, lattice double, rare array<struct<word: binary, n: long>>"
    pair = pa.struct([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                totals, rare = [], []
                for text in batch.column(3):
                    words = Counter((text.as_py() or "").encode().lower().split())
                    n = known = 0
                    base = lattice = 0.0
                    rest = []
                    for word, uses in words.items():
                        n += uses
                        entry = table.get(word)
                        if entry is None:
                            rest.append({"word": word, "n": uses})
                        else:
                            known += uses
                            base += uses * entry[0]
                            lattice += uses * entry[1]
                    totals.append((n, known, base, lattice))
                    rare.append(rest)
                n, known, base, lattice = zip(*totals)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(lattice, pa.float64()), pa.array(rare, pa.list_(pair))],
                    names=["id", "held_out", "row", "n_tokens", "known", "base", "lattice", "rare"],
                )

    return texts.select("id", "held_out", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, fields.format(kind=kind))


def score_texts(
    docs: DataFrame,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 7,
    rounds: int = 4,
    frequent: int = 1 << 16,
) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``.

    ``score`` is the log10 probability of the text: words, each with a mark in
    front, then one end. No piece spans two words, so the sum over all
    segmentations of a text is the product of the sums of its words, and each
    distinct word's lattice is walked once. Piece scores start from the
    vocabulary's own and are re-estimated over the texts to learn from, those
    whose id does not have remainder 2.

    The ``frequent`` most used words, a fixed number, are looked up in every
    task; all others, which no text holds in bulk, are joined by word. The sums
    are exact either way.

    Null and empty texts hold the end alone. Rows with a null id are learned
    from. Repeated rows are scored and counted each. With nothing to learn from
    every count is 0 and the scores are those of the vocabulary.
    """
    spark: SparkSession = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col, modulus).alias("held_out"))
    counted = stage(word_counts(texts.select("text", (~F.col("held_out")).alias("learn"))), "lm-words")
    ends = texts.where("not held_out").count()
    seen = counted.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") > 0)).first()
    tokens, distinct = seen[0] + ends, seen[1] + (ends > 0)

    # the end is one more piece, used once by each text that is learned from
    scores, pieces = train(counted, vocabulary_path, rounds)
    end = math.log10((ends + 1) / (pieces + ends + 2))
    scores = scores + math.log((pieces + 1) / (pieces + ends + 2))
    known = stage(_word_scores(counted, vocabulary_path, scores), "lm-lattice")

    top = known.where("count > 0").orderBy(F.desc("count"), "word").limit(frequent).collect()
    table = {bytes(r["word"]): (math.log10(r["count"] + 1), r["lattice"]) for r in top}
    split = stage(_split(texts, spark.sparkContext.broadcast(table), kind), "lm-texts")

    rare = split.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    part = (
        rare.join(known, "word")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("count") > 0, F.col("n")).otherwise(0)).alias("known_"),
            F.sum(F.col("n") * F.log10(F.col("count") + 1)).alias("base_"),
            F.sum(F.col("n") * F.col("lattice")).alias("lattice_"),
        )
    )
    out = split.drop("rare").join(part, "row", "left")
    n = F.col("n_tokens") + 1
    zero = F.lit(0.0)
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        n.cast("long").alias("n_tokens"),
        (F.col("known") + F.coalesce("known_", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_", zero) + math.log10(ends + 1) - n * math.log10(tokens + distinct + 1)).alias("base_score"),
        (F.col("lattice") + F.coalesce("lattice_", zero) + end).alias("score"),
    )


@query("op8_lattice")
def op8_lattice(spark, sf_dir):
    import public_tokenizers

    return score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
