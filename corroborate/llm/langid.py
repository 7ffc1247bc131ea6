"""Language identification with a string kernel: presence of character n-grams, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corroborate.llm.common import held_out, query, table
from corroborate.session import stage

#: Character classes: 0 for what is no letter, a to z, and hashed classes for all other letters.
ALPHABET = 128
GRAMS = ALPHABET + ALPHABET**2 + ALPHABET**3
NONE = "und"
_CHUNK = 1 << 19
_ROWS = 128


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    out = np.zeros(0x110000, dtype=np.uint8)
    codes = np.array([c for c in range(0x110000) if chr(c).isalpha()], dtype=np.uint64)
    out[codes] = 27 + (((codes * np.uint64(0x9E3779B1)) >> np.uint64(7)) % np.uint64(ALPHABET - 27))
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


class Spectrum:
    """Distinct n-grams of one to three characters of whole texts, lower-cased."""

    def __init__(self):
        self.stamp = np.zeros(GRAMS, dtype=np.int32)

    def _distinct(self, grams: np.ndarray) -> np.ndarray:
        place = np.arange(len(grams), dtype=np.int32)
        self.stamp[grams] = place
        return grams[self.stamp[grams] == place]

    def __call__(self, text: str) -> np.ndarray:
        text, parts = text.lower(), []
        for start in range(0, len(text), _CHUNK):
            c = _letters()[np.frombuffer(text[start : start + _CHUNK + 2].encode("utf-32-le"), dtype=np.uint32)].astype(np.int32)
            two = c[:-1] * ALPHABET + c[1:]
            three = two[:-1] * ALPHABET + c[2:]
            parts.append(self._distinct(np.concatenate([c, two + ALPHABET, three + (ALPHABET + ALPHABET**2)])))
        if len(parts) == 1:
            return parts[0]
        return self._distinct(np.concatenate(parts)) if parts else np.empty(0, dtype=np.int32)


@dataclass
class Model:
    """Weights of the n-grams that the landmarks hold: the landmarks' share of the kernel is multiplied in."""

    langs: list[str]
    column: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def fit(samples: list[tuple[str, np.ndarray]], landmarks: int = 64, ridge: float = 1e-3) -> Model | None:
    """One-versus-rest kernel ridge regression on Nyström features; ``samples`` are languages with the n-grams of a text.

    The kernel of two texts is the number of n-grams both hold over the root of
    the product of their numbers. The first ``landmarks`` samples of each
    language are landmarks.
    """
    langs = sorted({lang for lang, _ in samples})
    if not langs:
        return None
    seen: dict[str, int] = dict.fromkeys(langs, 0)
    marks = []
    for lang, grams in samples:
        if seen[lang] < landmarks:
            marks.append(grams)
            seen[lang] += 1
    vocabulary = np.unique(np.concatenate(marks))
    column = np.full(GRAMS, -1, dtype=np.int32)
    column[vocabulary] = np.arange(len(vocabulary))

    def presence(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
        for k, grams in enumerate(rows):
            at = column[grams]
            out[k, at[at >= 0]] = 1 / np.sqrt(len(grams))
        return out

    marked = presence(marks)
    values, vectors = np.linalg.eigh((marked @ marked.T).astype(np.float64))
    keep = values > values.max() * 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.concatenate([presence([g for _, g in samples[k : k + 200]]) @ marked.T for k in range(0, len(samples), 200)]).astype(np.float64) @ root
    features = np.hstack([features, np.ones((len(features), 1))])
    targets = np.where(np.array([[lang == other for other in langs] for lang, _ in samples]), 1.0, -1.0)
    penalty = ridge * len(samples) * np.eye(features.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(features.T @ features + penalty, features.T @ targets)
    return Model(langs, column, marked.T.astype(np.float64) @ (root @ solved[:-1]), solved[-1])


def sample(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str, modulus: int) -> list[tuple[str, np.ndarray]]:
    """About ``per_language`` different texts of each language with their n-grams, chosen by a hash of the text, in the hash's order.

    Equal texts are merged before they are counted, so the share of the hashes
    taken is right however often a text is repeated; the rest is cut to the
    bound. Texts stay on the executors.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (~held_out(id_col, modulus)).alias("learn"))
    labelled = labelled.where("learn and lang is not null and id is not null").where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    thin = stage(labelled.groupBy("lang", "h").agg(F.min("id").alias("id")), "language-texts")
    sizes = thin.groupBy("lang").count().collect()
    if not sizes:
        return []
    shares = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 2.0 * per_language / r["count"]))))
    in_share = F.shiftrightunsigned("h", 1) / float(2**63) <= shares[F.col("lang")]
    drawn = labelled.where(in_share)
    first = thin.where(in_share).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= per_language).drop("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum()
        for batch in batches:
            grams = [spectrum(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grams, pa.list_(pa.int32()))], names=["lang", "h", "grams"])

    found = drawn.join(F.broadcast(first), ["lang", "h", "id"]).select("lang", "h", "text").mapInArrow(run, "lang string, h long, grams array<int>")
    rows = {(r["lang"], r["h"]): np.array(r["grams"], dtype=np.int32) for r in found.toLocalIterator()}
    return [(lang, rows[lang, h]) for lang, h in sorted(rows)]


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for every row: the language of the largest regression value, ties to the first by name."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, spectrum = shared.value, Spectrum()
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                texts = [text.as_py() or "" for text in batch.column(1)]
                names, scores = [NONE] * len(texts), np.zeros(len(texts))
                if model is not None:
                    present = np.zeros((len(texts), len(model.weights)))
                    spoken = np.zeros(len(texts), dtype=bool)
                    for k, text in enumerate(texts):
                        grams = spectrum(text)
                        spoken[k] = bool((grams[grams < ALPHABET] > 0).any())
                        at = model.column[grams]
                        present[k, at[at >= 0]] = 1 / np.sqrt(max(len(grams), 1))
                    values = present @ model.weights + model.bias
                    best = values.argmax(axis=1)
                    scores = np.where(spoken, np.clip((values.max(axis=1) + 1) / 2, 0, 1).round(9), 0.0)
                    names = [model.langs[b] if s else NONE for b, s in zip(best, spoken)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    modulus: int = 4,
    per_language: int = 400,
    landmarks: int = 64,
) -> DataFrame:
    """Predict the language of every whole text after learning from ``per_language`` texts of each.

    Rows whose id has remainder 2, a null id or a null language are not
    learned from. Null texts and those without a letter are ``und`` with score
    0, as is everything where there is nothing to learn from. Repeated rows are
    predicted each.
    """
    model = fit(sample(docs, per_language, id_col, text_col, lang_col, modulus), landmarks)
    return predict(docs, model, id_col, text_col)


@query("op1_language")
def op1_language(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents")).withColumn("held_out", held_out("doc_id", 4)).select("doc_id", "held_out", "lang_pred", "score")
