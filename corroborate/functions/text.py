"""Text columns: ids, chunks, claims, tokens, best sentence, positions."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corroborate.functions import lexicon as L
from corroborate.functions.literals import literal_array

# the characters Python calls white space
SPACE = "[\\t-\\r\\x1c-\\x1f\\x{85}\\p{Z}]"
EMBEDDING_WIDTH = 256

CHUNK_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("chunk_index", T.IntegerType()),
            T.StructField("char_start", T.IntegerType()),
            T.StructField("char_end", T.IntegerType()),
            T.StructField("text", T.StringType()),
        ]
    )
)


def doc_id(path: Column) -> Column:
    """First 8 hex digits of the path's md5."""
    return F.substring(F.md5(path), 1, 8)


def strip(c: Column) -> Column:
    """Remove white space at both ends (``F.trim`` removes blanks only)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def by_slices(batch: pa.Array, rows: int, work: Callable[[list], pa.Array]) -> pa.Array:
    """``work`` on ``rows`` rows at a time, so that only these are Python objects, however large the batch."""
    done = [work(batch.slice(at, rows).to_pylist()) for at in range(0, max(len(batch), 1), rows)]
    return done[0] if len(done) == 1 else pa.concat_arrays(done)


def chunker(size: int = 500, overlap: int = 50):
    """Overlapping windows that prefer to end after a full stop or a line break.

    The cut of one window decides where the next starts, so a document is a
    sequential scan; documents are independent rows. An Arrow batch function
    keeps the scan linear (SQL ``substring`` recounts characters from the start).
    """
    if overlap * 2 > size:
        raise ValueError("overlap must be at most half the chunk size")

    def pieces(text: str):
        start, index = 0, 0
        while start < len(text):
            end = start + size
            if end < len(text):
                cut = max(text.rfind(".", start, end), text.rfind("\n", start, end))
                if cut - start > size / 2:
                    end = cut + 1
            raw = text[start:end]
            body = raw.strip()
            if body:
                at = start + len(raw) - len(raw.lstrip())
                yield (index, at, at + len(body), body)
                index += 1
            start = end - overlap

    def of_slice(texts: list[str | None]) -> pa.Array:
        ends, cut = [0], []
        for text in texts:
            cut.extend(pieces(text) if text is not None else ())
            ends.append(len(cut))
        columns = [pa.array([c[i] for c in cut], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.string()))]
        rows = pa.StructArray.from_arrays(columns, names=CHUNK_TYPE.elementType.names)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    @F.arrow_udf(CHUNK_TYPE)
    def chunk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield by_slices(batch, 100, of_slice)

    return chunk


def sentences(text: Column) -> Column:
    """Break after ``. ! ?`` followed by white space, and at line breaks."""
    marked = F.regexp_replace(text, f"([.!?]){SPACE}+", "$1\n")
    return F.filter(F.split(marked, "\n"), lambda s: strip(s) != "")


def claims_of(sentence: Column) -> Column:
    """A long sentence (over 20 words) becomes its clauses; a short one stays whole."""
    clauses = F.split(F.replace(sentence, F.lit(";"), F.lit(".")), "\\. ")
    kept = F.transform(F.filter(clauses, lambda c: F.length(c) > 5), strip)
    return F.when(F.size(words(sentence)) > 20, kept).otherwise(F.array(strip(sentence)))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def embed_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Built-in stand-in embedder: hashed bag of tokens, unit length.

    Texts without tokens have no vector (NULL).
    """
    token = re.compile(r"[^\W_]+")
    buckets: dict[str, int] = {}

    def bucket(word: str) -> int:
        found = buckets.get(word)
        if found is None:
            if len(buckets) > 100_000:
                buckets.clear()
            found = buckets[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % EMBEDDING_WIDTH
        return found

    def vectors_of(texts: list[str | None]) -> pa.Array:
        n = len(texts)
        cells = [row * EMBEDDING_WIDTH + bucket(word) for row, text in enumerate(texts) if text for word in token.findall(text.lower())]
        counts = np.bincount(np.array(cells, dtype=np.int64), minlength=n * EMBEDDING_WIDTH).reshape(n, EMBEDDING_WIDTH)
        norms = np.sqrt((counts * counts).sum(axis=1))
        empty = norms == 0
        vectors = (counts / np.where(empty, 1, norms)[:, None]).astype(np.float32)
        offsets = np.arange(n + 1, dtype=np.int32) * EMBEDDING_WIDTH
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()), mask=pa.array(empty))

    for batch in batches:
        yield by_slices(batch, 500, vectors_of)


def content_tokens(c: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(c)), literal_array(L.STOP_WORDS))


def best_sentence(claim: Column, evidence: Column) -> Column:
    """The evidence sentence that contains most of the claim's words; first wins."""
    parts = F.filter(F.transform(F.split(evidence, "[.!?]+"), strip), lambda s: s != "")
    edge = "[.,!?()\\[\\]{}]+"
    keys = F.array_except(
        F.transform(words(F.lower(claim)), lambda w: F.regexp_replace(w, f"^{edge}|{edge}$", "")),
        literal_array(L.STOP_WORDS),
    )
    scored = F.transform(
        parts,
        lambda s, i: F.struct(
            F.size(F.filter(keys, lambda w: F.contains(F.lower(s), w))).alias("score"),
            (-i).alias("order"),
            s.alias("sentence"),
        ),
    )
    return F.when(F.size(parts) == 0, evidence).otherwise(F.array_max(scored)["sentence"])


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def occurrences(text: Column, phrase: Column) -> Column:
    """Zero-based starts of the non-overlapping matches, upper and lower case alike."""
    same_length = (F.length(F.lower(text)) == F.length(text)) & (F.length(F.lower(phrase)) == F.length(phrase))
    hay = F.when(same_length, F.lower(text)).otherwise(text)
    needle = F.when(same_length, F.lower(phrase)).otherwise(phrase)
    gaps = F.split(hay, _quoted(needle), -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    walked = F.aggregate(
        F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))),
        start,
        lambda acc, gap: F.struct(
            (acc["at"] + F.length(gap) + F.length(needle)).alias("at"),
            F.array_append(acc["out"], acc["at"] + F.length(gap)).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.length(phrase) > 0, walked).otherwise(F.array().cast("array<int>"))


def claim_spans(text: Column, claim: Column) -> Column:
    """Spans of the claim; without one, of its first five words up to a full stop."""
    exact = F.transform(
        occurrences(text, claim),
        lambda s: F.struct(s.alias("start"), (s + F.length(claim)).alias("end")),
    )
    head = F.array_join(F.slice(words(claim), 1, 5), " ")

    def to_stop(s: Column) -> Column:
        after = s + F.length(head)
        stop = F.position(F.lit("."), text, after + 1)
        end = F.when(stop > 0, stop).otherwise(F.least(after + 100, F.length(text)))
        return F.struct(s.alias("start"), end.alias("end"))

    fuzzy = F.transform(occurrences(text, head), to_stop)
    return (
        F.when(F.size(exact) > 0, exact)
        .when(F.size(words(claim)) >= 5, fuzzy)
        .otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    )


def topic_tags(text: Column) -> Column:
    """Topics whose keywords occur in the text, in the fixed topic order."""
    low = F.lower(text)
    tags = [
        F.when(functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keys]), F.lit(topic))
        for topic, keys in L.TOPICS.items()
    ]
    return F.array_compact(F.array(*tags))


def fixed(c: Column, digits: int) -> Column:
    """A number with fixed decimals; halves go to even, as in Python (Java rounds them up)."""
    return F.format_string(f"%.{digits}f", F.bround(c, digits))


def percent(c: Column, digits: int = 0) -> Column:
    return F.concat(fixed(c * 100, digits), F.lit("%"))


def shorten(c: Column, n: int = 100) -> Column:
    return F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, "...").otherwise(""))


def escape_markup(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c
