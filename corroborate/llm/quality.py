"""Quality rules on distributions: a text's character classes and common words against those of its language."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corroborate.llm.common import query, table, window_hashes, word_hashes
from corroborate.llm.quality_sql import quality_sql
from corroborate.session import stage

WHITE, SPACE, LOWER, UPPER, DIGIT, STOP, SYMBOL, ASCII, OTHER = range(9)
CLASSES = 9
_SYMBOLS = "#*$%&|<>"
_STOPS = ".,;:'\"?-()"
_FLUSH = 200_000


@dataclass(frozen=True)
class Limits:
    """A text is refused if a distance is over ``limit + slack / sqrt(n)`` for its n words; the slack allows for what few words vary by chance.

    Distances are square roots of the Jensen-Shannon divergence in bits, 0 to 1.
    Words are judged from ``word_guard`` words on, characters from ``char_guard``.
    """

    common: int = 32
    char_guard: int = 10
    char_limit: float = 0.17
    char_slack: float = 1.3
    word_guard: int = 50
    word_limit: float = 0.22
    word_slack: float = 1.6


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for code in range(0x110000):
        char = chr(code)
        if char in " \t\n\v\f\r":
            out[code] = WHITE
        elif char in _SYMBOLS:
            out[code] = SYMBOL
        elif char in _STOPS:
            out[code] = STOP
        elif char.isspace():
            out[code] = SPACE
        elif char.isupper():
            out[code] = UPPER
        elif char.isalpha():
            out[code] = LOWER
        elif char.isdigit():
            out[code] = DIGIT
        elif code < 128:
            out[code] = ASCII
    return out


def char_classes(text: str) -> np.ndarray:
    """Numbers of characters of each class."""
    table, out = _classes(), np.zeros(CLASSES, dtype=np.int64)
    for start in range(0, len(text), 1 << 20):
        out += np.bincount(table[np.frombuffer(text[start : start + (1 << 20)].encode("utf-32-le"), dtype=np.uint32)], minlength=CLASSES)
    return out


def shape(classes: np.ndarray) -> np.ndarray:
    """The histogram to compare: both kinds of white space are one class."""
    return np.concatenate([[classes[WHITE] + classes[SPACE]], classes[LOWER:]])


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    total = sum(float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum()) for x in (p, q))
    return math.sqrt(max(0.0, total / 2))


def repeated_words(text: str, width: int = 5) -> int:
    """Words in windows of ``width`` words that the text holds twice or more."""
    words = word_hashes(text)
    windows = window_hashes(words, width)
    if not len(windows):
        return 0
    _, where, uses = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.flatnonzero(uses[where] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_failed(words: int, repeats: int) -> bool:
    """Too few words, or over a fifth of them in repeated windows."""
    return words < 10 or 100 * repeats > 20 * words


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", common: int = 32) -> dict[str, tuple[np.ndarray, list[bytes], np.ndarray]]:
    """Per language: character classes of its texts, the ``common`` most used words, and their uses with the rest last.

    Counts cover all rows with a language that pass the base rule, so that what
    a few texts repeat thousands of times is not taken for the language. Tasks add up before the shuffle and
    only the few words kept per language come to the driver. Equal counts are
    ordered by word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CLASSES, dtype=np.int64))

        def flush() -> pa.RecordBatch:
            langs = [lang for lang, counter in words.items() for _ in counter] + [lang for lang in classes for _ in range(CLASSES)]
            keys = [word for counter in words.values() for word in counter] + [None] * (CLASSES * len(classes))
            kinds = [None] * sum(map(len, words.values())) + [k for _ in classes for k in range(CLASSES)]
            uses = [n for counter in words.values() for n in counter.values()] + [int(n) for counts in classes.values() for n in counts]
            words.clear()
            classes.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.binary()), pa.array(kinds, pa.int32()), pa.array(uses, pa.int64())], names=["lang", "word", "kind", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, text = lang.as_py(), text.as_py()
                found = text.encode().lower().split()
                if base_failed(len(found), repeated_words(text)):
                    continue
                words[lang].update(found)
                classes[lang] += char_classes(text)
                if sum(map(len, words.values())) > _FLUSH:
                    yield flush()
        yield flush()
        pa.default_memory_pool().release_unused()

    texts = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = stage(texts.mapInArrow(run, "lang string, word binary, kind int, n long").groupBy("lang", "word", "kind").agg(F.sum("n").alias("n")), "reference-words")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    totals = counts.groupBy("lang", F.col("word").isNull().alias("absent")).agg(F.sum("n").alias("total"))
    top = counts.where("word is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= common).drop("rank")
    chosen = top.unionByName(counts.where("word is null")).join(totals, "lang").where("absent = (word is null)").collect()
    out: dict[str, tuple[np.ndarray, list[bytes], np.ndarray]] = {}
    for lang in {r["lang"] for r in chosen}:
        own = [r for r in chosen if r["lang"] == lang]
        classes = np.zeros(CLASSES)
        for r in own:
            if r["word"] is None:
                classes[r["kind"]] = r["n"]
        words = sorted((r for r in own if r["word"] is not None), key=lambda r: (-r["n"], bytes(r["word"])))
        uses = np.array([r["n"] for r in words] + [(words[0]["total"] if words else 0) - sum(r["n"] for r in words)], dtype=float)
        out[lang] = (shape(classes), [bytes(r["word"]) for r in words], uses)
    return out


def judge(docs: DataFrame, refs: dict, limits: Limits = Limits(), id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance)`` per row, and columns ``also``."""
    kind = docs.schema[id_col].dataType.simpleString()
    more = [docs.schema[c] for c in also]
    fields = f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
    fields += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in more)

    def measures(text: str, lang: str | None) -> tuple:
        words = Counter(text.encode().lower().split())
        classes = char_classes(text)
        n = sum(words.values())
        repeats = repeated_words(text)
        failed = base_failed(n, repeats)
        mine = [refs[lang]] if lang in refs else list(refs.values())
        char = min((distance(shape(classes), ref[0]) for ref in mine), default=0.0)
        word = 1.0 if mine else 0.0
        for _, common, uses in mine:
            own = [words[w] for w in common]
            word = min(word, distance(np.array([*own, n - sum(own)], dtype=float), uses))
        far = n >= limits.char_guard and char > limits.char_limit + limits.char_slack / math.sqrt(n)
        far |= n >= limits.word_guard and word > limits.word_limit + limits.word_slack / math.sqrt(n)
        return n, len(text) - int(classes[WHITE]), int(classes[SYMBOL]), duplicate_lines(text), repeats, failed, not failed and not far, char, word

    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    # a column that is also wanted is not sent twice
    sent = [*also, *(c for c in (text_col, lang_col) if c not in also)]
    at = [1 + sent.index(c) for c in (text_col, lang_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                rows = [measures(text.as_py() or "", lang.as_py()) for text, lang in zip(batch.column(at[0]), batch.column(at[1]))]
                columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), types)]
                names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance", *also]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[1 : 1 + len(also)]], names=names)
        pa.default_memory_pool().release_unused()

    return docs.select(id_col, *(F.col(c).alias(f"_{k}") for k, c in enumerate(sent))).mapInArrow(run, fields)


def quality(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The measures and the verdict for every row of ``docs``, against references from all of them.

    A text with a known language is compared with that one, others with the
    nearest. Null and empty texts have no words and fail the base rule. Texts
    shorter than a guard are not judged by that histogram. With no reference at
    all the base rule decides alone. Repeated rows are judged each.
    """
    return judge(docs, references(docs, lang_col, text_col, limits.common), limits, id_col, lang_col, text_col)


def keep_good(docs: DataFrame, limits: Limits = Limits(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, in one pass after the references; nothing is shuffled."""
    refs = references(docs, lang_col, text_col, limits.common)
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    lang, text = (names[docs.columns.index(c)] for c in (lang_col, text_col))
    judged = judge(plain.withColumn("row", F.lit(None).cast("long")), refs, limits, "row", lang, text, tuple(names))
    return judged.where("kept").select(*names).toDF(*docs.columns)


@query("op7_quality", quality_sql(Limits()))
def op7_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")
