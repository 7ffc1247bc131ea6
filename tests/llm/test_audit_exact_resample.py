"""Filter interactions, exact duplicates and importance resampling against brute force, and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corroborate.llm import audit, exact, resample

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, n long, class long, score double, rank long, id string, digest string"
LONG = "wort " * 300_000 + "ende"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    body = " ".join(f"W{k}" for k in range(240))
    texts = [None, "", " \t\n", "one two three", "ONE two\tthree", body, body + " tail", body, LONG, "a\x1cb c d", "!!! ??? #", "x" * 5000, "é È ÀÇ " * 30, "the the the " * 90]
    rows = [(k, t, ["en", None, "de", ""][k % 4], "s", None, "p", 1, 2, 3, 0.5, 1, "i", "d") for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, body, "en", *[None] * 10), (None, body, None, *[None] * 10), (None,) * 13, (99, LONG, "xx", *[None] * 10)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


# interactions of filters


def brute_audit(rows, labels):
    """rows: (doc_id, text, lang)."""
    least, fails = {}, []
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    for d, t, lang in rows:
        t = t or ""
        w = space_words(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and least[t] < d}
        fails.append((lang or "", {k for k, v in bad.items() if v}, *(labels.get(d, (0, 0)) if d is not None else (0, 0))))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for k, letter in enumerate(order):
                before = set(order[:k])
                gone = [f for f in own if letter in f[1] and not f[1] & before]
                shapley[letter] += len(gone)
                kept = sum(not f[1] & {*before, letter} for f in own)
                late = sum(letter in f[1] and bool(f[1] & before) for f in own)
                out[part, "".join(order), k + 1] = [kept, len(gone), late, sum(f[1] == {letter} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return out


def as_rows(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in df.collect()}


def marks(labels):
    out = {}
    for r in labels.collect():
        if r["doc_id"] is not None:
            good, toxic = out.get(r["doc_id"], (0, 0))
            out[r["doc_id"]] = (good | (r["quality"] == 1), toxic | (r["toxic"] == 1))
    return out


def test_audit_against_brute_force(spark, docs, labels):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert as_rows(audit.audit(docs, labels)) == brute_audit(rows, marks(labels))


def test_audit_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (7, 1, None), (None, 1, 1), (1234, 1, 1), (8, None, 1)], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    assert as_rows(audit.audit(odd, labels)) == brute_audit(rows, marks(labels))
    assert audit.audit(none, labels).count() == 0
    assert as_rows(audit.audit(odd, labels.limit(0))) == brute_audit(rows, {})


def test_audit_deals_parts_to_several_recursions(spark, monkeypatch):
    cells = spark.createDataFrame([(f"p{k}", m, k + 1, 1, 0) for k in range(9) for m in (0, 1, 3)], "part string, mask int, n long, good long, toxic long")
    whole = as_rows(audit.interactions(cells, "AB"))
    monkeypatch.setattr(audit, "_ROWS", 10)
    assert as_rows(audit.interactions(cells, "AB")) == whole and len(whole) == 9 * 2 * 2
    assert whole["p2", "AB", 1] == [3, 6, 0, 3, 2, 0, 9] and whole["p2", "BA", 2] == [3, 3, 3, 3, 1, 0, 9]


# exact duplicates


def test_trie_tells_strings_apart_and_gives_them_back():
    rng = np.random.default_rng(1)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 12)).tolist()) for _ in range(2000)]
    trie = exact.Trie()
    for s in strings:
        node = trie.place(s)
        node[2] = (node[2] or 0) + 1
    assert dict(exact.entries(trie.root)) == Counter(strings)


def test_trie_refuses_what_was_evicted():
    trie = exact.Trie()
    strings = [b"ab", b"abc", b"abd", b"b", b""]
    for s in strings:
        trie.place(s)[2] = s
    cut = dict(trie.evict())
    assert set(cut) == {b"ab", b"abc", b"abd"} and trie.place(b"abzz") is None and trie.place(b"ab") is None
    assert trie.place(b"a") is not None and trie.place(b"b")[2] == b"b"
    single = exact.Trie()
    single.place(b"x" * 100)[2] = 1
    assert single.evict() == []


def brute_exact(rows, keep=max):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = Counter()
    for t, ids in groups.items():
        held = [d for d in ids if d is not None]
        best = keep(held) if held else None
        stays = True
        for d in sorted(ids, key=lambda d: d != best):
            out[d, best, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()] += 1
            stays = False
    return out


def got_exact(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


@pytest.mark.parametrize("budget", [exact.BUDGET, 3000])
def test_exact_against_brute_force(spark, docs, odd, none, budget):
    for rows in (docs, odd):
        want = [(r["doc_id"], r["text"]) for r in rows.collect()]
        assert got_exact(exact.exact_groups(rows, budget=budget)) == brute_exact(want)
    assert exact.exact_groups(none).count() == 0


def test_exact_other_ids_and_smallest(spark, odd):
    named = odd.select(F.concat(F.lit("k"), F.col("doc_id")).alias("doc_id"), "text")
    want = [(r["doc_id"], r["text"]) for r in named.collect()]
    assert got_exact(exact.exact_groups(named, keep="smallest")) == brute_exact(want, min)
    kept = exact.drop_copies(odd).collect()
    assert sorted(r["text"] for r in kept) == sorted({t or "" for _, t in want})


def test_exact_hot_text_sends_one_copy_per_task(spark):
    rows = spark.range(0, 3000, numPartitions=6).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same " * 200)).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    local = exact._local(rows.select(F.col("doc_id").alias("id"), "text"), "bigint", True, exact.BUDGET)
    assert local.where("text like 'same%'").count() == 6
    assert exact.exact_groups(rows).where("kept").count() == 1001


# importance resampling


def brute_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute_resample(rows, targets):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    split = {k: brute_features(t) for k, (_, t) in enumerate(rows)}
    s = Counter(bucket(f) for _, fs in split.values() for f in fs)
    t = Counter(bucket(f) for text in targets for f in brute_features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for k, (d, _) in enumerate(rows):
        w, fs = split[k]
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = None if d is None else int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        score = None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(fs), weight, score, None, len(w)])
    fit = sorted((r for r in out if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def got_resample(df):
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect())


def test_resample_against_brute_force(spark, sf, docs, odd, none):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [r["text"] for r in target.collect()]
    for rows in (docs, odd):
        assert got_resample(resample.resample(rows, target)) == brute_resample([(r["doc_id"], r["text"]) for r in rows.collect()], texts)
    assert resample.resample(none, target).count() == 0
    assert got_resample(resample.resample(docs, none)) == brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [])


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_features_of_texts_in_pieces(monkeypatch, longest):
    texts = ["a b c d e f g h i j", "", "--", "one", "x y " * 40, "é" * 90 + " z " + "q" * 70]
    count = lambda: [Counter() for _ in texts]

    def features():
        out, n = count(), [0] * len(texts)
        for rows, spans, table, counts in resample.interned(pa.array(texts), 97, longest):
            assert all(table.bucket[table.slot[k]] == zlib.crc32(spans.of(k)) % 97 for k in range(len(counts)))
            for k in np.flatnonzero(counts):
                out[rows[spans.doc[k]]][spans.of(k)] += 1
            for r, w in zip(rows, spans.words, strict=True):
                n[r] += int(w)
        return out, n

    whole = features()
    want = count()
    for k, t in enumerate(texts):
        w = brute_features(t)[0]
        want[k].update(" ".join(w[i : i + m]).encode() for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    assert whole == (want, [len(brute_features(t)[0]) for t in texts])
    monkeypatch.setattr(resample, "CHUNK", 7)
    assert features() == whole


def test_spans_hash_like_xxhash_and_are_told_apart_by_bytes(monkeypatch):
    texts = [b" ".join(bytes([97 + k % 26]) * n for k, n in enumerate(range(1, 45))), b"a b a b", b"c" * 64 + b" " + b"c" * 65]
    spans = resample.Spans(texts, 2)
    assert spans.hashes().tolist() == [xxh64_intdigest(spans.of(k)) for k in range(len(spans.start))]
    monkeypatch.setattr(resample.Spans, "hashes", lambda self: np.zeros(len(self.start), dtype=np.uint64))
    table = resample.Interned(spans, 10000)
    named = defaultdict(set)
    for k, slot in enumerate(table.slot):
        named[int(slot)].add(spans.of(k))
    assert all(len(v) == 1 for v in named.values()) and len(named) == len({spans.of(k) for k in range(len(spans.start))})
