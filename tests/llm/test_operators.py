"""The training-data operators against brute force, and on awkward rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corroborate.llm import hashindex, langid, lattice, lines, mixing, packing, quality, simhash, substring, warc
from corroborate.llm.common import window_hashes, word_hashes
from corroborate.session import stage

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKENS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, size int, score double, id string, h int"
LONG = "wort " * 30_000 + "ende"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    body = " ".join(f"w{k}" for k in range(120))
    texts = [None, "", " \t\n", "one two three", "ONE two\tthree", body, body + " tail", body, LONG, "a\x1cb c d", "!!! ???", "x" * 5000]
    rows = [(k, t, "en" if k % 3 else None, ["s1", None, "s2"][k % 3], None, "f", 1, 0.5, "i", 3) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, body, "en", "s1", 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text):
    return (text or "").encode().split()


def test_window_hashes_tell_windows_apart():
    text = "a b c a b c d a b"
    w = words(text)
    for n in (1, 2, 3, 5, 9, 10):
        hashes = window_hashes(word_hashes(text), n)
        plain = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        assert [[a == b for b in hashes] for a in hashes] == [[a == b for b in plain] for a in plain]


def test_long_text_hashes_like_its_parts():
    text = "abc def " * 200_000
    hashes = word_hashes(text)
    assert len(hashes) == 400_000 and len(set(hashes.tolist())) == 2


# language


def test_language_held_out_accuracy(docs):
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[[zlib.crc32(str(d).encode()) % 4 == 2 for d in found.doc_id]]
    assert len(found) == docs.count() and len(held) > 20
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_language_ignores_label_and_source(docs):
    model = langid.fit(langid.sample(docs, 50, "doc_id", "text", "lang", 4), 16)
    a = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), model).collect()}
    assert a == b


def test_language_kernel_is_folded_exactly():
    spectrum = langid.Spectrum()
    texts = [("en", "the cat and the dog"), ("de", "der hund und die katze"), ("en", "a dog of the house"), ("de", "das haus der katze")]
    samples = [(lang, spectrum(t)) for lang, t in texts]
    model = langid.fit(samples, landmarks=2)
    x = set(spectrum("the house and the cat").tolist())
    marks = [set(g.tolist()) for _, g in samples]
    kernel = np.array([len(x & m) / math.sqrt(len(x) * len(m)) for m in marks])
    gram = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in marks] for a in marks])
    present = np.zeros(len(model.weights))
    at = model.column[np.array(sorted(x))]
    present[at[at >= 0]] = 1 / math.sqrt(len(x))
    targets = np.array([[lang == other for other in model.langs] for lang, _ in texts]) * 2.0 - 1
    values, vectors = np.linalg.eigh(gram)
    root = vectors / np.sqrt(values)
    features = np.hstack([gram @ root, np.ones((4, 1))])
    penalty = 1e-3 * 4 * np.eye(5)
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(features.T @ features + penalty, features.T @ targets)
    assert np.allclose(present @ model.weights + model.bias, np.append(kernel @ root, 1) @ solved, atol=1e-3)


def test_language_learns_beside_a_hot_copy(spark):
    rows = [(k, "die alte geschichte", "de") for k in range(9900)] + [(10_000 + k, f"wort{k} und noch eines", "de") for k in range(100)] + [(20_000 + k, f"word{k} and one more", "en") for k in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = Counter(lang for lang, _ in langid.sample(table, 50, "doc_id", "text", "lang", 4))
    assert learned == {"de": 50, "en": 50}


def test_language_odd_rows(odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["lang_pred"] == by[1]["lang_pred"] == by[10]["lang_pred"] == "und" and by[10]["score"] == 0
    assert by[3]["lang_pred"] == "en"
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# packing


def fits(items, capacity):
    rooms = []
    for length in sorted(items, reverse=True):
        fit = [r for r in rooms if r >= length]
        room = min(fit) if fit else capacity
        if fit:
            rooms.remove(room)
        rooms.append(room - length)
    return len(rooms)


def laid_out(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_best_fit(docs):
    rows = packing.pack_documents(docs, TOKENS, 256).collect()
    assert laid_out(rows, 256) == fits([r["length"] for r in rows], 256)


def test_packing_pieces_are_the_ids(docs):
    tokenizer = packing._tokenizer(TOKENS)
    parts = {(r["doc_id"], r["piece"]): r for r in packing.pack_documents(docs, TOKENS, 256).collect()}
    seen = 0
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for k, start in enumerate(range(0, len(ids), 256)):
            part = ids[start : start + 256]
            got = parts[r["doc_id"], k]
            assert (got["start"], got["length"], got["ids_crc32"]) == (start, len(part), zlib.crc32(part.tobytes()))
            seen += 1
    assert seen == len(parts)


def test_packing_hot_length_in_buckets(spark):
    parts = spark.range(5000).select(F.col("id"), F.lit(0).alias("piece"), F.lit(7).cast("long").alias("ids_crc32"), F.when(F.col("id") % 3 == 0, 3).otherwise(F.col("id") % 9 + 1).cast("long").alias("length"))
    rows = packing.pack(parts, 10, bucket=50).collect()
    assert len(rows) == 5000 and laid_out(rows, 10) == fits([r["length"] for r in rows], 10)


def test_packing_encoder_special_strings():
    texts = ["İ; İ; ù, x̀. ab.. ab'. A<|ENDOFTEXT|>, Ab,", "a<|endoftext|>b it's WE'LL", "́x é \x85 　z", "İ ǅ 12ab", None, "", "<|startoftext|>"]
    encode = packing.Encoder(TOKENS)
    plain = [packing._tokenizer(TOKENS).encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert [list(ids) for ids in encode(texts)] == plain == [list(ids) for ids in encode(texts)]


def test_packing_encodes_words_together(monkeypatch):
    """Different words are encoded some hundred to a text; what comes back are the ids of each text."""
    letters = "abcdefghijklmnoprstuvwé"
    words = [letters[k % 23] + letters[k // 23 % 23] + letters[k * 7 % 23] + "tion" * (k % 3) for k in range(3000)]
    texts = [" ".join(words[:2000]), "It's " + "\n\x0b".join(w.upper() + "," for w in words[1000:]) + " ß İx 7up", None, " ", "<|endoftext|>"]
    tokenizer, given = packing._tokenizer(TOKENS), []

    class Counted:
        def encode_batch_fast(self, some, **options):
            given.extend(some)
            return tokenizer.encode_batch_fast(some, **options)

    packing._lasts(TOKENS)
    monkeypatch.setattr(packing, "_tokenizer", lambda path: Counted())
    plain = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert [list(ids) for ids in packing.Encoder(TOKENS)(texts)] == plain
    assert len(given) < 50


def test_packing_slices_hold_all_rows():
    texts = ["a" * 10, None, "", "b" * 95, "c" * 4, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["id", "text"])
    some = list(packing._slices(batch, 20))
    assert [t for s in some for t in s.column(1).to_pylist()] == texts and len(some) > 1
    assert [s.num_rows for s in packing._slices(batch.slice(0, 0), 20)] == [0]


def test_packing_odd_rows(odd, none):
    rows = packing.pack_documents(odd, TOKENS, 64).collect()
    laid_out(rows, 64)
    assert sum(r["piece"] == 0 for r in rows) == odd.count()
    assert packing.pack_documents(none, TOKENS).count() == 0


# lines


def test_lines_ratio_guard_and_hosts(spark):
    rows = [(k, "http://A.example/x" if k < 30 else "http://b.example", "<p>same</p><p>own %d</p><script>x='</p>'</script>" % k) for k in range(40)]
    rows += [(99, None, "<p>same</p>"), (98, "http://a.example", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in lines.drop_boilerplate(pages, lines.host(F.col("url")), lines.html_lines(F.col("html"))).collect()}
    assert got[3]["kept"] == ["own 3"] and got[3]["site"] == "a.example"
    assert got[35]["kept"] == ["own 35"]
    assert got[99]["kept"] == ["same"] and got[98]["kept"] is None


def test_lines_of_small_sites_and_clashing_columns(spark):
    rows = [(k, f"http://s{n}.example/{k}", "<p>foot</p><p>own %d</p>" % k, "mine", "kept", "x") for n in (1, 2, 3, 19) for k in range(100 * n, 100 * n + n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _site string, kept string, marks string")
    got = {r["page_id"]: r for r in lines.drop_boilerplate(pages, lines.host(F.col("url")), lines.html_lines(F.col("html"))).collect()}
    assert got[100]["kept"] == ["foot", "own 100"] and got[201]["kept"] == ["foot", "own 201"]
    assert got[302]["kept"] == ["own 302"] and got[1918]["kept"] == ["own 1918"]
    assert got[302]["_site"] == "mine" and got[302]["marks"] == "x"


def test_lines_odd_rows(odd, none):
    got = lines.clean_documents(odd, ratio=0.5, least=2)
    assert got.columns == odd.columns and got.schema == odd.schema and got.count() == odd.count()
    assert lines.clean_documents(none).count() == 0


def test_lines_whole_copies_stay(spark):
    rows = spark.createDataFrame([(k, "head\nbody" if k < 15 else f"head\n\nown {k}", "s") for k in range(30)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in lines.clean_documents(rows).collect()}
    assert got[0] == "head\nbody" and got[20] == "\nown 20"


# nearest neighbours


def brute(rows, k):
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], dtype=np.float64)
    norms = np.sqrt((v * v).sum(axis=1))
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        scores = (v * v[q]).sum(axis=1) / (norms * norms[q])
        keep = ids != ids[q]
        order = np.lexsort((ids[keep], -scores[keep]))[:k]
        out[int(ids[q])] = [(int(i), float(s)) for i, s in zip(ids[keep][order], scores[keep][order])]
    return out


def test_nearest_recall(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in table.collect()], 5)
    got = {}
    for r in hashindex.nearest(table, F.col("vec_id") % 50 == 0, sample=200, block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    found = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert found >= 0.9 * 5 * len(want)
    for q in want:
        exact = dict(want[q])
        assert all(abs(exact[i] - s) < 1e-12 for i, s in got[q] if i in exact) and len(got[q]) == 5


def test_nearest_odd_vectors_ties_and_few(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [-1.0, 0.5]), (9, []), (10, [1.0]), (None, [1.0, 1.0]), (50, [0.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hashindex.nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 8), (50, 1, 8), (50, 2, 0), (50, 3, 1), (50, 4, 2)]
    assert hashindex.nearest(table.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_hot_vector(spark):
    rows = [(k, [1.0, 0.0, 0.1]) if k % 3 == 0 else (k, [float(np.sin(k)), float(np.cos(k)), 0.3]) for k in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in hashindex.nearest(table, F.col("vec_id") % 50 == 0, sample=100, block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == [3, 6, 9, 12, 15] and len(got) == 12


def test_nearest_within_each_length_and_any_scale(spark):
    short = [(0, [1e-200, 2e-200]), (1, [1e200, 2e200]), (2, [2.0, 1.0]), (3, [-1.0, 0.0]), (4, [5e-324, 0.0])]
    long = [(50, [1.0, 0.0, 0.0]), (51, [0.9, 0.1, 0.0])]
    clash = "vec_id long, embedding array<double>, score double, code long, is_row boolean, part int"
    table = spark.createDataFrame([(*r, None, 1, False, 2) for r in short + long], clash)
    got = {}
    for r in hashindex.nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    assert got == {0: [(1, 1.0), (2, 0.8), (4, round(1 / 5**0.5, 9)), (3, -round(1 / 5**0.5, 9))], 50: [(51, round(0.9 / 0.82**0.5, 9))]}


# mixing


def test_mixing_targets_and_nearness(spark):
    rows = [(k, "w " * (1 + k % 7), "abc"[k % 3] if k % 11 else None) for k in range(3000)] + [(k, "x", "z") for k in range(5000, 5010)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(table).join(table.select("doc_id", "source"), "doc_id").toPandas()
    again = mixing.mix(table.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"] == 0).all()
    total = got["size"].sum()
    assert abs(got.drop_duplicates(["source"]).target.sum() - total) < 1e-6 * total
    for _, part in got.groupby("source", dropna=False):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max() / 2
        assert part.target.iloc[0] <= 3 * part["size"].sum()


def test_mixing_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and mixing.mix(none).count() == 0
    assert {r["size"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    clash = odd.withColumnsRenamed({"size": "row", "score": "passes", "fingerprint": "threshold", "n_chars": "time"})
    assert mixing.take(clash).columns == clash.columns and mixing.take(clash).count() == mixing.take(odd).count()


def test_mixing_rows_come_as_often_as_taken(docs):
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect() if r["size"]}
    rows = Counter(r["doc_id"] for r in mixing.take(docs).select("doc_id").collect())
    assert all(rows[d] == n for d, n in taken.items())


# archives


def archive(spark, tmp_path, pages, **more):
    folder = f"file://{tmp_path}/warc"
    return stage(warc.write_archives(pages, folder, **more), "files")


def test_archive_round_trip_at_any_split(spark, tmp_path):
    import gzip

    inner = gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", 0).decode("latin-1")
    pages = [(k, f"http://h/{k}", ["same", None, "", "ü" * k, inner, "tail\r\n\r\n"][k % 6]) for k in range(60)] + [(None, None, "no id"), (7, "http://h/a b\n", "twice"), (7, "http://h/a b\n", "twice")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    files = archive(spark, tmp_path, table)
    whole = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(files).collect())
    assert len(whole) == len(pages)
    for split in (97, 1000, 5000):
        assert whole == sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(files, split).collect())
    first = {}
    for page, _, html in pages:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    for page, _, html in pages:
        low, data = first.get(html or ""), (html or "").encode()
        name = "urn:page:null" if page is None else f"urn:page:{page}"
        revisit = low is not None and low != page
        assert (name, "revisit" if revisit else "response", f"urn:page:{low}" if revisit else "", len(data), warc.digest(data)) in whole


def test_archive_ranges_are_dealt_to_tasks(spark):
    files = spark.createDataFrame([(f"/none/{k}.warc.gz", 1000) for k in range(40)], "path string, bytes long")
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    read = warc.read_archives(files, 40)
    assert read.rdd.getNumPartitions() == 1000
    assert warc.read_archives(files, 40, tasks=64).rdd.getNumPartitions() == 64
    assert warc.read_archives(files.where("bytes < 0")).count() == 0


def test_archive_of_pages_with_clashing_columns(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "same", "p", 1, "r"), (2, None, "same", None, 2, None), (3, "v", None, "", None, "x")], "page_id long, url string, html string, path string, bytes long, record_id string")
    found = {r["record_id"]: r["record_type"] for r in warc.read_archives(archive(spark, tmp_path, pages)).collect()}
    assert sorted(found.values()) == ["response", "response", "revisit"]


def test_archive_is_plain_gzip_and_small_payloads_are_responses(spark, tmp_path):
    import gzip

    table = spark.createDataFrame([(1, "http://h/", "ab"), (2, "http://h/", "ab"), (3, "http://h/", "long one"), (4, "http://h/", "long one")], "page_id long, url string, html string").coalesce(1)
    files = archive(spark, tmp_path, table, least=5)
    kinds = {r["record_id"]: r["record_type"] for r in warc.read_archives(files).collect()}
    assert kinds == {"urn:page:1": "response", "urn:page:2": "response", "urn:page:3": "response", "urn:page:4": "revisit"}
    data = b"".join(gzip.open(r["path"].removeprefix("file://")).read() for r in files.collect())
    assert data.count(b"WARC/1.1\r\n") == 4
    assert warc.read_archives(archive(spark, tmp_path, table.where("page_id < 0"))).count() == 0


# quality


def test_quality_base_measures(docs):
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for r in docs.collect():
        text, w = r["text"] or "", words(r["text"])
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        uses, covered = Counter(windows), set()
        for i, window in enumerate(windows):
            if uses[window] > 1:
                covered.update(range(i, i + 5))
        filled = [line for line in text.split("\n") if words(line)]
        mine = got[r["doc_id"]]
        assert mine["n_words"] == len(w) and mine["word_chars"] == len(b"".join(w).decode())
        assert mine["n_symbols"] == sum(c in "#*$%&|<>" for c in text) and mine["n_dup_lines"] == len(filled) - len(set(filled))
        assert mine["n_repeat_words"] == len(covered)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert mine["base_failed"] == failed and not (failed and mine["kept"])


def test_quality_verdict_against_brute_force(docs):
    limits = quality.Limits()
    rows = docs.collect()
    uses, shapes = {}, {}
    base = {r["doc_id"]: r["base_failed"] for r in quality.quality(docs).collect()}
    for r in rows:
        if base[r["doc_id"]]:
            continue
        uses.setdefault(r["lang"], Counter()).update((r["text"] or "").encode().lower().split())
        shapes[r["lang"]] = shapes.get(r["lang"], 0) + quality.shape(quality.char_classes(r["text"] or ""))

    def entropy(p):
        return -sum(x * math.log2(x) for x in p if x)

    def js(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        return math.sqrt(max(0, entropy([(a + b) / 2 for a, b in zip(p, q)]) - (entropy(p) + entropy(q)) / 2))

    for r, mine in zip(sorted(rows, key=lambda r: r["doc_id"]), sorted(quality.quality(docs).collect(), key=lambda r: r["doc_id"])):
        n, ref = mine["n_words"], uses[r["lang"]]
        if not n:
            continue
        top = [w for w, _ in sorted(ref.items(), key=lambda x: (-x[1], x[0]))[: limits.common]]
        own = Counter((r["text"] or "").encode().lower().split())
        char = js(quality.shape(quality.char_classes(r["text"])), shapes[r["lang"]])
        word = js([own[w] for w in top] + [n - sum(own[w] for w in top)], [ref[w] for w in top] + [sum(ref.values()) - sum(ref[w] for w in top)])
        assert abs(char - mine["char_distance"]) < 1e-6 and abs(word - mine["word_distance"]) < 1e-6
        far = char > limits.char_limit + limits.char_slack / math.sqrt(n) or (n >= limits.word_guard and word > limits.word_limit + limits.word_slack / math.sqrt(n))
        assert mine["kept"] == (not mine["base_failed"] and not far)


def test_quality_keeps_the_good_and_drops_the_bad(spark):
    at = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{at}/documents.parquet")
    got = quality.quality(table).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").toPandas()
    good, bad = got[(got.quality == 1) & ~got.base_failed], got[got.quality == 0]
    assert good.kept.mean() > 0.995 and bad.kept.mean() < 0.05


def test_quality_odd_rows(odd, none):
    got = quality.quality(odd).collect()
    assert len(got) == odd.count() and not any(r["kept"] for r in got if r["n_words"] < 10)
    assert quality.quality(none).count() == 0
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(none).count() == 0


# likelihood


def test_lattice_sums_all_segmentations():
    pieces, weights = lattice.vocabulary(PIECES)
    scores, at = np.log(weights / weights.sum()), {p: k for k, p in enumerate(pieces)}

    def spelled(symbols):
        if not symbols:
            return 1.0
        return sum(math.exp(scores[at[symbols[:k]]]) * spelled(symbols[k:]) for k in range(1, len(symbols) + 1) if symbols[:k] in at)

    some = [b"the", b"at", "größe".encode(), b"zq", "a▁".encode()]
    got, used = lattice.forward(some, *lattice.trie(PIECES), scores, np.ones(len(some)))
    assert np.allclose(got, [math.log(spelled((lattice.MARK, *w))) for w in some])
    assert used.sum() > len(some)


def test_lattice_training_helps_and_base_is_exact(docs):
    rows = docs.collect()
    got = {r["doc_id"]: r for r in lattice.score_texts(docs, PIECES, frequent=50).collect()}
    plain = {r["doc_id"]: r for r in lattice.score_texts(docs, PIECES, rounds=0, frequent=50).collect()}
    counts = Counter()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            counts.update((r["text"] or "").encode().lower().split())
            counts[None] += 1
    total, distinct = sum(counts.values()), len(counts)
    for r in rows:
        tokens = [*(r["text"] or "").encode().lower().split(), None]
        mine = got[r["doc_id"]]
        assert mine["n_tokens"] == len(tokens) and mine["n_known"] == sum(t in counts for t in tokens) and mine["train_tokens"] == total
        assert math.isclose(mine["base_score"], sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens), rel_tol=1e-9)
    held = [d for d in got if got[d]["held_out"]]
    assert sum(got[d]["score"] for d in held) > sum(plain[d]["score"] for d in held)
    assert all(r["score"] < 0 for r in got.values())


def test_lattice_odd_rows(odd, none):
    got = lattice.score_texts(odd, PIECES, rounds=1, frequent=2).collect()
    assert len(got) == odd.count()
    empty = [r["score"] for r in got if r["n_tokens"] == 1]
    assert len(empty) >= 3 and len(set(empty)) == 1
    assert lattice.score_texts(none, PIECES, rounds=1).count() == 0


# near duplicates


def test_simhash_components_against_brute_force(docs):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, leaf=16).collect()}
    from xxhash import xxh64_intdigest

    prints = {}
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        hashes = [xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))] if w else []
        prints[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    ids = sorted(prints)
    name = {d: d for d in ids}
    for _ in range(10):
        for a in ids:
            for b in ids:
                if name[b] < name[a] and (prints[a] ^ prints[b]).bit_count() <= 2:
                    name[a] = name[b]
    for d in ids:
        assert got[d]["fingerprint"] == f"{prints[d]:016x}" and got[d]["component_id"] == name[d]


@pytest.mark.parametrize("budget", [2, 5, 10])
def test_simhash_trie_finds_every_pair(budget):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    keys = np.unique(np.concatenate([base, *(base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, e)).astype(np.uint64), axis=1) for e in range(1, budget + 2))]))
    want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= budget}
    found = set()
    for bits in range(0, 64, 16):
        turned = simhash._turn(keys, bits)
        order = np.argsort(turned)
        for i, j in simhash.trie_pairs(turned[order], None, 63, simhash.schedule(budget)):
            found |= {(min(a, b), max(a, b)) for a, b in zip(order[i].tolist(), order[j].tolist())}
    assert found == want


def test_simhash_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 200)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 51)} | {k: 100 for k in range(101, 200)}


def test_simhash_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and got[0].asDict().keys() == {"doc_id", "fingerprint", "component_id"}
    by = {r["doc_id"]: r for r in got}
    assert by[0]["fingerprint"] == "0" * 16 and by[2]["component_id"] == 0 and by[4]["component_id"] == 3 and by[7]["component_id"] == 5
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    clash = odd.withColumnsRenamed({"size": "row", "score": "_id", "fingerprint": "hash", "n_chars": "_hash"})
    assert simhash.keep_one(clash).columns == clash.columns
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] in (0, 1, 2, 3, 4, 5, 7)) == [0, 3, 5]


def test_simhash_keeps_one_of_near_copies(spark):
    rng = np.random.default_rng(3)
    texts = []
    for k in range(30):
        base = [f"t{k}w{x}" for x in rng.integers(0, 10**6, 400)]
        for copy in range(3):
            mine = list(base)
            for at in rng.integers(0, 400, copy * 3):
                mine[at] = "other"
            texts.append((3 * k + copy, " ".join(mine)))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert kept >= {3 * k for k in range(30)} and len(kept) <= 30 + 2


def jaccard_groups(texts, width=5):
    """Pairs with a Jaccard similarity of 0.8 or more, and each id's smallest linked id."""
    sets = {}
    for d, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[d] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    shared = Counter((a, b) for ds in holders.values() for k, a in enumerate(ds) for b in ds[k + 1 :])
    pairs = {(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)}
    name = {d: d for d in texts}
    empty = [d for d in sorted(texts) if not sets[d]]
    linked = sorted(pairs | {(empty[0], d) for d in empty[1:]})
    while any(name[a] != name[b] for a, b in linked):
        for a, b in linked:
            name[a] = name[b] = min(name[a], name[b])
    return pairs, name


def test_simhash_links_by_exact_jaccard(spark):
    texts, pairs = {}, []
    for k in range(200):
        n = [14, 64, 204, 1004][k % 4]
        base = [f"t{k}w{x}" for x in range(n)]
        # a run of other words at the end: shared shingles over all different ones is about 0.8 or about 0.74
        shared = round((0.8 if k % 8 < 4 else 0.74) * 2 * (n - 4) / (1.8 if k % 8 < 4 else 1.74) + (0.5 if k % 8 < 4 else -0.5)) + 4
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(base[:shared] + [f"o{k}w{x}" for x in range(n - shared)])
    want, name = jaccard_groups(texts)
    assert 90 <= len(want) <= 110
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    clean = {d for d in texts if name[d] == d}
    assert clean <= kept and len(kept - clean) <= 2


@pytest.mark.parametrize("block", [3, 512])
def test_simhash_compares_all_sets_of_a_component(spark, block):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**62, 40)
    sets = [(0, k, sorted({*base[rng.random(40) < 0.9].tolist(), k})) for k in range(30)] + [(100, 100, [1, 2]), (100, 101, [1, 2, 3, 4])]
    want = {(a, b) for r, a, x in sets for s, b, y in sets if r == s and a < b and 5 * len({*x} & {*y}) >= 4 * len({*x} | {*y})}
    pairs = {tuple(sorted(r)) for r in simhash.verified(spark.createDataFrame(sets, "root long, node long, hashes array<long>"), 0.8, block).collect()}
    group = lambda links: {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(sorted(links), "u long, v long")).collect()}
    assert want and group(pairs) == group(want)


def test_simhash_links_grow_with_members(spark):
    rng = np.random.default_rng(4)
    counts = []
    for m in (200, 400):
        near = [(k, int(np.bitwise_xor.reduce([1 << int(b) for b in rng.integers(0, 63, 2)])), k) for k in range(m)]
        rows = near + [(m + k, int(x), k) for k, x in enumerate(rng.integers(0, 2**62, 400))]
        found = simhash.thinned(simhash.links(spark.createDataFrame(rows, "node long, fingerprint long, second long"), 11, None, 64))
        counts.append(found.count())
    assert counts[0] <= 3 * 600 and counts[1] <= 3 * 800


def test_simhash_blocks_of_a_large_group(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**62, 60).tolist()
    near = [(0, k, sorted({*base, 10 + k})) for k in range(40)]
    chain = [(0, 100 + k, sorted({*base[:50], *range(1000 + 5 * k, 1012 + 5 * k)})) for k in range(6)]
    far = [(0, 200 + k, sorted(rng.integers(0, 2**62, 60).tolist())) for k in range(9)]
    links = simhash.verified(spark.createDataFrame(near + chain + far, "root long, node long, hashes array<long>"), 0.8, 4)
    assert links.count() <= 400
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    sets = {k: {*h} for _, k, h in near + chain + far}
    name = {k: k for k in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while any(name[a] != name[b] for a, b in pairs):
        for a, b in pairs:
            name[a] = name[b] = min(name[a], name[b])
    assert got == {k: v for k, v in name.items() if k != v}


# passages


def removed(rows, n):
    low = {}
    for d, w in sorted(rows, key=lambda r: r[0]):
        for k in range(len(w) - n + 1):
            low.setdefault(tuple(w[k : k + n]), d)
    out = {}
    for d, w in rows:
        gone = set()
        for k in range(len(w) - n + 1):
            if low[tuple(w[k : k + n])] < d:
                gone.update(range(k, k + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_passages_against_brute_force(docs):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup_passages(docs).collect()}
    assert got == removed([(r["doc_id"], words(r["text"])) for r in docs.collect()], 50)


@pytest.mark.parametrize("length", [4, 7])
def test_passages_of_few_words_that_overlap(spark, length):
    rng = np.random.default_rng(length)
    rows = [(k, " ".join(rng.choice(list("ab c".split()), rng.integers(0, 40)))) for k in range(80)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect()}
    assert got == removed([(k, words(t)) for k, t in rows], length)


def test_passages_odd_rows(spark, odd, none):
    got = substring.dedup_passages(odd).collect()
    assert len(got) == odd.count() and substring.dedup_passages(none).count() == 0
    lost = Counter((r["doc_id"], r["n_removed"]) for r in got)
    assert lost[5, 0] == 3 and lost[7, 120] == 1 and lost[6, 120] == 1 and lost[None, 0] == 2
    assert [r["kept"] for r in got if r["doc_id"] == 6] == ["tail"]
    twins = spark.createDataFrame([(1, "a b c d e f"), (1, "x a b c d"), (2, "a b c d q"), (2, "z z a b c d")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.dedup_passages(twins, length=4).collect()) == [(1, 5, 0), (1, 6, 0), (2, 5, 4), (2, 6, 4)]


# pipeline


def test_pipeline_stages_and_odd_rows(spark, sf, docs, odd, none):
    for rows in (docs, odd.select(*docs.columns), none.select(*docs.columns)):
        now = rows
        for name, step in corpus_pipeline.STAGES[:-1]:
            before, now = now, stage(step(spark, now, sf), name)
            assert now.columns == docs.columns, name
            if name == "line_dedup":
                assert now.count() == before.count()
        packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
        laid_out(packed, 2048)
        assert sum(r["piece"] == 0 for r in packed) == now.count()


def test_pipeline_against_brute_force(spark, sf, docs):
    stages = dict(corpus_pipeline.STAGES)
    now = {r["doc_id"]: r for r in docs.collect()}
    good = stage(stages["quality_rules"](spark, docs, sf), "t1")
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality(docs).collect()}
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(d for d in now if verdict[d])

    clean = stage(stages["line_dedup"](spark, good, sf), "t2")
    pages = {r["doc_id"]: r for r in good.collect()}
    holds, total = Counter(), Counter()
    for r in pages.values():
        total[r["source"]] += 1
        holds.update({(r["source"], line.strip(" ")) for line in r["text"].split("\n") if line.strip(" ")})
    for r in clean.collect():
        old = pages[r["doc_id"]]
        site = old["source"]
        kept = [x for x in old["text"].split("\n") if not x.strip(" ") or holds[site, x.strip(" ")] < 3 or holds[site, x.strip(" ")] <= total[site] * 0.1]
        text = "\n".join(kept) if any(x.strip(" ") for x in kept) else old["text"]
        assert r["text"] == text and r["n_chars"] == len(text)

    single = stage(stages["near_dedup"](spark, clean, sf), "t3")
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    _, name = jaccard_groups(texts)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(d for d in texts if name[d] == d)

    mixed = stage(stages["mixing"](spark, single, sf), "t4")
    rows = single.collect()
    sizes, total = {r["doc_id"]: len(words(r["text"])) for r in rows}, Counter()
    for r in rows:
        total[r["source"]] += sizes[r["doc_id"]]
    weight = {source: k % 3 + 1 for k, source in enumerate(sorted(total))}
    share, held = sum(total.values()) / sum(weight.values()), set()
    while over := {s for s in total if s not in held and share * weight[s] > 3 * total[s]}:
        held |= over
        share = (sum(total.values()) - sum(3 * total[s] for s in held)) / sum(weight[s] for s in total if s not in held)
    want = Counter()
    for source in total:
        target = min(3 * total[source], share * weight[source])
        passes = min(3, int(target // total[source]))
        budget, at = target - passes * total[source], 0
        own = sorted((int(hashlib.md5(f"{r['doc_id']}:{r['text']}".encode()).hexdigest()[:15], 16), r["doc_id"]) for r in rows if r["source"] == source)
        for _, d in own:
            nearest = budget > 0 and (at + sizes[d] <= budget or (at <= budget and 2 * (budget - at) >= sizes[d]))
            want[d] = passes + nearest
            at += sizes[d]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want

    packed = stages["packing"](spark, mixed, sf).collect()
    assert laid_out(packed, 2048) == fits([r["length"] for r in packed], 2048)
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == +want


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
