"""Chunks, claims, positions, best sentences."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corroborate.functions import text as X
from corroborate.operators import chunks, cite, claims, correct
from corroborate.sources import corpus


def chunks_of(spark, text, **options):
    docs = spark.createDataFrame([(1, "s", text)], "doc_id long, source string, text string")
    return chunks.chunk_documents(docs, **options).orderBy("chunk_index").collect()


def test_chunk_boundaries(spark):
    assert chunks_of(spark, "") == []
    plain = chunks_of(spark, "x" * 500)
    assert [(c.char_start, c.char_end) for c in plain] == [(0, 500), (450, 500)]
    assert len(chunks_of(spark, "x" * 450)) == 1
    early = chunks_of(spark, "x" * 250 + "." + "x" * 400)
    assert early[0].char_end == 500
    late = chunks_of(spark, "x" * 251 + "." + "x" * 400)
    assert late[0].char_end == 252
    assert chunks_of(spark, " " * 600) == []


def test_chunk_overlap_is_bounded():
    with pytest.raises(ValueError):
        X.chunker(100, 51)


def test_chunks_rebuild_the_text(spark):
    """True offsets: every chunk is the text at its place, and only white space is left out."""

    @settings(max_examples=15, deadline=None)
    @given(st.text(alphabet="ab. \n\tü😀", max_size=1500))
    def check(text):
        covered = set()
        for c in chunks_of(spark, text, size=60, overlap=10):
            assert text[c.char_start : c.char_end] == c.text
            covered.update(range(c.char_start, c.char_end))
        assert all(text[i].isspace() for i in range(len(text)) if i not in covered)

    check()


def test_claims(spark):
    long = "one two three four five six seven eight nine ten eleven; twelve thirteen. fourteen fifteen sixteen seventeen eighteen nineteen twenty, twenty-one"
    docs = spark.createDataFrame([(1, "Short one. Next?\n" + long)], "doc_id long, text string")
    got = [r.claim for r in claims.atomize_claims(docs).orderBy("claim_index").collect()]
    assert got[:2] == ["Short one.", "Next?"]
    assert "one two three four five six seven eight nine ten eleven; twelve thirteen." in got
    one_line = "a b c d e f g h i j k l; m n o p q r s t u v w"
    docs = spark.createDataFrame([(1, one_line)], "doc_id long, text string")
    assert [r.claim for r in claims.atomize_claims(docs).orderBy("claim_index").collect()] == ["a b c d e f g h i j k l", "m n o p q r s t u v w"]


def test_best_sentence(spark):
    evidence = "The company was founded in 1990. Employees get 15 days of paid annual leave per year. Parking is free."
    df = spark.createDataFrame([("Employees get 20 days of annual leave per year", evidence)], "c string, e string")
    got = df.select(X.best_sentence(F.col("c"), F.col("e")).alias("s")).first().s
    assert "15 days" in got and len(got) < len(evidence)
    edge = spark.createDataFrame([("x", ""), ("x", "only one"), ("zzz", "First. Second.")], "c string, e string")
    assert [r.s for r in edge.select(X.best_sentence(F.col("c"), F.col("e")).alias("s")).collect()] == ["", "only one", "First"]


def test_topics(spark):
    docs = spark.createDataFrame([(1, "An API for patients"), (2, "nothing"), (3, "Tax law")], "doc_id long, text string")
    got = {r.doc_id: (r.primary_topic, r.all_topics) for r in claims.topic_tags(docs).collect()}
    assert got == {1: ("medical", ["medical", "technical"]), 2: ("general", []), 3: ("legal", ["legal", "financial"])}


def test_positions(spark):
    text = "Alpha beta. alpha BETA! The quick brown fox jumps over it. The end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = [(1, 0, "alpha beta"), (1, 1, "The quick brown fox jumps under it"), (1, 2, "absent"), (1, 3, "a.b\\E*")]
    rows = cite.claim_positions(docs, spark.createDataFrame(items, "doc_id long, claim_index int, claim string")).collect()
    assert sorted((r.claim_index, r.start, r.end) for r in rows) == [(0, 0, 10), (0, 12, 22), (1, 24, text.index("it.") + 3)]


def test_markup_escapes_and_does_not_repeat(spark):
    docs = spark.createDataFrame([(1, 'a <b> & "c"'), (2, "plain")], "doc_id long, text string")
    notes = spark.createDataFrame(
        [(1, 0, 0, 5, "supported", 0.5, 'say "x"', "cite_1", 1), (1, 2, 1, 5, "contradicted", 0.5, "in", None, None)],
        "doc_id long, start int, claim_index int, end int, status string, confidence double, explanation string, citation_id string, citation_number int",
    )
    got = {r.doc_id: r.annotated_html for r in cite.annotated_markup(docs, cite.gather_annotations(notes)).collect()}
    assert got[2] == "plain"
    assert got[1].count("a &lt;b&gt;") == 1 and "<sup>[1]</sup>" in got[1] and 'title="say &quot;x&quot;"' in got[1]
    assert got[1].endswith(" &amp; &quot;c&quot;")


def test_corrected_document(spark):
    docs = spark.createDataFrame([(1, "Cats bark. CATS BARK. cats"), (2, "kept")], "doc_id long, text string")
    fixes = spark.createDataFrame([(1, 0, "cats", "dogs"), (1, 1, "cats bark.", r"\1 $0 cats meow.")], "doc_id long, claim_index int, original_claim string, suggested_correction string")
    got = {r.doc_id: r.corrected_text for r in correct.corrected_documents(docs, fixes).collect()}
    assert got == {1: r"\1 $0 dogs meow. CATS BARK. cats", 2: "kept"}


def test_pages(spark):
    pages = spark.createDataFrame([("d", 1, "aa"), ("d", 2, ""), ("d", 3, "bbb"), ("d", 4, None)], "doc_id string, page int, text string")
    assert [(r.page, r.start, r.end) for r in corpus.page_spans(pages).orderBy("page").collect()] == [(1, 0, 4), (3, 4, 9)]
    assert corpus.assemble_pages(pages).first().text == "aa\n\nbbb\n\n"
    assert corpus.join_pages(pages).first().text == "aa\n\nbbb\n\n"


def test_text_files_and_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    row = corpus.scan_text_files(spark, str(tmp_path)).first()
    assert row.text == "one\ntwo" and len(row.doc_id) == 8 and row.page == 1
    names = spark.createDataFrame([("A.PDF",), ("b.Txt",), ("c.doc",)], "source string")
    assert [r.format for r in corpus.route_formats(names).collect()] == ["pdf", "text", None]
    assert [r.format for r in corpus.route_formats(names, api=True).collect()] == [None, None, None]


def test_chunk_store(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = spark.createDataFrame([(1, "s", "hello. world")], "doc_id long, source string, text string")
    made = chunks.chunk_documents(docs)
    corpus.append_chunks(made, path)
    corpus.append_chunks(made, path)
    assert spark.read.parquet(path).count() == 1
    cleared = corpus.clear_chunks(spark, path)
    assert cleared.count() == 0 and cleared.columns == made.columns


def test_batches_become_python_objects_by_slices(spark):
    """However large a batch, only a slice of it is taken apart at a time; the rows stay those of the whole."""
    import pyarrow as pa

    from corroborate.functions import text as X

    seen = []

    def work(texts):
        seen.append(len(texts))
        return pa.array([None if t is None else len(t) for t in texts], pa.int32())

    batch = pa.array([None if i % 7 == 0 else "x" * i for i in range(1, 1051)])
    assert X.by_slices(batch, 100, work).to_pylist() == [None if i % 7 == 0 else i for i in range(1, 1051)]
    assert max(seen) == 100 and X.by_slices(batch.slice(0, 0), 100, work).to_pylist() == []
    rows = spark.range(450).selectExpr("id", "case when id % 50 = 3 then null when id % 50 = 4 then '' else repeat(concat('word', id, '. '), 90) end as text").coalesce(1)
    cut = rows.select("id", X.chunker()("text").alias("c"), X.embed_text("text").alias("v")).collect()
    assert [len(r.c) == 0 for r in cut] == [r.id % 50 in (3, 4) for r in cut] == [r.v is None for r in cut]
    assert all(r.c[0].text.startswith(f"word{r.id}. ") and r.c[1].char_start > 0 for r in cut if r.c)
