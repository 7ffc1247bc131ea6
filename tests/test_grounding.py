"""Retrieval, classification, verdicts and the whole job."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corroborate.operators import retrieval, verify
from corroborate.plans import grounding
from corroborate.session import ARROW_BYTES, light_batches, stage
from corroborate.streaming import live
from corroborate.plans.grounding import chunk_store, ground


def test_softmax_golden(spark):
    row = verify.with_label(spark.createDataFrame([([3.2, -1.5, -2.1],)], "logits array<double>")).first()
    assert row.nli_label == "contradiction" and round(row.confidence, 3) == 0.986
    p = spark.createDataFrame([([3.2, -1.5, -2.1],)], "logits array<double>").select(verify.softmax(F.col("logits")).alias("p")).first().p
    assert [round(x, 3) for x in p] == [0.986, 0.009, 0.005] and math.isclose(sum(p), 1.0)


@pytest.mark.parametrize("s,c,u,trust", [(2, 1, 1, 0.375), (3, 0, 1, 0.75), (5, 0, 0, 1.0), (0, 4, 0, 0.0), (0, 0, 0, 0.0)])
def test_trust_golden(spark, s, c, u, trust):
    rows = [(1, "supported")] * s + [(1, "contradicted")] * c + [(1, "unverifiable")] * u
    verdicts = spark.createDataFrame(rows, "doc_id int, status string")
    docs = spark.createDataFrame([(1,)], "doc_id int")
    got = verify.document_scores(verdicts, docs).first()
    assert got.trust_score == pytest.approx(trust) and got.total == s + c + u
    assert verify.verdict_percentages(verify.document_scores(verdicts, docs)).count() == 1


def evidence(spark, *rows):
    full = [(1, 0, claim, rank, text, "s", 1, label, conf, score) for claim, rank, text, label, conf, score in rows]
    return spark.createDataFrame(
        full,
        "doc_id int, claim_index int, claim string, rank int, text string, source string, page int, nli_label string, confidence double, retrieval_score double",
    )


@pytest.mark.parametrize(
    "claim,rows,status,rank",
    [
        ("c", [(1, "x", "entailment", 0.41, 0.5), (2, "y", "contradiction", 0.99, 0.5)], "supported", 1),
        ("c", [(1, "x", "entailment", 0.39, 0.5), (2, "y", "contradiction", 0.5, 0.5)], "contradicted", 2),
        ("c", [(1, "x", "entailment", 0.9, 0.5), (2, "y", "entailment", 0.9, 0.5)], "supported", 1),
        ("Avoid it", [(1, "x", "neutral", 0.9, 0.5), (2, "must not", "neutral", 0.6, -0.1)], "contradicted", 2),
        ("Avoid it", [(1, "must not", "neutral", 0.9, -0.2)], "unverifiable", 1),
        ("c", [(1, "x", "neutral", 0.6, 0.5), (2, "y", "neutral", 0.8, 0.5)], "unverifiable", 2),
    ],
)
def test_verdict_priority(spark, claim, rows, status, rank):
    claims = spark.createDataFrame([(1, 0, claim)], "doc_id int, claim_index int, claim string")
    got = verify.decide(claims, evidence(spark, *[(claim, *r) for r in rows])).first()
    assert (got.status, got.evidence.rank) == (status, rank)
    assert [e.rank for e in got.all_evidence] == [r[0] for r in rows]


def test_verdict_without_evidence(spark):
    claims = spark.createDataFrame([(1, 5, "c")], "doc_id int, claim_index int, claim string")
    got = verify.decide(claims, evidence(spark, ("c", 1, "x", "neutral", 0.6, 0.5))).first()
    assert got.status == "unverifiable" and got.confidence == 0.0 and got.evidence is None


@pytest.mark.parametrize("lanes,query_lanes,rows", [(1, 1, 1000), (5, 3, 7), (8, 1, 3)])
def test_topk_is_exact(spark, lanes, query_lanes, rows):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(60, 8)).astype(np.float32)
    vectors[30:40] = vectors[0]  # ties
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<float>")
    got = retrieval.evidence_topk(
        df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "chunk_id"), 4, lanes=lanes, query_lanes=query_lanes, block_rows=rows, query_block_rows=rows
    )
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.chunk_id, r.score)
    v = vectors.astype(np.float64)
    for i in range(60):
        scores = np.round(1 - ((v - v[i]) ** 2).sum(1), 6)
        want = sorted(range(60), key=lambda j: (-scores[j], j))[:4]
        assert [found[i][k + 1][0] for k in range(4)] == want


def test_topk_with_fewer_chunks_than_k(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>")
    got = retrieval.evidence_topk(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "chunk_id"), 5).collect()
    assert [(r.rank, r.score) for r in got] == [(1, 1.0)]


def test_blocks_that_begin_with_one_id(spark):
    """Query ids that repeat: blocks [1, 2] and [1, 3] are told apart, and the rows of one id are one query."""
    store = spark.createDataFrame([(10, [1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0]), (30, [0.0, 0.0, 1.0])], "chunk_id long, embedding array<float>")
    asked = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (3, [0.0, 0.0, 1.0])]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>").coalesce(1)
    for how in ({}, {"lanes": 2, "query_lanes": 2}):
        got = retrieval.evidence_topk(queries, store, 1, query_block_rows=2, **how).collect()
        assert {r.query_id: r.chunk_id for r in got} == {1: 10, 2: 20, 3: 30} and len(got) == 3


def test_packed_store_gives_the_same_and_is_packed_once(spark, tmp_path, monkeypatch):
    store = chunk_store(spark.createDataFrame(CORPUS, "doc_id long, source string, text string"))
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(["The Magna Carta was sealed in 1225 at Runnymede.", "Apollo 11 landed on the Moon.", "Arctic sea ice declines."])], "doc_id long, text string")
    packed = retrieval.pack(store, str(tmp_path / "index"), block_rows=1)
    assert packed.rows == store.count() and packed.blocks(spark).count() == packed.rows
    for how in ({}, {"lanes": 2, "query_lanes": 2}):
        rows = [sorted(ground(texts, store, index=x, **how).evidence.select("query_id", "chunk_id", "rank", "retrieval_score").collect()) for x in (None, packed)]
        assert rows[0] == rows[1] and rows[0]
    arrivals, calls, blocks = str(tmp_path / "in"), [], retrieval._blocks
    texts.repartition(3, "doc_id").write.parquet(arrivals)
    monkeypatch.setattr(retrieval, "_blocks", lambda df, key, rows, prefix: calls.append(prefix) or blocks(df, key, rows, prefix))
    stream = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
    live.ground_stream(stream, store, str(tmp_path / "out"), "r1", str(tmp_path / "ckpt")).awaitTermination()
    assert calls.count("c") == 1 and calls.count("q") > 1
    scores = spark.read.parquet(str(tmp_path / "out" / "scores"))
    assert scores.count() == 3 and retrieval.pack(store, str(tmp_path / "index"), version=1).version == 1


def test_vectors_are_made_once(spark):
    rows = spark.createDataFrame([(1, "a word"), (2, "..."), (3, None)], "id int, text string")
    made = retrieval.embed(rows)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert made.columns == ["id", "text", "embedding"] and [r.id for r in made.collect()] == [1]


def test_batches_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    """Whole matrices and documents are rows: neither a batch nor a row group may hold them by the thousand."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    heavy = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    before = spark.conf.get(ARROW_BYTES)
    with light_batches(spark):
        assert max(r.n for r in heavy.mapInArrow(sizes, "n long").collect()) <= 11
        with light_batches(spark, 1 << 30):
            assert int(spark.conf.get(ARROW_BYTES)) == 1 << 20
    assert spark.conf.get(ARROW_BYTES) == before
    seen = []
    for module in (retrieval, grounding):
        monkeypatch.setattr(module, "stage", lambda df, name: seen.append((name, int(spark.conf.get(ARROW_BYTES).rstrip("b")))) or stage(df, name))
    store = chunk_store(spark.createDataFrame(CORPUS * 3, "doc_id long, source string, text string"))
    packed = retrieval.pack(store.coalesce(1), str(tmp_path / "index"), block_rows=1)
    ground(spark.createDataFrame([(1, "Apollo 11 landed on the Moon.")], "doc_id long, text string"), store, index=packed)
    assert {name for name, _ in seen} == {"query-blocks", "found"} and max(size for _, size in seen) <= 1 << 20
    groups = [pq.ParquetFile(p).metadata.row_group(i).num_rows for p in tmp_path.rglob("*.parquet") for i in range(pq.ParquetFile(p).metadata.num_row_groups)]
    assert sum(groups) == packed.rows > retrieval.GROUP_BLOCKS >= max(groups)


@pytest.mark.parametrize("name", ["stream_grounding", "stored_run"])
def test_stores_are_made_in_bounded_batches(spark, sf, monkeypatch, name):
    from queries import streaming

    class Asked(Exception):
        pass

    def asked(df, what):
        raise Asked(what, int(spark.conf.get(ARROW_BYTES).rstrip("b")))

    monkeypatch.setattr(streaming, "stage", asked)
    with pytest.raises(Asked) as found:
        getattr(streaming, name)(spark, sf)
    assert found.value.args == ("store", 1 << 20)


def test_approximate_search_finds_equal_vectors(spark):
    df = spark.createDataFrame([(i, [float(i == j) for j in range(6)]) for i in range(6)], "id long, embedding array<float>")
    got = retrieval.evidence_approx(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "chunk_id"), 0.5).collect()
    assert {(r.query_id, r.chunk_id) for r in got} == {(i, i) for i in range(6)}


CORPUS = [
    (1, "climate", "Methane is about 80 times more potent than carbon dioxide over twenty years. Arctic sea ice declines by 13 percent per decade."),
    (2, "history", "The Magna Carta was sealed in 1215 at Runnymede. Apollo 11 landed on the Moon in July 1969."),
]


def test_number_clashes_contradict(spark):
    store = chunk_store(spark.createDataFrame(CORPUS, "doc_id long, source string, text string"))
    texts = [
        (1, "The Magna Carta was sealed in 1225 at Runnymede."),
        (2, "Arctic sea ice declines by 13 percent per decade."),
        (3, "Bananas are yellow."),
        (4, ""),
    ]
    job = ground(spark.createDataFrame(texts, "doc_id long, text string"), store)
    status = {r.doc_id: r.status for r in job.verdicts.collect()}
    assert status == {1: "contradicted", 2: "supported", 3: "unverifiable"}
    fix = job.corrections().first()
    assert "1215" in fix.suggested_correction
    report = {r.doc_id: r for r in job.report().collect()}
    assert report[4].total == 0 and report[4].trust_score == 0.0
    assert report[2].trust_score == 1.0 and report[2].citations[0].citation_number == 1
    assert len(report[1].corrections) == 1 and len(report[1].annotations) == 1


def test_plans_have_no_cartesian_product(spark, sf):
    import __spark_entry__ as entry

    for key in ("grounding_report", "evidence_topk", "chunk_pages", "match_columns_b", "reject_rows", "pre_migration_suite"):
        plan = entry.queries()[key](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan, key


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_passages_are_not_shuffled_to_the_evidence(spark):
    corpus = spark.createDataFrame([(i, "s", f"The river {i} flows north to the lake.") for i in range(20)], "doc_id long, source string, text string")
    texts = spark.createDataFrame([(1, "The river 7 flows north to the lake.")], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        job = ground(texts, chunk_store(corpus), k=3)
        plan = job.evidence._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [chunk_id" in plan
    assert job.evidence.where("rank = 1").first()["text"] == "The river 7 flows north to the lake."
