import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import dense, evaluation, fusion, models, sparse
from plumbline.plans import retrieval


def round6(x):
    return math.copysign(math.floor(abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [("o" if i % 9 else "p", "text" if i % 4 else "table", f"c{i:04d}", f"f{i % 5}", rng.normal(size=8).tolist())
            for i in range(600)]
    queries = [(f"q{i}", "o" if i % 5 else "p", "text", rng.normal(size=8).tolist(), 3 + i % 4,
                ["f1", "f2"] if i % 3 == 0 else None) for i in range(40)]
    return (rows, queries,
            spark.createDataFrame(rows, "org_id string, modality string, chunk_id string, file_id string, "
                                        "embedding array<float>").repartition(5),
            spark.createDataFrame(queries, "qid string, org_id string, modality string, embedding array<float>, k int, "
                                           "file_ids array<string>"))


def brute_dense(rows, queries):
    out = set()
    for qid, org, modality, v, k, files in queries:
        v = np.float32(v).astype(float)
        found = []
        for o, m, cid, fid, e in rows:
            if (o, m) == (org, modality) and (not files or fid in files):
                e = np.float32(e).astype(float)
                found.append((-round6(v @ e / np.linalg.norm(v) / np.linalg.norm(e)), cid))
        out |= {(qid, cid, r + 1) for r, (_, cid) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("options", [{}, {"max_broadcast_queries": 0},
                                     {"max_broadcast_queries": 0, "block_rows": 50, "query_block_rows": 7}])
def test_dense_routes_equal_brute_force(vectors, options):
    rows, queries, corpus, asked = vectors
    got = dense.dense_topk(asked, corpus, max_k=6, **options).collect()
    assert {(r.qid, r.chunk_id, r.rnk) for r in got} == brute_dense(rows, queries)


def test_lsh_pairs_are_scored_exactly(vectors):
    _, _, corpus, asked = vectors
    asked = asked.drop("k", "file_ids")
    exact = {(r.qid, r.chunk_id): r.similarity for r in dense.dense_topk(asked, corpus, k=1000).collect()}
    near = dense.dense_topk_lsh(asked, corpus, k=10, bucket_length=2.0, tables=4, projections=1, block_rows=40).collect()
    assert near and all(abs(exact[r.qid, r.chunk_id] - r.similarity) < 1e-9 for r in near)
    assert len({(r.qid, r.chunk_id) for r in near}) == len(near)


def bm25_by_hand(docs, query, k1=1.5, b=0.75, eps=0.25):
    n, avgdl = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: eps * mean if v < 0 else v for t, v in idf.items()}
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(sum(idf.get(t, 0) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(d) / avgdl)) for t in query))
    return out


@pytest.mark.parametrize("options", [{}, {"max_broadcast_queries": 0, "block_rows": 20, "query_block_rows": 4}])
@pytest.mark.parametrize("pad", [False, True])
def test_bm25_equals_the_formula(spark, options, pad):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    docs = [[rng.choice(words[:1 + rng.randrange(30)]) for _ in range(rng.randrange(1, 25))] for _ in range(80)]
    queries = [[rng.choice(words + ["unknown"]) for _ in range(rng.randrange(1, 8))] for _ in range(12)]
    chunks = spark.createDataFrame([("o", "text", f"c{i:03d}", "f", " ".join(d)) for i, d in enumerate(docs)],
                                   "org_id string, modality string, chunk_id string, file_id string, content string")
    asked = spark.createDataFrame([(f"q{i}", "o", "text", " ".join(q)) for i, q in enumerate(queries)] + [
        ("none", "o", "text", "!!")], "qid string, org_id string, modality string, query string")
    forward = sparse.forward_index(chunks.repartition(4))
    stats = sparse.corpus_stats(forward)
    got = sparse.sparse_topk(asked, forward, sparse.term_stats(forward, stats), stats, k=15, pad_zero=pad, **options)
    got = {(r.qid, r.rnk): (r.chunk_id, r.score) for r in got.collect()}
    expected = {}
    for i, q in enumerate(queries):
        ranked = sorted((-round6(s), f"c{j:03d}") for j, s in enumerate(bm25_by_hand(docs, q)))
        ranked = [(cid, -s) for s, cid in ranked if pad or s != 0][:15]
        expected |= {(f"q{i}", r + 1): x for r, x in enumerate(ranked)}
    assert {k: c for k, (c, _) in got.items()} == {k: c for k, (c, _) in expected.items()}
    assert all(abs(got[k][1] - expected[k][1]) < 1e-6 for k in expected)


def lists_frame(spark, lists, weights=None):
    rows = [("q", c, r + 1, i, (weights or [1.0] * len(lists))[i]) for i, l in enumerate(lists) for r, c in enumerate(l)]
    return spark.createDataFrame(rows, "qid string, chunk_id string, rnk int, list_no int, weight double")


def test_rrf_order_ties_and_permutation(spark):
    fused = fusion.rrf_fuse(lists_frame(spark, [["a", "b", "c"], ["b", "a", "d"]]), ["qid"]).orderBy("rnk").collect()
    assert [r.chunk_id for r in fused] == ["a", "b", "c", "d"]
    assert abs(fused[0].rrf_score - (1 / 61 + 1 / 62)) < 1e-12
    swapped = fusion.rrf_fuse(lists_frame(spark, [["b", "a", "d"], ["a", "b", "c"]]), ["qid"]).collect()
    assert {r.chunk_id: r.rrf_score for r in fused} == {r.chunk_id: r.rrf_score for r in swapped}
    assert [r.chunk_id for r in sorted(swapped, key=lambda r: r.rnk)] == ["b", "a", "d", "c"]
    heavy = fusion.rrf_fuse(lists_frame(spark, [["a"], ["b"]], [1.0, 1.5]), ["qid"], top=1).collect()
    assert [r.chunk_id for r in heavy] == ["b"]


def test_metrics(spark):
    queries = spark.createDataFrame([("q1", "why", None, None), ("q2", "x", "extractive", "text-table"), ("q3", "y", None, None)],
                                    "qid string, query string, type string, source string")
    qrels = spark.createDataFrame([("q1", "d", 0), ("q2", "d", 1)], "qid string, doc_id string, section_id int")
    found = spark.createDataFrame([("q1", "d", 1, 1), ("q1", "d", 0, 3), ("q1", "d", 0, 4)],
                                  "qid string, doc_id string, section_id int, rnk int")
    rows = {r.qid: r for r in evaluation.per_query_eval(queries, found, qrels).collect()}
    assert set(rows) == {"q1", "q2"}
    q1, q2 = rows["q1"], rows["q2"]
    assert (q1.recall_at_1, q1.recall_at_3, q1.mrr_at_10, q1.ndcg_at_10) == (0.0, 1.0, 1 / 3, 0.5)
    assert (q1.type, q1.source, q1.intent, q1.n_retrieved) == ("abstractive", "text", "analytical", 3)
    assert (q2.recall_at_10, q2.mrr_at_10, q2.n_retrieved) == (0.0, 0.0, 0)
    with pytest.raises(ValueError):
        evaluation.per_query_eval(queries, found, qrels, top_k=8)
    table = {(r.dimension, r.value): r.mrr_at_10 for r in evaluation.metric_breakdown(
        evaluation.per_query_eval(queries, found, qrels)).collect()}
    assert table["all", "all"] == round(1 / 6, 4) and table["source", "text-table"] == 0.0


def test_rerank_callable_and_none(spark):
    rows = [("q", "termination conditions", f"c{i}", t, i + 1) for i, t in enumerate(
        ["payment is due", "termination needs notice", "conditions of termination"])]
    cands = spark.createDataFrame(rows, "qid string, query string, chunk_id string, content string, rnk int")
    order = lambda df: [r.chunk_id for r in df.orderBy("rnk").collect()]
    assert order(models.rerank(cands, 2)) == ["c2", "c1"]
    assert order(models.rerank(cands, 8, provider="none")) == ["c0", "c1", "c2"]
    assert order(models.rerank(cands, 8, load=lambda: lambda qs, cs: [len(c) for c in cs])) == ["c2", "c1", "c0"]


def test_stored_index_answers_queries(spark, tmp_path):
    rows = [(f"d{i}_s0_t0", f"d{i}", 0, "text", t, {}, "007", f"d{i}") for i, t in enumerate(
        ["alpha beta gamma", "beta delta", "unrelated words here"])]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, section_id int, modality string, content string, "
                                         "metadata map<string,string>, org_id string, file_id string")
    retrieval.write_index(chunks, str(tmp_path / "ix"), dim=32)
    index = retrieval.read_index(spark, str(tmp_path / "ix"))
    queries = spark.createDataFrame([("1", "007", "alpha beta")], "qid string, org_id string, query string")
    got = retrieval.retrieve(queries, index, dim=32, top_k=2).orderBy("rnk").collect()
    assert [r.chunk_id for r in got] == ["d0_s0_t0", "d1_s0_t0"]
    answers = retrieval.answer_table(queries, retrieval.retrieve(queries, index, dim=32)).collect()
    assert answers[0].answer == "alpha beta gamma" and answers[0].guard.score == 0.5
    nothing = spark.createDataFrame([("9", "nobody", "alpha")], "qid string, org_id string, query string")
    empty = retrieval.answer_table(nothing, retrieval.retrieve(nothing, index, dim=32)).collect()
    assert empty[0].answer == "" and empty[0].guard.score == 1.0


def test_lsh_prunes_where_vectors_have_neighbours(spark):
    """Vectors around centres: most exact neighbours are found while few of all pairs share a cell."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    rows = [("o", "text", f"c{i:04d}", "f", unit(centres[i % 40] + 0.25 * rng.normal(size=64))) for i in range(1200)]
    asked = [(f"q{i}", "o", "text", unit(centres[i] + 0.25 * rng.normal(size=64))) for i in range(40)]
    vectors = spark.createDataFrame(rows, "org_id string, modality string, chunk_id string, file_id string, embedding array<float>")
    queries = spark.createDataFrame(asked, "qid string, org_id string, modality string, embedding array<float>")
    pairs = lambda df: {(r["qid"], r["chunk_id"]) for r in df.select("qid", "chunk_id").collect()}
    exact, near = pairs(dense.dense_topk(queries, vectors, k=10)), pairs(dense.dense_topk_lsh(queries, vectors, k=10))
    assert len(exact & near) >= 0.9 * len(exact)
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=1.25 / 8, numHashTables=32, seed=42).fit(
        vectors.select(array_to_vector("embedding").alias("_v")))
    met = dense.lsh_cells(vectors, model, 8, 4).select("chunk_id", "_cell").join(
        dense.lsh_cells(queries, model, 8, 4).select("qid", "_cell"), "_cell").select("qid", "chunk_id").distinct().count()
    assert met < 0.2 * len(rows) * len(asked)


def test_each_search_has_its_own_k(spark):
    chunks = spark.createDataFrame([(f"c{i}", "o", "text", "f", f"alpha w{i}") for i in range(30)], "chunk_id string, org_id string, modality string, file_id string, content string")
    index = retrieval.build_index(chunks.withColumns({"doc_id": F.col("chunk_id"), "section_id": F.lit(0), "metadata": F.lit("{}")}), dim=16)
    asked = spark.createDataFrame([("q", "o", "alpha")], "qid string, org_id string, query string")
    k = lambda text: {"text": text, "table": 1, "image": 1}
    dense_list, sparse_list = retrieval.candidate_lists(asked, retrieval.prepare_queries(asked, dim=16), index, base_k=k(12), sparse_k=k(5))
    assert dense_list.count() == 12 and sparse_list.where("modality = 'text'").count() == 5


@pytest.mark.parametrize("bucket_length, tables, projections", [(2.0, 4, 1), (0.6, 3, 3)])
def test_lsh_gives_the_best_of_the_pairs_that_share_a_cell(vectors, bucket_length, tables, projections):
    """Wide cells hold more pairs than there are: no row is made for a cell then, and rows are copied for blocks of queries only."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    _, _, corpus, asked = vectors
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket_length, numHashTables=tables * projections, seed=42).fit(
        corpus.select(array_to_vector("embedding").alias("_v")))
    cells = lambda df, key: dense.lsh_cells(df, model, tables, projections).select("org_id", "modality", key, "_cell")
    met = cells(corpus, "chunk_id").join(cells(asked, "qid"), ["org_id", "modality", "_cell"]).select("qid", "chunk_id").distinct()
    every = dense.dense_topk(asked.drop("k", "file_ids"), corpus, k=1000).drop("rnk").join(met, ["qid", "chunk_id"]).join(
        asked.select("qid", "k", "file_ids"), "qid").join(corpus.select("chunk_id", "file_id"), "chunk_id")
    want = {}
    for r in sorted(every.collect(), key=lambda r: (-r.similarity, r.chunk_id)):
        if not r.file_ids or r.file_id in r.file_ids:
            want.setdefault(r.qid, []).append((r.chunk_id, r.similarity))
    k = {r.qid: r.k for r in asked.collect()}
    for options in ({}, {"max_broadcast_queries": 0, "block_rows": 40, "query_block_rows": 7}):
        near = dense.dense_topk_lsh(asked, corpus, bucket_length=bucket_length, tables=tables, projections=projections, **options)
        got = {(r.qid, r.rnk): (r.chunk_id, r.similarity) for r in near.collect()}
        assert got == {(q, i + 1): x for q, found in want.items() for i, x in enumerate(found[:k[q]])} and got
    assert ("_cell" in near._jdf.queryExecution().optimizedPlan().toString()) == (tables == 3)
