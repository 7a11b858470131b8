"""Nothing is cut, dropped or swallowed without being asked for."""
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import dense, evaluation, models, sparse
from plumbline.plans import retrieval
from plumbline.sources import readers
from plumbline.workload import tables

QUERY = "qid string, org_id string, modality string"


def test_k_column_without_max_k(spark):
    rng = np.random.default_rng(3)
    rows = [("o", "text", f"c{i}", "f", rng.normal(size=8).tolist()) for i in range(200)]
    vectors = spark.createDataFrame(rows, "org_id string, modality string, chunk_id string, file_id string, embedding array<float>")
    queries = spark.createDataFrame([("q", "o", "text", [1.0] * 8, 45), ("r", "o", "text", [0.5] * 8, 3)], QUERY + ", embedding array<float>, k int")
    for options in ({}, {"max_broadcast_queries": 0}):
        found = dense.dense_topk(queries, vectors, **options).groupBy("qid").count().collect()
        assert {r["qid"]: r["count"] for r in found} == {"q": 45, "r": 3}
    with pytest.raises(Exception, match="max_k"):
        dense.dense_topk(queries, vectors, max_k=30).collect()


def test_sparse_k_column_without_max_k(spark):
    chunks = spark.createDataFrame([(f"c{i}", "o", "text", "f", "alpha " * (1 + i % 5) + f"w{i}") for i in range(120)],
                                   "chunk_id string, org_id string, modality string, file_id string, content string")
    forward = sparse.forward_index(chunks)
    stats = sparse.corpus_stats(forward)
    terms = sparse.term_stats(forward, stats)
    queries = spark.createDataFrame([("q", "o", "text", "alpha w3 w9", 45)], QUERY + ", query string, k int")
    found = sparse.sparse_topk(queries, forward, terms, stats, pad_zero=True)
    same = sparse.sparse_topk(queries, forward, terms, stats, pad_zero=True, max_broadcast_queries=0)  # the block route
    rows = lambda df: sorted((r["qid"], r["chunk_id"], r["rnk"], r["score"]) for r in df.collect())
    assert rows(found) == rows(same) and len(rows(found)) == 45


def test_bound_follows_base_k():
    assert retrieval.max_k({"text": 60, "table": 50, "image": 20}) == {"text": 60, "table": 75, "image": 20}


def test_base_k_reaches_the_lists(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"d{i}", 0, "text", f"alpha beta w{i}", {}, "o", "f") for i in range(90)],
                                   "chunk_id string, doc_id string, section_id int, modality string, content string, "
                                   "metadata map<string,string>, org_id string, file_id string")
    index = retrieval.build_index(chunks, dim=16)
    queries = spark.createDataFrame([("q", "o", "alpha beta")], "qid string, org_id string, query string")
    base = {"text": 60, "table": 10, "image": 10}
    lists = retrieval.candidate_lists(queries, retrieval.prepare_queries(queries, dim=16), index, pad_zero=True, base_k=base)
    assert [df.where("modality = 'text'").count() for df in lists] == [60, 60]


def test_replacement_characters_of_a_valid_file_stay(spark):
    files = spark.createDataFrame([("a.txt", "ok � end".encode()), ("b.md", b"bad \xff\xfe end"), ("c.csv", "kept � ".encode() + b"\xc3 cut"),
                                   ("d.pdf", b"%PDF")], "path string, content binary")
    assert {r["doc_id"]: r["text"] for r in readers.text_of(files).collect()} == {"a.txt": "ok � end", "b.md": "bad  end", "c.csv": "kept �  cut"}
    assert [tuple(r) for r in readers.unread_files(files).collect()] == [("d.pdf", "No reader for file type: .pdf")]


def test_model_failures(spark):
    def broken():
        def call(_):
            raise RuntimeError("model is gone")
        return call

    prompts = spark.createDataFrame([("q", "p")], "qid string, prompt string")
    with pytest.raises(Exception, match="model is gone"):
        models.generate_job(prompts, broken).collect()
    assert models.text_job(prompts, "prompt", "reply", broken, tolerant=True).first()["reply"] is None


def test_short_passages_are_found(spark):
    texts = [("1", 0, "One two three. Four five six seven eight nine ten"), ("2", 0, "xone twoy and four FIVE"), ("3", 0, "two three. Four five"), ("4", 0, "seven")]
    items = [("a", "two three. Four"), ("b", "one two"), ("c", "seven"), ("d", "two three. Four five six seven eight"), ("e", "Four five"), ("f", ""), ("g", "nothing like it here at all")]
    docs = spark.createDataFrame(texts, "doc_id string, section_id int, text string")
    got = {(r["qid"], r["doc_id"]) for r in tables.verbatim_places(spark.createDataFrame(items, "qid string, query string"), docs).collect()}
    assert got == {(q, d) for q, p in items if p for d, _, t in texts if p in t}


def test_results_are_read_once(spark):
    queries = spark.createDataFrame([("q", "what is x")], "qid string, query string").withColumns({"type": F.lit("t"), "source": F.lit("s")})
    qrels = spark.createDataFrame([("q", "d", 0)], "qid string, doc_id string, section_id int")

    def retrieved(parts):
        yield from parts

    rows = spark.createDataFrame([("q", "d", 0, 2), ("q", "e", 0, 1)], "qid string, doc_id string, section_id int, rnk int").mapInPandas(
        retrieved, "qid string, doc_id string, section_id int, rnk int")
    for df in (evaluation.per_query_eval(queries, rows, qrels), retrieval.result_head_with_total(rows)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len(re.findall("MapInPandas", plan)) == 1
    assert [(r["rnk"], r["total"]) for r in retrieval.result_head_with_total(rows, 1).collect()] == [(1, 2)]
    assert evaluation.per_query_eval(queries, rows, qrels).first()["mrr_at_10"] == 0.5


def test_scores_held_at_a_time_are_bounded_for_any_block_of_rows():
    import numpy as np
    import pyarrow as pa

    from plumbline.plans import blockwise
    sizes = []

    class Spy(blockwise.DenseKernel):
        def score(self, prepared, loaded, lo, hi):
            sizes.append((hi - lo) * len(loaded))
            return super().score(prepared, loaded, lo, hi)

    n, q = 40_000, 300
    random = np.random.default_rng(3)
    vectors = lambda m: pa.ListArray.from_arrays(np.arange(m + 1, dtype=np.int32) * 4, pa.array(random.standard_normal(m * 4)))
    queries = pa.table({"qid": [str(i) for i in range(q)], "org_id": ["o"] * q, "modality": ["text"] * q, "k": [2] * q,
                        "file_ids": pa.array([None] * q, pa.list_(pa.string())), "embedding": vectors(q)})
    rows = pa.table({"chunk_id": [str(i) for i in range(n)], "file_id": ["f"] * n, "embedding": vectors(n)})
    assert blockwise._Group(Spy(), queries).search(rows).num_rows == 2 * q
    assert sum(sizes) == n * q and max(sizes) <= blockwise.MAX_CELLS
