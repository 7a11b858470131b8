"""Index tables made from one cut of the tokens, and what a worker holds while it makes and scans them."""
import pyarrow as pa

from plumbline.operators import models, sparse
from plumbline.plans import blockwise
from plumbline.workload.catalog import ENTRIES

SF_DIR = "/root/testdata/sf0.001"
TEXTS = ["One two two 3.5 one", "\u00c9CLAIR \u0130stanbul \u212aelvin", "", None, "x " * 5000, "..."]


def test_vectors_of_counts_are_those_of_texts(spark):
    rows = [(str(i), "o", "text", "f", t) for i, t in enumerate(TEXTS)]
    chunks = spark.createDataFrame(rows, "chunk_id string, org_id string, modality string, file_id string, content string")
    found = models.embed_counts(sparse.forward_index(chunks), 16, rows=2)
    wanted = models.embed_job(chunks, None, 16, keep_text=False)
    assert found.schema == wanted.select(*found.columns).schema
    as_map = lambda df: {r.chunk_id: (r.file_id, list(r.embedding)) for r in df.collect()}
    assert as_map(found) == as_map(wanted)


def test_only_empty_texts_have_zero_vectors(spark):
    chunks = spark.createDataFrame([("a", "o", "text", "f", "")], "chunk_id string, org_id string, modality string, file_id string, content string")
    assert models.embed_counts(sparse.forward_index(chunks), 4).first().embedding == [0.0] * 4


def test_terms_are_counted_in_parts_of_a_batch():
    tokens = [["a", "b", "a"]] * 2_500 + [None, []]
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(2_502))), pa.array(tokens, pa.list_(pa.string()))], ["chunk_id", "tokens"])
    made = list(sparse._count_terms(iter([batch])))
    assert max(part.num_rows for part in made) <= 1_024 and sum(part.num_rows for part in made) == 2_502
    rows = pa.Table.from_batches(made).to_pylist()
    assert all(sorted(zip(r["terms"], r["tfs"])) == [("a", 2), ("b", 1)] and r["dl"] == 3 for r in rows[:2_500])
    assert [(r["dl"], r["terms"], r["tfs"]) for r in rows[2_500:]] == [(0, [], [])] * 2 and rows[2_400]["chunk_id"] == "2400"


def test_a_scan_scores_parts_of_a_batch(monkeypatch):
    seen, search = [], blockwise._Group.search
    monkeypatch.setattr(blockwise._Group, "search", lambda self, rows: (seen.append(rows.num_rows), search(self, rows))[1])
    queries = pa.table({"qid": ["q"], "org_id": ["o"], "modality": ["text"], "k": pa.array([3], pa.int32()), "file_ids": pa.array([None], pa.list_(pa.string())),
                        "embedding": pa.array([[1.0, 0.0]], pa.list_(pa.float32()))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, queries.schema) as writer:
        writer.write_table(queries)
    n = 6_000
    rows = pa.RecordBatch.from_arrays([pa.array(["o"] * n), pa.array(["text"] * n), pa.array([f"{i:05}" for i in range(n)]), pa.array(["f"] * n),
                                       pa.array([[1.0, float(n - i)] for i in range(n)], pa.list_(pa.float32()))],
                                      ["org_id", "modality", "chunk_id", "file_id", "embedding"])
    shared = type("Shared", (), {"value": sink.getvalue().to_pybytes()})
    found = pa.Table.from_batches(blockwise._scan(blockwise.DenseKernel(), shared)(iter([rows])))
    assert max(seen) <= blockwise.SCAN_ROWS < n and sum(seen) == n
    assert sorted(found["chunk_id"].to_pylist()) == ["05997", "05998", "05999"]


def test_deletion_cuts_the_chunks_once(spark):
    plan = ENTRIES["file_deletion"].run(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
