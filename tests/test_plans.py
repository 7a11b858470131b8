"""Physical plans: no pair-enumerating joins, early rank cuts, pushed filters and pruned partitions."""
import pytest
from pyspark.sql import functions as F

from plumbline.operators import chat, dense
from plumbline.plans import retrieval
from plumbline.sources import store
from plumbline.workload import operations, tables
from plumbline.workload.catalog import ENTRIES

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in ENTRIES if "streamed" not in n])
def test_no_nested_loops(spark, name):
    text = plan(ENTRIES[name].run(spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_ranks_are_cut_before_the_shuffle(spark):
    for name in ("vector_topk", "bm25_topk", "cross_modal_fusion", "retrieve", "image_size_gate"):
        assert "WindowGroupLimit" in plan(ENTRIES[name].run(spark, SF_DIR)), name
    assert "WindowGroupLimit" in plan(chat.history_window(operations._messages(spark, SF_DIR)))


def below(df, node):
    """The plan's lines under its one ``node``: those that follow it and stand further in."""
    lines = plan(df).splitlines()
    depth = lambda line: next((i for i, c in enumerate(line) if c.isalpha()), len(line))
    [at] = [i for i, line in enumerate(lines) if line.lstrip(" :+-*()0123456789").startswith(node)][:1]
    under = []
    for line in lines[at + 1:]:
        if depth(line) <= depth(lines[at]):
            break
        under.append(line)
    return "\n".join(under)


def test_search_scans_in_place_and_prunes(spark, tmp_path):
    index = retrieval.write_index(tables.corpus_chunks(spark, SF_DIR), str(tmp_path), dim=16)
    asked = index.vectors.where("modality = 'image'").select(F.col("chunk_id").alias("qid"), "org_id", "modality", "embedding")
    scan = below(dense.dense_topk(asked, index.vectors, k=3), "MapInArrow")
    assert "Exchange" not in scan and "Scan parquet" in scan and "modality" in scan[scan.index("PartitionFilters"):] and "image" in scan


def test_tenant_filter_reaches_the_scan(spark):
    text = plan(store.scope(tables.index(spark, SF_DIR).chunks, "default", "text", ["1", "2"]).select("chunk_id"))
    assert "PartitionFilters: [isnotnull(org_id" in text and "PushedFilters: [In(file_id" in text
    assert "ReadSchema: struct<chunk_id:string,file_id:string>" in text
