"""BM25: index tables and top-k search for a table of queries."""
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import tokenize
from plumbline.operators.dense import bounded_k
from plumbline.plans.blockwise import SparseKernel, blockwise_topk
from plumbline.schemas import BM25_B, BM25_EPSILON, BM25_K1

GROUP = ["org_id", "modality"]
COUNTS = T.StructType([T.StructField("dl", T.IntegerType()), T.StructField("terms", T.ArrayType(T.StringType())),
                       T.StructField("tfs", T.ArrayType(T.IntegerType()))])


def _count_terms(batches: Iterator[pa.RecordBatch], rows: int = 1_024) -> Iterator[pa.RecordBatch]:
    """Counts of ``rows`` rows at a time: what a worker holds does not grow with the batch it is given."""
    for batch in (whole.slice(lo, rows) for whole in batches for lo in range(0, whole.num_rows, rows)):
        kept = [name for name in batch.schema.names if name != "tokens"]
        tokens = batch.column("tokens")
        flat = tokens.flatten().dictionary_encode()
        lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(tokens), dtype=np.int64), lengths)
        n_terms = max(len(flat.dictionary), 1)
        cells, counts = np.unique(owner * n_terms + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
        offsets = pa.array(np.searchsorted(cells // n_terms, np.arange(len(tokens) + 1)).astype(np.int32))
        terms = flat.dictionary.cast(pa.string()).take(pa.array(cells % n_terms))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in kept] + [pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(offsets, terms),
               pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))],
            names=[*kept, "dl", "terms", "tfs"])


def forward_index(chunks: DataFrame, keep: tuple = ()) -> DataFrame:
    """One row per chunk: distinct terms, their counts, and the token count ``dl``; ``keep`` names more columns.

    Tokens are cut in the JVM; counting stays inside the row's task (an exploding ``groupBy`` would shuffle the whole
    index to count within rows that are already together).
    """
    kept = chunks.select("org_id", "modality", "chunk_id", "file_id", *keep, "content")
    schema = T.StructType(kept.drop("content").schema.fields + COUNTS.fields)
    return kept.withColumn("tokens", tokenize(F.col("content"))).drop("content").mapInArrow(_count_terms, schema)


def postings(forward: DataFrame) -> DataFrame:
    """``org_id, modality, chunk_id, dl, term, tf``: one row per (chunk, term)."""
    pairs = F.explode(F.arrays_zip("terms", "tfs")).alias("p")
    return forward.select("org_id", "modality", "chunk_id", "dl", pairs).select(
        "org_id", "modality", "chunk_id", "dl", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))


def corpus_stats(forward: DataFrame) -> DataFrame:
    return forward.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def term_stats(forward: DataFrame, stats: DataFrame, epsilon: float = BM25_EPSILON) -> DataFrame:
    """``org_id, modality, term, df, idf``; a negative idf becomes ``epsilon`` times the mean raw idf of the group.

    The mean is an aggregate joined back, so no group is gathered in one task.
    """
    df = forward.select(*GROUP, F.explode("terms").alias("term")).groupBy(*GROUP, "term").agg(
        F.count(F.lit(1)).alias("df"))
    return with_idf(df, stats, epsilon)


def with_idf(df: DataFrame, stats: DataFrame, epsilon: float = BM25_EPSILON) -> DataFrame:
    """Term statistics from document frequencies (``org_id, modality, term, df``)."""
    raw = df.join(stats, GROUP).withColumn(
        "raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.groupBy(*GROUP).agg((F.avg("raw") * epsilon).alias("floor"))
    return raw.join(floor, GROUP).select(
        *GROUP, "term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def query_weights(queries: DataFrame, terms: DataFrame, stats: DataFrame) -> DataFrame:
    """Queries with ``terms, weights`` (query count x idf, by term) and the group's ``avgdl``.

    A query without any token is dropped; one whose tokens are all unknown keeps empty arrays.
    """
    tokens = tokenize(F.col("query"))
    asked = queries.where(F.size(tokens) > 0)
    counted = (asked.select("qid", *GROUP, F.explode(tokens).alias("term"))
               .groupBy("qid", *GROUP, "term").agg(F.count(F.lit(1)).alias("qtf")))
    # An inner join lets Spark broadcast the query side whatever the size of the vocabulary.
    entry = F.struct("term", (F.col("qtf") * F.col("idf")).alias("weight"))
    packed = (terms.select(*GROUP, "term", "idf").join(counted, GROUP + ["term"])
              .groupBy("qid", *GROUP).agg(F.array_sort(F.collect_list(entry)).alias("_w")))
    return (asked.join(packed, ["qid", *GROUP], "left").join(stats, GROUP)
            .withColumns({"terms": F.coalesce("_w.term", F.array().cast("array<string>")),
                          "weights": F.coalesce("_w.weight", F.array().cast("array<double>"))}).drop("_w", "n_docs"))


def sparse_topk(queries: DataFrame, forward: DataFrame, terms: DataFrame, stats: DataFrame, k: int = 30,
                max_k: int | None = None, pad_zero: bool = False, k1: float = BM25_K1, b: float = BM25_B,
                **options) -> DataFrame:
    """BM25 top-k.  ``queries``: ``qid, org_id, modality, query [, k, file_ids]``.

    Chunks scoring zero are left out; ``pad_zero`` fills up to k with them in id order.  Repeated query tokens count
    repeatedly, statistics come from the whole group, and the file filter applies before counting to k.
    """
    queries, top = bounded_k(queries, k, max_k)
    return blockwise_topk(forward, query_weights(queries, terms, stats), SparseKernel(k1, b, pad_zero), top, **options)


def bm25_score(queries: DataFrame, forward: DataFrame, terms: DataFrame, stats: DataFrame, k1: float = BM25_K1,
               b: float = BM25_B) -> DataFrame:
    """Score of each candidate pair of ``queries`` (``qid, org_id, modality, query, chunk_id``), zero when nothing
    matches.  The pairs are given; nothing is enumerated."""
    pairs = queries.select("qid", *GROUP, "chunk_id")
    weighted = query_weights(queries.select("qid", *GROUP, "query").distinct(), terms, stats)
    joined = (pairs.join(weighted, ["qid", *GROUP])
              .join(forward.select(*GROUP, "chunk_id", "dl", F.col("terms").alias("_t"), F.col("tfs").alias("_f")),
                    [*GROUP, "chunk_id"]))
    length = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    counts = F.map_from_arrays("_t", "_f")
    total = F.aggregate(F.arrays_zip("terms", "weights"), F.lit(0.0), lambda acc, e: acc + F.coalesce(
        e["weights"] * F.element_at(F.col("_tf"), e["terms"]) * F.lit(k1 + 1)
        / (F.element_at(F.col("_tf"), e["terms"]) + F.col("_len")), F.lit(0.0)))
    return (joined.withColumns({"_tf": counts, "_len": length})
            .select("qid", *GROUP, "chunk_id", F.round(total, 6).alias("score")))
