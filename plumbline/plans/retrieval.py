"""Index building and the composed retrieval, ablation and answer plans over a table of queries."""
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.arrays import collect_by_rank
from plumbline.functions.intent import SIGNAL_CAP, adaptive_k, needs_expansion, table_query_weight
from plumbline.functions.prompts import build_prompt, source_card
from plumbline.operators import fusion, models, sparse
from plumbline.operators.dense import dense_topk
from plumbline.operators.evaluation import first_hits, recall_at_k
from plumbline.operators.postings import Postings, postings_topk
from plumbline.schemas import BASE_K, MODALITIES, RERANK_TOP_N, RRF_K
from plumbline.session import shuffles_removed, spread

# Ids of ranked lists are broadcast to the chunk table up to this many rows (about 60 bytes each).
MAX_BROADCAST_IDS = 500_000
ROW_GROUP_BYTES = 8 << 20


@dataclass
class RetrievalIndex:
    """The tables a search reads, each partitioned by ``org_id, modality`` when stored."""
    chunks: DataFrame
    vectors: DataFrame
    forward: DataFrame
    corpus_stats: DataFrame
    term_stats: DataFrame


TABLES = ("chunks", "vectors", "forward", "corpus_stats", "term_stats")


def build_index(chunks: DataFrame, load=None, dim: int = 1024) -> RetrievalIndex:
    """Vectors keep the filter columns, so searching them needs no join with the chunks."""
    forward = sparse.forward_index(chunks)
    stats = sparse.corpus_stats(forward)
    return RetrievalIndex(chunks, _vectors(chunks, forward, load, dim), forward, stats, sparse.term_stats(forward, stats))


def _vectors(chunks: DataFrame, forward: DataFrame, load, dim: int) -> DataFrame:
    """Vectors by the model; the default one needs the counts of the forward index only."""
    if load is None:
        return models.embed_counts(forward, dim)
    return models.embed_job(chunks.select("chunk_id", "org_id", "modality", "file_id", "content"), load, dim, keep_text=False)


def write_index(chunks: DataFrame, path: str, load=None, dim: int = 1024) -> RetrievalIndex:
    """Write each table once and read it by the next step, so that chunking and counting run a single time.

    ``rebalance`` gives few, even files per partition: a hot (org, modality) is split, small ones are merged.  Row groups are
    small, so that a file is read by several tasks: a scan is cut between row groups only.
    """
    stored = _store(chunks, path, "chunks")
    forward = _store(sparse.forward_index(spread(stored)), path, "forward")
    vectors = _store(_vectors(spread(stored), spread(forward), load, dim), path, "vectors")
    return RetrievalIndex(stored, vectors, forward, *_write_statistics(forward, path))


def write_counts(chunks: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forward index, corpus and term statistics alone, all that a sparse search reads: neither texts nor vectors are stored."""
    forward = _store(sparse.forward_index(chunks), path, "forward")
    return forward, *_write_statistics(forward, path)


def _store(df: DataFrame, path: str, name: str) -> DataFrame:
    with shuffles_removed(df.sparkSession):
        (df.hint("rebalance", "org_id", "modality").write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES)
         .partitionBy("org_id", "modality").parquet(f"{path}/{name}"))
    return read_table(df.sparkSession, path, name)


def _write_statistics(forward: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    stats = _store(sparse.corpus_stats(forward), path, "corpus_stats")
    return stats, _store(sparse.term_stats(forward, stats), path, "term_stats")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table with its partition columns as text: a tenant named ``007`` must not come back as a number."""
    found = spark.read.parquet(f"{path}/{name}").schema
    fields = [T.StructField(f.name, T.StringType()) if f.name in ("org_id", "modality") else f for f in found.fields]
    return spark.read.schema(T.StructType(fields)).parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str) -> RetrievalIndex:
    return RetrievalIndex(*[read_table(spark, path, name) for name in TABLES])


def prepare_queries(queries: DataFrame, passages: DataFrame | None = None, load=None, dim: int = 1024,
                    use_expansion: bool = True) -> DataFrame:
    """``qid, org_id, query [, file_ids]`` with ``embedding`` of the expanded query, ``intent`` flags and weights."""
    expanded = models.with_expansion(queries, passages if use_expansion else None)
    return (models.embed_job(expanded, load, dim, text="embed_query")
            .withColumns({"expanded": needs_expansion(F.col("query"), use_expansion),
                          "table_weight": table_query_weight(F.col("query"))}))


def per_modality_queries(queries: DataFrame, base_k: dict = BASE_K, adaptive: bool = True) -> DataFrame:
    """One row per (query, modality) with its k."""
    rows = queries.withColumn("modality", F.explode(F.array(*[F.lit(m) for m in MODALITIES])))
    fixed = reduce(lambda c, m: c.when(F.col("modality") == m, base_k[m]), base_k, F)
    return rows.withColumn("k", adaptive_k(F.col("modality"), F.col("query"), base_k) if adaptive else fixed)


def max_k(base_k: dict) -> dict:
    """Largest k that adapting to the query can give per modality."""
    return {m: int(k * SIGNAL_CAP) if m == "table" else k for m, k in base_k.items()}


def candidate_lists(queries: DataFrame, prepared: DataFrame, index: RetrievalIndex, adaptive: bool = True,
                    pad_zero: bool = False, base_k: dict = BASE_K, sparse_k: dict | None = None, postings: Postings | None = None,
                    **options) -> tuple[DataFrame, DataFrame]:
    """Dense and sparse lists per (query, modality).  ``prepared`` are the embedded ``queries``; the sparse search
    starts from the plain ones, so that nothing is embedded twice.  ``base_k`` holds for both searches unless ``sparse_k`` is
    given.  With ``postings`` the sparse search reads posting blocks instead of scanning the forward index (without padding)."""
    sparse_k = sparse_k or base_k
    top, asked = max(max_k(sparse_k).values()), per_modality_queries(queries, sparse_k, adaptive)
    dense = dense_topk(per_modality_queries(prepared, base_k, adaptive), index.vectors, max_k=max(max_k(base_k).values()), **options)
    if postings is not None and not pad_zero:
        return dense, postings_topk(asked, postings, index.term_stats, max_k=top)
    return dense, sparse.sparse_topk(asked, index.forward, index.term_stats, index.corpus_stats, max_k=top, pad_zero=pad_zero, **options)


def hybrid_modality(dense: DataFrame, sparse_lists: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """Fuse dense and sparse lists inside each (query, modality); nothing is cut."""
    keys = ["qid", "org_id", "modality"]
    return fusion.rrf_fuse(fusion.ranked_lists(dense, sparse_lists, keys=keys), keys, rrf_k)


def _bounded(queries: DataFrame, limit: int) -> bool:
    return queries.select("qid").limit(limit + 1).count() <= limit


def retrieve(queries: DataFrame, index: RetrievalIndex, passages: DataFrame | None = None, load=None, dim: int = 1024,
             top_k: int = 8, rerank_top_n: int = RERANK_TOP_N, rerank_load=None, rerank_provider: str = "model",
             adaptive: bool = True, fusion_mode: str = "rrf", rrf_k: int = RRF_K, use_expansion: bool = True,
             pad_zero: bool = False, base_k: dict = BASE_K, sparse_k: dict | None = None, postings: Postings | None = None) -> DataFrame:
    """Ranked chunks of every query: expand, embed, dense + sparse per modality, fuse twice, cut, rerank.  ``sparse_k`` and
    ``postings`` as for :func:`candidate_lists`.

    Returns ``qid, query, rnk, fused_rnk, rerank_score`` and the chunk columns.
    """
    prepared = prepare_queries(queries, passages, load, dim, use_expansion)
    dense, sparse_lists = candidate_lists(queries, prepared, index, adaptive, pad_zero, base_k, sparse_k, postings)
    per_modality = hybrid_modality(dense, sparse_lists, rrf_k)
    cut = rerank_top_n if fusion_mode == "rrf" else None
    fused = fusion.cross_modal(per_modality, queries, rrf_k, cut, fusion_mode).select("qid", "chunk_id", "rnk")
    # At most rerank_top_n ids per query (all modality lists for "concat"), so the query count bounds the ids.
    per_query = cut or sum(max_k(base_k).values()) + sum(max_k(sparse_k or base_k).values())
    small = _bounded(queries, MAX_BROADCAST_IDS // per_query)
    found = fusion.attach_chunks(fused, index.chunks, broadcast_ranked=small)
    return models.rerank(found.join(queries.select("qid", "query"), "qid"), top_k, rerank_load, rerank_provider)


def ablation(queries: DataFrame, index: RetrievalIndex, passages: DataFrame | None = None, load=None, dim: int = 1024,
             top_k: int = 8, rerank_load=None, rerank_provider: str = "model", rrf_k: int = RRF_K) -> DataFrame:
    """Results of {dense, sparse, hybrid} x {without, with expansion} in one job: ``mode, hyde`` are columns.

    Expansion changes only the embedded text, so the sparse lists are searched once and used for both.
    """
    flags = F.explode(F.array(F.lit(False), F.lit(True))).alias("hyde")
    both = models.with_expansion(queries, passages).select("*", flags)
    variant = both.withColumns({"embed_query": F.when(F.col("hyde"), F.col("embed_query")).otherwise(F.col("query")),
                                "_qid": F.col("qid"),
                                "qid": F.concat("qid", F.when(F.col("hyde"), F.lit("|1")).otherwise(F.lit("|0")))})
    asked = per_modality_queries(models.embed_job(variant, load, dim, text="embed_query"), adaptive=False)
    top = max(BASE_K.values())
    split = lambda df: df.withColumns({"hyde": F.col("qid").endswith("|1"),
                                       "qid": F.expr("left(qid, length(qid) - 2)")})
    dense = split(dense_topk(asked.drop("_qid"), index.vectors, max_k=top))
    plain = per_modality_queries(queries, adaptive=False)
    sparse_lists = sparse.sparse_topk(plain, index.forward, index.term_stats, index.corpus_stats,
                                      max_k=top).select("*", flags)

    def listed(df, list_no, modes):
        return df.select("qid", "modality", "chunk_id", "rnk", "hyde", F.lit(list_no).alias("list_no"),
                         F.lit(1.0).alias("weight"), F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))

    keys = ["mode", "hyde", "qid"]
    lists = listed(dense, 0, ("dense", "hybrid")).unionByName(listed(sparse_lists, 1, ("sparse", "hybrid")))
    per_modality = fusion.rrf_fuse(lists, [*keys, "modality"], rrf_k)
    fused = fusion.cross_modal(per_modality, queries, rrf_k, RERANK_TOP_N, keys=keys).select(*keys, "chunk_id", "rnk")
    small = _bounded(queries, MAX_BROADCAST_IDS // (6 * RERANK_TOP_N))
    found = fusion.attach_chunks(fused, index.chunks, broadcast_ranked=small)
    return models.rerank(found.join(queries.select("qid", "query"), "qid"), top_k, rerank_load, rerank_provider,
                         keys=keys)


def ablation_grid(results: DataFrame, queries: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """Mean recall at k per ``mode, hyde`` over all judged queries."""
    judged = queries.select("qid").join(qrels, "qid", "left_semi")
    modes = F.explode(F.array(*[F.lit(m) for m in ("dense", "sparse", "hybrid")])).alias("mode")
    grid = judged.select("qid", modes).select("qid", "mode", F.explode(F.array(F.lit(False), F.lit(True))).alias("hyde"))
    hits = first_hits(results, qrels, ["mode", "hyde", "qid"])
    return (grid.join(hits, ["mode", "hyde", "qid"], "left")
            .groupBy("mode", "hyde").agg(F.round(F.avg(recall_at_k(F.col("first_hit"), k)), 6).alias(f"recall_at_{k}"),
                                         F.count(F.lit(1)).alias("n_queries")))


def source_cards(retrieved: DataFrame, n: int = 8) -> DataFrame:
    """First ``n`` results of each query as an ordered array of cards."""
    card = source_card(F.col("modality"), F.lit(None).cast("string"), F.col("chunk_id"), F.col("content"),
                       F.col("metadata"))
    return (retrieved.where(F.col("rnk") <= n).groupBy("qid")
            .agg(collect_by_rank("rnk", card).alias("sources")))


def result_head_with_total(retrieved: DataFrame, n: int = 8) -> DataFrame:
    """First ``n`` rows of each query with the number of all its rows.  Results are ranked per query already, so the
    count runs over the same partitions and the retrieval once."""
    return retrieved.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("qid"))).where(F.col("rnk") <= n)


def answer_table(queries: DataFrame, retrieved: DataFrame, generate_load=None, guard_load=None,
                 history: DataFrame | None = None, **prompt) -> DataFrame:
    """One row per query: prompt, answer, source cards and guard verdict.  A query without results still answers.

    ``history`` (``qid, history`` as :func:`plumbline.operators.chat.history_window` gives it) goes before the prompt: the
    column ``messages`` then holds the turns and the prompt as the last, and the model gets them as JSON text.
    """
    chunk = F.struct("chunk_id", "doc_id", "modality", "content", "metadata")
    full = retrieved.where(F.col("rnk") <= 8).groupBy("qid").agg(collect_by_rank("rnk", chunk).alias("chunks"))
    joined = queries.select("qid", "query").join(full, "qid", "left")
    joined = joined.withColumn("chunks", F.coalesce("chunks", F.array().cast(dict(full.dtypes)["chunks"])))
    cards = F.transform("chunks", lambda c: source_card(c["modality"], F.lit(None).cast("string"), c["chunk_id"],
                                                        c["content"], c["metadata"]))
    prompted = joined.select("qid", "query", cards.alias("sources"),
                             build_prompt(F.col("query"), F.col("chunks"), **prompt).alias("prompt"))
    if history is not None:
        turn = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
        said = F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>"))
        prompted = (prompted.join(history.select("qid", "history"), "qid", "left")
                    .withColumn("messages", F.concat(said, turn)).drop("history"))
    answered = models.generate_job(prompted, generate_load).withColumn(
        "source_contents", F.transform("sources", lambda s: s["content"]))
    return models.guard_job(answered, guard_load).drop("source_contents")
