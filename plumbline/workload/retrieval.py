"""Registered queries: index tables, dense and sparse search, fusion, retrieval, evaluation, models, prompts."""
import re

from pyspark.sql import functions as F

from plumbline.functions import intent, prompts
from plumbline.operators import chat, dense, evaluation, fusion, ivf, models, postings, results, sparse
from plumbline.plans import retrieval
from plumbline.schemas import MODALITIES
from plumbline.session import shared_folder, spread
from plumbline.sources import readers, store
from plumbline.workload import sql, tables
from plumbline.workload.registry import register

TOP = 10


def _retrieved(spark, d, top_k=TOP, **options):
    return retrieval.retrieve(tables.queries(spark, d), tables.index(spark, d), dim=tables.DIM, top_k=top_k, **options)


def _asked(spark, d, adaptive=True):
    return retrieval.per_modality_queries(tables.queries(spark, d), adaptive=adaptive)


def _embedded(spark, d, adaptive=True):
    return models.embed_job(_asked(spark, d, adaptive), dim=tables.DIM, text="query")


# ---- index ---------------------------------------------------------------------------------------------------------

LANG_CHUNKS = sql.text_chunks("lang", "chunks")


@register("A1 S10", sql.with_(LANG_CHUNKS, sql.QUERIES, sql.bm25())
          + "SELECT org_id, modality, term, df, round(idf, 6) AS idf FROM ts")
def bm25_term_stats(spark, d):
    return store.rebuild_bm25(tables.text_chunks(spark, d, None))[2].select(
        "org_id", "modality", "term", "df", F.round("idf", 6).alias("idf"))


@register("A1", sql.with_(LANG_CHUNKS, sql.QUERIES, sql.bm25())
          + "SELECT org_id, modality, n_docs, round(avgdl, 6) AS avgdl FROM cs")
def bm25_corpus_stats(spark, d):
    stats = sparse.corpus_stats(sparse.forward_index(tables.text_chunks(spark, d, None)))
    return stats.select("org_id", "modality", "n_docs", F.round("avgdl", 6).alias("avgdl"))


@register("A1 S7", sql.with_(LANG_CHUNKS, sql.QUERIES, sql.bm25())
          + "SELECT org_id, chunk_id, term, tf, dl FROM tf JOIN dl USING (org_id, modality, chunk_id)")
def bm25_postings(spark, d):
    return sparse.postings(sparse.forward_index(tables.text_chunks(spark, d, None))).select(
        "org_id", "chunk_id", "term", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))


@register("S7", sql.with_(LANG_CHUNKS, sql.QUERIES, sql.bm25()) + """SELECT org_id, modality, term, df,
  round(idf, 6) AS idf, n_docs FROM ts JOIN cs USING (org_id, modality) WHERE org_id = 'en'""")
def tenant_bm25_index(spark, d):
    _, stats, terms = store.rebuild_bm25(tables.text_chunks(spark, d, None))
    return store.load_bm25(terms, stats, "en").select(
        "org_id", "modality", "term", "df", F.round("idf", 6).alias("idf"), "n_docs")


@register("S10 A4", sql.with_(sql.CORPUS) + """SELECT coalesce(modality, 'all') AS modality, count(*) AS n_chunks
FROM chunks GROUP BY ROLLUP (modality)""")
def index_build(spark, d):
    """Build and store the whole index afresh, then count its chunks."""
    path = shared_folder(spark, "fresh-index")
    built = retrieval.write_index(tables.corpus_chunks(spark, d), path, dim=tables.DIM)
    return store.modality_counts(retrieval.read_index(spark, path).chunks.join(
        built.forward.select("chunk_id"), "chunk_id", "left_semi"))


# ---- search --------------------------------------------------------------------------------------------------------

@register("T1 J2 F14 W1", """SELECT qid, modality, chunk_id, similarity, rnk FROM (SELECT *, row_number() OVER (
  PARTITION BY qid, modality ORDER BY similarity DESC, chunk_id) AS rnk FROM (
  SELECT a.vec_id::VARCHAR AS qid, b.vec_id::VARCHAR AS chunk_id, ['text', 'table', 'image'][b.vec_id % 3 + 1] AS modality,
  round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings a, embeddings b)) WHERE rnk <= 10""", ints="rnk")
def vector_topk(spark, d):
    """Every vector searches its ten nearest per modality."""
    corpus, asked = _vector_tables(spark, d)
    return dense.dense_topk(asked, corpus, k=10).select("qid", "modality", "chunk_id", "similarity", "rnk")


@register("T1 J2", """SELECT qid, modality, chunk_id, similarity, rnk FROM (SELECT *, row_number() OVER (
  PARTITION BY qid, modality ORDER BY similarity DESC, chunk_id) AS rnk FROM (
  SELECT a.vec_id::VARCHAR AS qid, b.vec_id::VARCHAR AS chunk_id, ['text', 'table', 'image'][b.vec_id % 3 + 1] AS modality,
  round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings a, embeddings b)) WHERE rnk <= 10""", ints="rnk")
def vector_topk_by_blocks(spark, d):
    """The same search by the block join used when the queries are too many to broadcast."""
    corpus, asked = _vector_tables(spark, d)
    found = dense.dense_topk(asked, corpus, k=10, max_broadcast_queries=0, block_rows=2_000, query_block_rows=1_000)
    return found.select("qid", "modality", "chunk_id", "similarity", "rnk")


def _vector_tables(spark, d):
    e = spread(tables.load(spark, d, "embeddings"))
    vec = F.col("vec_id").cast("string")
    modality = F.element_at(F.array(*[F.lit(m) for m in MODALITIES]), (F.col("vec_id") % 3 + 1).cast("int"))
    corpus = e.select(F.lit(tables.ORG).alias("org_id"), modality.alias("modality"), vec.alias("chunk_id"),
                      F.col("label").cast("string").alias("file_id"), "embedding")
    asked = e.select(vec.alias("qid"), F.lit(tables.ORG).alias("org_id"), F.col("label").cast("string").alias("label"),
                     F.explode(F.array(*[F.lit(m) for m in MODALITIES])).alias("modality"), "embedding")
    return corpus, asked


@register("P1 T1", """SELECT qid, modality, chunk_id, similarity, rnk FROM (SELECT *, row_number() OVER (
  PARTITION BY qid, modality ORDER BY similarity DESC, chunk_id) AS rnk FROM (
  SELECT a.vec_id::VARCHAR AS qid, b.vec_id::VARCHAR AS chunk_id, ['text', 'table', 'image'][b.vec_id % 3 + 1] AS modality,
  round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings a, embeddings b WHERE a.label = b.label OR a.label < 3)) WHERE rnk <= 5""", ints="rnk")
def vector_topk_in_files(spark, d):
    """Search limited to each query's own file (its label) before counting to k; some queries have no file list."""
    corpus, asked = _vector_tables(spark, d)
    files = F.when(F.col("label").cast("int") < 3, F.array().cast("array<string>")).otherwise(F.array("label"))
    return dense.dense_topk(asked.withColumn("file_ids", files), corpus, k=5).select(
        "qid", "modality", "chunk_id", "similarity", "rnk")


@register("T1 J2")
def vector_topk_lsh(spark, d):
    """Approximate search by random-projection buckets, with the share of the exact ten it found."""
    corpus, asked = _vector_tables(spark, d)
    exact = dense.dense_topk(asked, corpus, k=10).select("qid", "modality", "chunk_id")
    near = dense.dense_topk_lsh(asked, corpus, k=10, bucket_length=2.0, tables=6, projections=1).select(
        "qid", "modality", "chunk_id", F.lit(1).alias("found"))
    return exact.join(near, ["qid", "modality", "chunk_id"], "left").groupBy("modality").agg(
        F.count(F.lit(1)).alias("n_exact"), F.round(F.avg(F.coalesce("found", F.lit(0))), 4).alias("found_share"))


@register("T1 J2", """SELECT modality, 10 * (SELECT count(*) FROM embeddings) AS n_exact, true AS recall_reached, true AS few_scored
  FROM (SELECT unnest(['text', 'table', 'image']) AS modality)""")
def vector_topk_ivf(spark, d):
    """Search by cells and codes against the exact one: nine tenths of the exact ten at least are found, and less than a fifth of all
    pairs is scored exactly.  The test vectors have no neighbourhoods, so all cells are probed by code; tests probe a few."""
    corpus, asked = _vector_tables(spark, d)
    corpus = corpus.unionByName(corpus.withColumns({"chunk_id": F.concat(F.lit("-"), "chunk_id"), "embedding": F.reverse("embedding")}))
    quantizer = ivf.fit(corpus)
    codes = ivf.write_codes(corpus, quantizer, shared_folder(spark, "ivf"))
    exact = dense.dense_topk(asked, corpus, k=10).select("qid", "modality", "chunk_id")
    short = ivf.ivf_topk(asked, corpus, codes, quantizer, k=10, probes=len(quantizer.cells), scored=True)
    near = ivf.best_scored(short, 10).select("qid", "modality", "chunk_id", F.lit(1).alias("found"))
    pairs = short.groupBy("modality").agg(F.count("*").alias("scored"))
    share = exact.join(near, ["qid", "modality", "chunk_id"], "left").groupBy("modality").agg(
        F.count("*").alias("n_exact"), F.avg(F.coalesce("found", F.lit(0))).alias("recall"))
    sizes = corpus.groupBy("modality").agg(F.count("*").alias("n"))
    asked_for = asked.groupBy("modality").agg(F.count("*").alias("q"))
    return share.join(pairs, "modality").join(sizes, "modality").join(asked_for, "modality").select(
        "modality", "n_exact", (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("scored") < 0.2 * F.col("n") * F.col("q")).alias("few_scored"))


@register("J1 S6", """SELECT e.vec_id::VARCHAR AS chunk_id, d.lang AS org_id, len(embedding) AS dims FROM embeddings e
JOIN documents d ON d.doc_id = e.vec_id""")
def vectors_with_chunks(spark, d):
    docs = tables.load(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("org_id"), F.lit("text").alias("modality"),
        F.col("source").alias("file_id"))
    vectors = tables.load(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    return dense.join_vectors(vectors, docs).select("chunk_id", "org_id", F.size("embedding").cast("long").alias("dims"))


@register("S6 P1", """SELECT e.vec_id::VARCHAR AS chunk_id, len(embedding) AS dims FROM embeddings e
JOIN documents d ON d.doc_id = e.vec_id WHERE d.lang = 'en'""")
def tenant_vectors(spark, d):
    docs = tables.load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"),
                                                     F.col("lang").alias("org_id"))
    vectors = tables.load(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    return store.load_embeddings(vectors, docs, "en").select("chunk_id", F.size("embedding").cast("long").alias("dims"))


SEARCHED = sql.with_(sql.CORPUS, sql.QUERIES, sql.bm25())


@register("T2 A2 J3 T3", SEARCHED + f"""SELECT qid, modality, chunk_id, score, rnk FROM (SELECT s.*, query, row_number() OVER (
  PARTITION BY qid, modality ORDER BY score DESC, chunk_id) AS rnk FROM scored s JOIN q USING (qid) WHERE score <> 0)
  WHERE rnk <= {sql.ADAPTIVE_K}""", ints="rnk")
def bm25_topk(spark, d):
    idx = tables.index(spark, d)
    return sparse.sparse_topk(_asked(spark, d), idx.forward, idx.term_stats, idx.corpus_stats, max_k=45).select(
        "qid", "modality", "chunk_id", "score", "rnk")


BM25_TOPK = SEARCHED + f"""SELECT qid, modality, chunk_id, score, rnk FROM (SELECT s.*, query, row_number() OVER (
  PARTITION BY qid, modality ORDER BY score DESC, chunk_id) AS rnk FROM scored s JOIN q USING (qid) WHERE score <> 0)
  WHERE rnk <= {sql.ADAPTIVE_K}"""


@register("T2 J3", BM25_TOPK, ints="rnk")
def bm25_topk_by_postings(spark, d):
    """The same lists from stored posting blocks, cut by each query's floor; only files with the terms asked for are opened."""
    found = postings.postings_topk(_asked(spark, d), tables.postings(spark, d), tables.counts(spark, d)[2], max_k=45)
    return found.select("qid", "modality", "chunk_id", "score", "rnk")


@register("T2 J3", BM25_TOPK, ints="rnk")
def bm25_topk_by_joined_postings(spark, d):
    """The search used when the terms asked for lie in too many partitions to be named: blocks are found by joins alone."""
    found = postings.postings_topk(_asked(spark, d), tables.postings(spark, d), tables.counts(spark, d)[2], max_k=45, max_named=0)
    return found.select("qid", "modality", "chunk_id", "score", "rnk")


@register("T2", SEARCHED + """SELECT qid, modality, chunk_id, score, rnk FROM (SELECT *, row_number() OVER (
  PARTITION BY qid, modality ORDER BY score DESC, chunk_id) AS rnk FROM (SELECT q.qid, c.modality, c.chunk_id,
  coalesce(s.score, 0.0) AS score FROM q CROSS JOIN chunks c LEFT JOIN scored s USING (qid, modality, chunk_id)))
  WHERE rnk <= 500""", ints="rnk")
def bm25_topk_padded(spark, d):
    """Deep lists: chunks scoring zero fill them up in id order."""
    idx = tables.index(spark, d)
    return sparse.sparse_topk(_asked(spark, d, False).withColumn("k", F.lit(500)), idx.forward, idx.term_stats,
                              idx.corpus_stats, max_k=500, pad_zero=True).select(
        "qid", "modality", "chunk_id", "score", "rnk")


@register("T2 P1", sql.with_(sql.CORPUS, sql.QUERIES, sql.bm25(), sql.QRELS) + """SELECT qid, chunk_id, score, rnk FROM (SELECT s.*, row_number() OVER (
  PARTITION BY s.qid ORDER BY score DESC, s.chunk_id) AS rnk FROM scored s JOIN chunks c USING (chunk_id)
  JOIN qrels g ON g.qid = s.qid AND g.doc_id = c.file_id WHERE s.modality = 'text' AND score <> 0) WHERE rnk <= 5""", ints="rnk")
def bm25_topk_in_files(spark, d):
    """Search limited to the files known to hold the passage."""
    idx = tables.index(spark, d)
    files = tables.qrels(spark, d).groupBy("qid").agg(F.collect_set("doc_id").alias("file_ids"))
    asked = tables.queries(spark, d).join(files, "qid").withColumn("modality", F.lit("text"))
    return sparse.sparse_topk(asked, idx.forward, idx.term_stats, idx.corpus_stats, k=5).select(
        "qid", "chunk_id", "score", "rnk")


@register("A2 J3", sql.with_(sql.CORPUS, sql.QUERIES, sql.bm25(), sql.QRELS) + """SELECT p.qid, p.chunk_id,
  coalesce(score, 0.0) AS score FROM (SELECT qid, chunk_id FROM chunks JOIN qrels USING (doc_id)) p
  LEFT JOIN scored USING (qid, chunk_id)""")
def bm25_pair_scores(spark, d):
    """Scores of given pairs: each query with the chunks of its gold documents."""
    idx = tables.index(spark, d)
    pairs = (idx.chunks.select("doc_id", "chunk_id", "org_id", "modality")
             .join(tables.qrels(spark, d).select("qid", "doc_id"), "doc_id")
             .join(tables.queries(spark, d).select("qid", "query"), "qid"))
    return sparse.bm25_score(pairs, idx.forward, idx.term_stats, idx.corpus_stats).select("qid", "chunk_id", "score")


# ---- fusion --------------------------------------------------------------------------------------------------------

FUSED = sql.with_(sql.CORPUS, sql.QUERIES, sql.bm25(), sql.dense(), sql.HYBRID)


def _lists(spark, d):
    queries = tables.queries(spark, d)
    prepared = retrieval.prepare_queries(queries, dim=tables.DIM)
    return retrieval.candidate_lists(queries, prepared, tables.index(spark, d))


@register("Q1 A3 W1 U1 M1", FUSED + "SELECT qid, modality, chunk_id, rrf_score, rnk FROM hybrid", ints="rnk")
def hybrid_by_modality(spark, d):
    return retrieval.hybrid_modality(*_lists(spark, d)).select("qid", "modality", "chunk_id", "rrf_score", "rnk")


@register("U1", FUSED + """SELECT qid, modality, chunk_id, row_number() OVER (PARTITION BY qid, modality
  ORDER BY first_seen) AS rnk FROM hybrid""", ints="rnk")
def dense_sparse_union(spark, d):
    """De-duplicated union of the two lists in first-seen order."""
    return fusion.ordered_union(*_lists(spark, d), keys=["qid", "modality"]).select("qid", "modality", "chunk_id", "rnk")


@register("A3 U2 T4 Q2", FUSED.rstrip() + ",\n" + sql.CROSSED
          + "SELECT qid, chunk_id, fused AS rrf_score, fused_rnk AS rnk FROM crossed", ints="rnk")
def cross_modal_fusion(spark, d):
    fused = fusion.cross_modal(retrieval.hybrid_modality(*_lists(spark, d)), tables.queries(spark, d), top=50)
    return fused.select("qid", "chunk_id", "rrf_score", "rnk")


@register("U3", FUSED + f"""SELECT qid, modality, chunk_id, row_number() OVER (PARTITION BY qid
  ORDER BY {sql.LIST_NO}, rnk) AS rnk FROM hybrid""", ints="rnk")
def concatenated_lists(spark, d):
    return fusion.cross_modal(retrieval.hybrid_modality(*_lists(spark, d)), tables.queries(spark, d), fusion="concat"
                              ).select("qid", "modality", "chunk_id", "rnk")


RETRIEVED = sql.with_(*sql.RETRIEVE, sql.reranked(TOP))


@register("Q2 T3 T4 T5 T8 J4 M1 M2", RETRIEVED
          + "SELECT qid, chunk_id, doc_id, section_id, modality, fused_rnk, rerank_score, rnk FROM retrieved", ints="rnk fused_rnk")
def retrieve(spark, d):
    """The whole retrieval of every query."""
    return _retrieved(spark, d).select("qid", "chunk_id", "doc_id", "section_id", "modality", "fused_rnk",
                                       "rerank_score", "rnk")


@register("Q2 T2 J3", RETRIEVED + "SELECT qid, chunk_id, fused_rnk, rerank_score, rnk FROM retrieved", ints="rnk fused_rnk")
def retrieve_by_postings(spark, d):
    """The whole retrieval with the sparse lists from posting blocks."""
    return _retrieved(spark, d, postings=tables.postings(spark, d)).select("qid", "chunk_id", "fused_rnk", "rerank_score", "rnk")


@register("T5", sql.with_(*sql.RETRIEVE) + "SELECT qid, chunk_id, fused_rnk AS rnk FROM crossed WHERE fused_rnk <= 8", ints="rnk")
def retrieve_without_rerank(spark, d):
    return _retrieved(spark, d, 8, rerank_provider="none").select("qid", "chunk_id", "rnk")


@register("U3 Q2", sql.with_(*sql.RETRIEVE[:-1], f"""listed AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid
  ORDER BY {sql.LIST_NO}, rnk) AS fused_rnk FROM hybrid)""", sql.reranked(8, "listed"))
          + "SELECT qid, chunk_id, rnk, rerank_score FROM retrieved", ints="rnk")
def retrieve_concatenated(spark, d):
    """Lists joined end to end and reranked without cross-modal fusion."""
    return _retrieved(spark, d, 8, fusion_mode="concat").select("qid", "chunk_id", "rnk", "rerank_score")


@register("M2 T5", sql.with_(sql.CORPUS, sql.QUERIES, sql.QRELS) + f"""SELECT qid, chunk_id,
  {sql.overlap()} AS rerank_score FROM chunks JOIN qrels USING (doc_id) JOIN q USING (qid)""")
def rerank_scores(spark, d):
    pairs = (tables.index(spark, d).chunks.join(tables.qrels(spark, d).select("qid", "doc_id"), "doc_id")
             .join(tables.queries(spark, d).select("qid", "query"), "qid"))
    return models.rerank_job(pairs).select("qid", "chunk_id", "rerank_score")


@register("J4", sql.with_(*sql.RETRIEVE) + """SELECT qid, chunk_id, doc_id, modality, fused_rnk AS rnk FROM crossed
  JOIN chunks USING (chunk_id) WHERE modality <> 'image'""", ints="rnk")
def fused_with_chunk_rows(spark, d):
    """Fused ids looked up in a table without the image chunks: ids without a row drop out."""
    idx = tables.index(spark, d)
    fused = fusion.cross_modal(retrieval.hybrid_modality(*_lists(spark, d)), tables.queries(spark, d), top=50)
    return fusion.attach_chunks(fused.select("qid", "chunk_id", "rnk"), idx.chunks.where("modality <> 'image'")).select(
        "qid", "chunk_id", "doc_id", "modality", "rnk")


# ---- query understanding -------------------------------------------------------------------------------------------

TURNS = "SELECT conv_id, turn, text AS query FROM conversations"


def _turns(spark, d):
    return tables.load(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"))


@register("F5 F6", f"SELECT conv_id, turn, {sql.INTENT} AS intent, round({sql.TABLE_WEIGHT}, 6) AS table_weight FROM ({TURNS})")
def query_intents(spark, d):
    q = F.col("query")
    return _turns(spark, d).select("conv_id", "turn", intent.classify_intent(q).alias("intent"),
                                   F.round(intent.table_query_weight(q), 6).alias("table_weight"))


@register("F5 F6", f"""SELECT p_partkey, query, {sql.INTENT} AS intent, round({sql.TABLE_WEIGHT}, 6) AS table_weight,
  floor(30 * {sql.TABLE_WEIGHT})::INT AS table_k FROM (SELECT p_partkey, {{q}} AS query FROM part)""".replace("{q}", """
  CASE p_partkey % 6 WHEN 0 THEN 'What is the ' || p_name WHEN 1 THEN 'Compare ' || p_name || ' vs ' || p_brand
  WHEN 2 THEN 'How to implement the ' || p_type WHEN 3 THEN 'Explain why ' || p_name || ' has size ' || p_size
  WHEN 4 THEN 'How many ' || p_type || ' parts, total and average rate?' ELSE 'Tell me of ' || p_name END"""))
def part_questions(spark, d):
    """Questions made from the part table, of every intent."""
    q = F.expr("""CASE p_partkey % 6 WHEN 0 THEN 'What is the ' || p_name WHEN 1 THEN 'Compare ' || p_name || ' vs '
      || p_brand WHEN 2 THEN 'How to implement the ' || p_type WHEN 3 THEN 'Explain why ' || p_name || ' has size '
      || p_size WHEN 4 THEN 'How many ' || p_type || ' parts, total and average rate?'
      ELSE 'Tell me of ' || p_name END""")
    asked = tables.load(spark, d, "part").select("p_partkey", q.alias("query"))
    return asked.select("p_partkey", "query", intent.classify_intent(F.col("query")).alias("intent"),
                        F.round(intent.table_query_weight(F.col("query")), 6).alias("table_weight"),
                        intent.adaptive_k(F.lit("table"), F.col("query"), {"table": 30}).alias("table_k"))


@register("F7 M3", f"SELECT conv_id || ':' || turn AS qid FROM ({TURNS}) WHERE {sql.INTENT} IN ('analytical', 'general')")
def queries_to_expand(spark, d):
    return models.expand_job(_turns(spark, d).withColumn("qid", F.concat_ws(":", "conv_id", "turn"))).select("qid")


@register("F8 J8 M3", f"""SELECT conv_id || ':' || turn AS qid, CASE WHEN {sql.INTENT} NOT IN ('analytical', 'general')
  OR conv_id % 3 = 0 THEN query ELSE query || ' ' || reverse(query) END AS embed_query FROM ({TURNS})""")
def expanded_queries(spark, d):
    """Passages from a callable; one in three conversations gets a failure notice and falls back to the query."""
    asked = _turns(spark, d).withColumn("qid", F.concat_ws(":", "conv_id", "turn"))

    def load():
        return lambda texts: [t[::-1] for t in texts]

    passages = models.expand_job(asked, load).withColumn(
        "passage", F.when(F.split("qid", ":")[0].cast("int") % 3 == 0, F.lit("[Model ERROR] no answer"))
        .otherwise(F.col("passage")))
    return models.with_expansion(asked, passages).select("qid", "embed_query")


@register("M1 F15", sql.with_(sql.text_chunks(), sql.embedded("e", "text_chunks", "chunk_id", "content", 64))
          + "SELECT chunk_id, b, round(w, 6) AS w FROM e")
def hashed_embeddings(spark, d):
    vectors = models.embed_job(tables.text_chunks(spark, d).select("chunk_id", "content"), dim=64)
    return vectors.select("chunk_id", F.posexplode("embedding").alias("b", "w")).where("w <> 0").select(
        "chunk_id", F.col("b").cast("long").alias("b"), F.round(F.col("w").cast("double"), 6).alias("w"))


@register("M1 F15", sql.with_(sql.text_chunks(), sql.embedded("e", "text_chunks", "chunk_id", "content", 64))
          + "SELECT chunk_id, b, round(w, 6) AS w FROM e")
def embeddings_kept_by_content(spark, d):
    """Vectors stored by content: half of the chunks are embedded first, all of them then, each distinct text once."""
    chunks, path = tables.text_chunks(spark, d).select("chunk_id", "content"), shared_folder(spark, "vectors")
    results.embed_once(chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == 0), path, "hashed", dim=64)
    vectors = results.embed_once(chunks, path, "hashed", dim=64)
    return vectors.select("chunk_id", F.posexplode("embedding").alias("b", "w")).where("w <> 0").select(
        "chunk_id", F.col("b").cast("long").alias("b"), F.round(F.col("w").cast("double"), 6).alias("w"))


# ---- evaluation ----------------------------------------------------------------------------------------------------

EVALUATED = sql.with_(*sql.RETRIEVE, sql.reranked(TOP), sql.QRELS, sql.evaluated())


def _per_query(spark, d):
    return evaluation.per_query_eval(tables.described_queries(spark, d), _retrieved(spark, d), tables.qrels(spark, d))


@register("E1 E2 E3 E4 J6 W2", EVALUATED + "SELECT * FROM per_query")
def per_query_evaluation(spark, d):
    return _per_query(spark, d)


@register("A6", EVALUATED + "SELECT count(*) AS n_queries, " + ", ".join(
    f"round(avg({m}), 6) AS {m}" for m in evaluation.METRICS) + " FROM per_query")
def metric_means(spark, d):
    return evaluation.metric_means(_per_query(spark, d), digits=6)


_MEANS = "count(*) AS n_queries, " + ", ".join(f"round(avg({m}), 4) AS {m}" for m in evaluation.METRICS)


@register("A7", EVALUATED + f"""SELECT CASE WHEN grouping(type) = 0 THEN 'type' WHEN grouping(source) = 0 THEN 'source'
  WHEN grouping(intent) = 0 THEN 'intent' ELSE 'all' END AS dimension, CASE WHEN grouping(type) = 0 THEN type
  WHEN grouping(source) = 0 THEN source WHEN grouping(intent) = 0 THEN intent ELSE 'all' END AS value, {_MEANS}
  FROM per_query GROUP BY GROUPING SETS ((type), (source), (intent), ())""")
def metric_breakdown(spark, d):
    return evaluation.metric_breakdown(_per_query(spark, d))


@register("T7", sql.with_(*sql.RETRIEVE[:4], sql.QRELS, """retrieved AS (SELECT qid, doc_id, section_id, row_number() OVER (
  PARTITION BY qid ORDER BY score DESC, chunk_id) AS rnk FROM nearest JOIN chunks USING (chunk_id)
  WHERE nearest.modality = 'text')""", sql.evaluated("(SELECT * FROM retrieved WHERE rnk <= 10)"))
          + """SELECT qid, source, intent, substr(query, 1, 90) AS query FROM per_query WHERE recall_at_5 = 0
  ORDER BY qid LIMIT 8""")
def failed_queries(spark, d):
    """Failures of dense text search alone."""
    idx = tables.index(spark, d)
    asked = models.embed_job(tables.queries(spark, d).withColumn("modality", F.lit("text")), dim=tables.DIM, text="query")
    found = fusion.attach_chunks(dense.dense_topk(asked, idx.vectors, k=10).select("qid", "chunk_id", "rnk"), idx.chunks)
    return evaluation.failures(evaluation.per_query_eval(
        tables.described_queries(spark, d), found, tables.qrels(spark, d)))


@register("P4 J5", sql.with_(sql.QUERIES, sql.QRELS, """docs AS (SELECT DISTINCT doc_id FROM qrels ORDER BY doc_id LIMIT 10)""")
          + """SELECT qid, query FROM q WHERE qid IN (SELECT qid FROM qrels JOIN docs USING (doc_id)) ORDER BY qid LIMIT 200""")
def evaluation_subset(spark, d):
    docs = tables.text_sections(spark, d).select("doc_id")
    return evaluation.select_eval_subset(tables.queries(spark, d), tables.qrels(spark, d), docs, 10, 200).select(
        "qid", "query")


@register("J5", sql.with_(sql.QRELS) + "SELECT qid, doc_id, section_id FROM qrels")
def judged_pairs(spark, d):
    return tables.find_qrels(spark, d)


#: A stored passage for every query: another query's words, many times, so that an expanded query lies elsewhere.
PASSAGES = """qp AS (SELECT q.qid, q.query || ' ' || repeat(o.query || ' ', 20) AS query
  FROM q JOIN q o ON o.qid::BIGINT = (q.qid::BIGINT * 7 + 3) % (SELECT count(*) FROM q))"""


def _passages(spark, d):
    queries = tables.queries(spark, d).select("qid", "query")
    n = queries.count()
    other = queries.select(F.col("qid").cast("long").alias("o"), F.repeat(F.concat("query", F.lit(" ")), F.lit(20)).alias("passage"))
    return queries.join(other, (F.col("qid").cast("long") * 7 + 3) % n == F.col("o")).select("qid", "passage")


def _ablation_sql():
    """Each mode ranks its own lists; with expansion the dense list is that of query and passage."""
    renamed = {"ce": "cx", "ce_c": "cx_c", "cn": "cxn", "qe": "qx", "qe_c": "qx_c", "qn": "qxn", "nearest": "nearest_x"}
    expanded = re.sub(r"\b(" + "|".join(renamed) + r")\b", lambda m: renamed[m[1]], sql.dense(source="qp"))
    cut = "<= CASE modality WHEN 'image' THEN 20 ELSE 30 END"
    lists = [PASSAGES, expanded] + [f"""dense_list_{hyde} AS (SELECT * FROM (SELECT qid, modality, chunk_id, row_number() OVER (
  PARTITION BY qid, modality ORDER BY score DESC, chunk_id) AS rnk FROM {nearest}) WHERE rnk {cut})"""
        for hyde, nearest in (("false", "nearest"), ("true", "nearest_x"))]
    lists.append(f"""sparse_list AS (SELECT * FROM (SELECT qid, modality, chunk_id, row_number() OVER (
  PARTITION BY qid, modality ORDER BY score DESC, chunk_id) AS rnk FROM scored WHERE score <> 0) WHERE rnk {cut})""")
    found = []
    for hyde in ("false", "true"):
        lists.append(f"""both_{hyde} AS (SELECT qid, modality, chunk_id, rnk, 0 AS list_no FROM dense_list_{hyde}
  UNION ALL SELECT qid, modality, chunk_id, rnk, 1 FROM sparse_list)""")
        for mode, keep in {"dense": "list_no = 0", "sparse": "list_no = 1", "hybrid": "true"}.items():
            name = f"{mode}_{hyde}"
            lists.append(f"""h_{name} AS (SELECT *, row_number() OVER (PARTITION BY qid, modality ORDER BY s DESC, f, chunk_id)
  AS rnk FROM (SELECT qid, modality, chunk_id, round(sum(1.0::DOUBLE / (60 + rnk)), 12) AS s,
  min(list_no * 1000 + rnk) AS f FROM both_{hyde} WHERE {keep} GROUP BY ALL)),
x_{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, f, chunk_id) AS fused_rnk
  FROM (SELECT qid, chunk_id, round(sum({sql.CROSS_WEIGHT} / (60 + rnk)), 12) AS s, min({sql.LIST_NO} * 1000 + rnk) AS f
  FROM h_{name} JOIN q USING (qid) GROUP BY ALL)) WHERE fused_rnk <= 50),
r_{name} AS (SELECT * FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY {sql.overlap()} DESC,
  fused_rnk) AS rnk FROM x_{name} JOIN chunks USING (chunk_id) JOIN q USING (qid)) WHERE rnk <= 8)""")
            found.append(f"""SELECT '{mode}' AS mode, {hyde} AS hyde, qid, coalesce(min(rnk) <= 5, false)::INT::DOUBLE AS hit
  FROM (SELECT DISTINCT qid FROM qrels) LEFT JOIN (SELECT qid, rnk FROM r_{name} JOIN qrels USING (qid, doc_id)) USING (qid) GROUP BY qid""")
    return (sql.with_(sql.CORPUS, sql.QUERIES, sql.bm25(), sql.dense(), sql.QRELS, *lists)
            + f"SELECT mode, hyde, round(avg(hit), 6) AS recall_at_5, count(*) AS n_queries FROM ({' UNION ALL '.join(found)}) GROUP BY mode, hyde")


@register("E5 A8", _ablation_sql())
def ablation_grid(spark, d):
    """Recall by mode, without and with expansion by stored passages."""
    queries = tables.queries(spark, d)
    results = retrieval.ablation(queries, tables.index(spark, d), _passages(spark, d), dim=tables.DIM)
    return retrieval.ablation_grid(results, queries, tables.qrels(spark, d))


@register("S11", EVALUATED + "SELECT qid, n_retrieved::VARCHAR AS n_retrieved, intent, recall_at_5::INT AS recall_at_5 FROM per_query")
def written_results(spark, d):
    """Results written as JSON and CSV; the CSV is read back by its header."""
    per_query, path = _per_query(spark, d), shared_folder(spark, "results")
    readers.write_results(evaluation.metric_means(per_query), per_query.drop("query"), path)
    return spark.read.option("header", True).csv(f"{path}/per_query").select(
        "qid", "n_retrieved", "intent", F.col("recall_at_5").cast("double").cast("int").alias("recall_at_5"))


# ---- prompts and answers -------------------------------------------------------------------------------------------

TOP3 = sql.with_(*sql.RETRIEVE, sql.reranked(3))


@register("P5", TOP3 + """SELECT qid, rnk, chunk_id, modality, modality AS expert_id, substr(content, 1, 1000) AS content
  FROM retrieved""", ints="rnk")
def source_cards(spark, d):
    cards = retrieval.source_cards(_retrieved(spark, d), 3)
    return cards.select("qid", F.posexplode("sources").alias("pos", "s")).select(
        "qid", (F.col("pos") + 1).alias("rnk"), "s.chunk_id", "s.modality", "s.expert_id", "s.content")


@register("P7", sql.with_(*sql.RETRIEVE, sql.reranked(TOP)) + """SELECT qid, chunk_id, rnk, total FROM (SELECT *,
  count(*) OVER (PARTITION BY qid) AS total FROM retrieved) WHERE rnk <= 8""", ints="rnk")
def result_heads(spark, d):
    return retrieval.result_head_with_total(_retrieved(spark, d)).select("qid", "chunk_id", "rnk", "total")


@register("F9", TOP3 + """SELECT qid, string_agg('[' || rnk || '][' || upper(modality) || '|' || substr(doc_id, 1, 8)
  || '] ' || content, chr(10) || chr(10) ORDER BY rnk) AS context FROM retrieved GROUP BY qid""")
def contexts(spark, d):
    from plumbline.functions.arrays import collect_by_rank
    grouped = _retrieved(spark, d, 3).groupBy("qid").agg(
        collect_by_rank("rnk", F.struct("doc_id", "modality", "content")).alias("sources"))
    return grouped.select("qid", prompts.format_context(F.col("sources")).alias("context"))


def _answered(spark, d):
    queries = tables.queries(spark, d)
    return retrieval.answer_table(queries, _retrieved(spark, d, 3), system="SYSTEM", image_reminder="IMAGES")


@register("F10 Q3", TOP3 + """SELECT qid, 'SYSTEM' || chr(10) || chr(10) || '--- Sources ---' || chr(10)
  || string_agg(chr(10) || '[Source ' || rnk || ' (' || modality || ')]:' || chr(10) || substr(content, 1, 1500) || chr(10),
  '' ORDER BY rnk) || chr(10) || chr(10) || '--- Question ---' || chr(10) || any_value(query)
  || CASE WHEN bool_or(modality = 'image') THEN chr(10) || chr(10) || 'IMAGES' ELSE '' END AS prompt
  FROM retrieved GROUP BY qid""")
def answer_prompts(spark, d):
    return _answered(spark, d).select("qid", "prompt")


@register("Q3 M4 M5", TOP3 + """SELECT qid, substr(content, 1, 1000) AS answer, true AS verified, 0.5::DOUBLE AS score,
  n_sources FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n_sources FROM retrieved) WHERE rnk = 1""")
def answers(spark, d):
    """Extractive answers with sources and verdict; no model reply leaves the default verdict."""
    return _answered(spark, d).select("qid", "answer", "guard.verified", "guard.score",
                                      F.size("sources").cast("long").alias("n_sources"))


@register("Q3 W4 F10", TOP3 + """, prompts AS (SELECT qid, 'SYSTEM' || chr(10) || chr(10) || '--- Sources ---' || chr(10)
  || string_agg(chr(10) || '[Source ' || rnk || ' (' || modality || ')]:' || chr(10) || substr(content, 1, 1500) || chr(10),
  '' ORDER BY rnk) || chr(10) || chr(10) || '--- Question ---' || chr(10) || any_value(query)
  || CASE WHEN bool_or(modality = 'image') THEN chr(10) || chr(10) || 'IMAGES' ELSE '' END AS prompt FROM retrieved GROUP BY qid),
said AS (SELECT conv_id::VARCHAR AS qid, role, substr(text, 1, 500) AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back
  FROM conversations WHERE text <> ''),
turns AS (SELECT qid, role, content, 7 - back AS place FROM said WHERE back <= 6 AND qid IN (SELECT qid FROM prompts)
  UNION ALL SELECT qid, 'user', prompt, 8 FROM prompts)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY place) - 1 AS pos, role, content FROM turns""")
def answers_with_history(spark, d):
    """Messages of each answer: the last turns of the conversation with the query's number, then the prompt."""
    said = tables.load(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role",
                                                         F.col("text").alias("content"))
    history = chat.history_window(said).withColumnRenamed("session_id", "qid")
    answered = retrieval.answer_table(tables.queries(spark, d), _retrieved(spark, d, 3), history=history, system="SYSTEM",
                                      image_reminder="IMAGES")
    return answered.select("qid", F.posexplode("messages").alias("pos", "m")).select(
        "qid", F.col("pos").cast("long").alias("pos"), "m.role", "m.content")


@register("M4", TOP3 + """SELECT qid, query, reverse(query) AS gold, substr(content, 1, 1000) AS generated FROM retrieved
  WHERE rnk = 1 ORDER BY qid LIMIT 15""")
def generation_beside_gold(spark, d):
    gold = tables.queries(spark, d).select("qid", F.reverse("query").alias("answer"))
    return models.generation_eval(_answered(spark, d), gold)


@register("M5 F19 F20", """SELECT conv_id, turn, md5('GUARD' || chr(10) || chr(10) || 'Answer: ' || substr(text, 1, 1000)
  || chr(10) || chr(10) || 'Sources:' || chr(10) || '[Source 1]: ' || substr(text, 1, 500) || chr(10) || chr(10)
  || '[Source 2]: ' || role) AS prompt, turn % 2 = 0 AS verified, 0.25::DOUBLE AS score,
  role AS claim FROM conversations""")
def guard_verdicts(spark, d):
    """Every turn is checked against two sources; replies come fenced and are parsed."""
    turns = tables.load(spark, d, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("answer"), F.array("text", "role").alias("contents"))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(
        (F.col("turn") % 2 == 0).alias("verified"), F.lit("0.25").alias("score"),
        F.array(F.struct(F.col("role").alias("claim"), F.lit(True).alias("supported"))).alias("claims"))), F.lit("\n```"))
    verdict = prompts.parse_guard(reply, F.col("answer"), F.col("contents"))
    return turns.select("conv_id", "turn", F.md5(prompts.build_guard_prompt(
        F.col("answer"), F.col("contents"), "GUARD")).alias("prompt"), verdict.alias("g")).select(
        "conv_id", "turn", "prompt", "g.verified", "g.score", F.col("g.claims")[0]["claim"].alias("claim"))


@register("M5", """SELECT conv_id, turn, turn % 2 = 0 AS verified, CASE WHEN turn % 2 = 0 THEN 0.5::DOUBLE ELSE 0.75 END AS score
FROM conversations""")
def guard_job_replies(spark, d):
    """The guard job with a callable whose replies are partly unreadable."""
    turns = tables.load(spark, d, "conversations").select(
        "conv_id", "turn", F.concat(F.col("turn").cast("string"), F.lit(" "), F.col("text")).alias("answer"),
        F.array("text").alias("source_contents"))

    def load():
        def reply(prompts_):
            odd = [int(p.split("Answer: ")[1].split(" ")[0]) % 2 for p in prompts_]
            return ['{"verified": false, "score": 0.75}' if o else "no JSON here" for o in odd]
        return reply

    return models.guard_job(turns, load).select("conv_id", "turn", "guard.verified", "guard.score")


@register("M6 G4", sql.with_(sql.PAGES) + """SELECT doc_id, '[Caption]: ' || length(fig_caption) || ' [OCR]: ' || caption
  || ' [Context]: ' || substr(nearby_text, 1, 300) AS content FROM pg""")
def described_images(spark, d):
    """A describing callable over image payloads feeds the image chunks."""
    from plumbline.operators.chunking import assemble_image_chunks
    pages = tables.page_images(spark, d).select(
        "doc_id", "section_id", "image_id", "org_id", "file_id", "nearby_text", F.lit("").alias("fig_caption"),
        F.concat_ws("\n", "fig_caption", "caption").alias("image_data"))

    def load():
        return lambda images: [(str(len(data.split("\n")[0])), data.split("\n")[1]) for data in images]

    return assemble_image_chunks(models.describe_images_job(pages, load)).select("doc_id", "content")
