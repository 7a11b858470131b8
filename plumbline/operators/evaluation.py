"""Retrieval metrics per query, their means, breakdowns and failures."""
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.intent import classify_intent
from plumbline.schemas import EVAL_KS

RANK_CUT = 10
METRICS = [f"recall_at_{k}" for k in EVAL_KS] + ["mrr_at_10", "ndcg_at_10"]


def recall_at_k(first_hit: Column, k: int) -> Column:
    return F.when(first_hit <= k, 1.0).otherwise(0.0)


def mrr_at_k(first_hit: Column, k: int = RANK_CUT) -> Column:
    return F.when(first_hit <= k, F.lit(1.0) / first_hit).otherwise(0.0)


def ndcg_at_k(first_hit: Column, k: int = RANK_CUT) -> Column:
    """One relevant place, so the gain of the first hit is the whole nDCG."""
    return F.when(first_hit <= k, F.lit(1.0) / F.log2(first_hit + 1)).otherwise(0.0)


def select_eval_subset(queries: DataFrame, qrels: DataFrame, documents: DataFrame, max_docs: int | None = 50,
                       max_queries: int | None = 200) -> DataFrame:
    """Judged queries of the first ``max_docs`` judged documents present, cut to the first ``max_queries``; both by
    id.  The limits are the operator's purpose; None keeps everything."""
    present = qrels.join(documents.select("doc_id"), "doc_id", "left_semi")
    if max_docs:
        kept = present.select("doc_id").distinct().orderBy("doc_id").limit(max_docs)
        present = present.join(kept, "doc_id", "left_semi")
    chosen = queries.join(present, "qid", "left_semi")
    return chosen.orderBy("qid").limit(max_queries) if max_queries else chosen


def first_hits(retrieved: DataFrame, qrels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Smallest rank at which a query meets one of its gold places; queries without hit do not appear."""
    keys = keys or ["qid"]
    return (retrieved.select(*keys, "doc_id", "section_id", "rnk")
            .join(qrels.select("qid", "doc_id", "section_id").distinct(), ["qid", "doc_id", "section_id"])
            .groupBy(*keys).agg(F.min("rnk").alias("first_hit")))


def per_query_eval(queries: DataFrame, retrieved: DataFrame, qrels: DataFrame, top_k: int = RANK_CUT,
                   ks: tuple = EVAL_KS) -> DataFrame:
    """One row per judged query; a query that retrieved nothing counts with zeros.

    Results must reach as deep as the largest k, or recall at that k would be a different number.
    """
    if top_k < max(ks):
        raise ValueError(f"results are cut at {top_k}, metrics need {max(ks)}")
    gold = qrels.groupBy("qid").agg(F.min(F.struct("doc_id", "section_id")).alias("gold"))
    places = qrels.select("qid", "doc_id", "section_id").distinct().withColumn("_gold", F.lit(True))
    # one pass over the results, which may be a whole retrieval: its size and first hit come from the same rows
    found = (retrieved.select("qid", "doc_id", "section_id", "rnk").join(places, ["qid", "doc_id", "section_id"], "left")
             .groupBy("qid").agg(F.count(F.lit(1)).alias("n_retrieved"), F.min(F.when(F.col("_gold"), F.col("rnk"))).alias("first_hit")))
    hit = F.col("first_hit")
    return (queries.join(gold, "qid").join(found, "qid", "left")
            .select("qid", "query", F.coalesce("type", F.lit("abstractive")).alias("type"),
                    F.coalesce("source", F.lit("text")).alias("source"), F.col("gold.doc_id").alias("gold_doc"),
                    F.col("gold.section_id").alias("gold_section"),
                    F.coalesce("n_retrieved", F.lit(0)).alias("n_retrieved"),
                    classify_intent(F.col("query")).alias("intent"),
                    *[recall_at_k(hit, k).alias(f"recall_at_{k}") for k in ks],
                    mrr_at_k(hit).alias("mrr_at_10"), ndcg_at_k(hit).alias("ndcg_at_10")))


def metric_means(per_query: DataFrame, metrics: list[str] = METRICS, digits: int | None = None) -> DataFrame:
    mean = lambda m: F.avg(m) if digits is None else F.round(F.avg(m), digits)
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), *[mean(m).alias(m) for m in metrics])


def metric_breakdown(per_query: DataFrame, by: tuple = ("type", "source", "intent"), metrics: list[str] = METRICS,
                     digits: int = 4) -> DataFrame:
    """Means over all queries and per value of each column of ``by``, in one pass of grouping sets."""
    columns = [F.col(c) for c in by]
    sets = [[c] for c in columns] + [[]]
    grouped = per_query.groupingSets(sets, *columns).agg(
        *[F.grouping(c).alias(f"_g_{c}") for c in by], F.count(F.lit(1)).alias("n_queries"),
        *[F.round(F.avg(m), digits).alias(m) for m in metrics])
    pick = lambda make: reduce(lambda rest, c: F.when(F.col(f"_g_{c}") == 0, make(c)).otherwise(rest), by, F.lit("all"))
    return grouped.select(pick(F.lit).alias("dimension"), pick(F.col).alias("value"), "n_queries", *metrics)


def failures(per_query: DataFrame, n: int = 8, max_chars: int = 90) -> DataFrame:
    """First ``n`` queries (by id) whose gold is not among the first five."""
    return (per_query.where(F.col("recall_at_5") == 0).orderBy("qid").limit(n)
            .select("qid", "source", "intent", F.substring("query", 1, max_chars).alias("query")))
