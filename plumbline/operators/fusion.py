"""Reciprocal rank fusion and the rank helpers around it."""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.intent import table_query_weight
from plumbline.schemas import MODALITIES, MODALITY_WEIGHT, RRF_K

# RRF sums are compared at this precision, so that the order of adding lists cannot split a tie.
RRF_DIGITS = 12


def rank_within(df: DataFrame, keys: list[str], order: list[Column], top: int | None = None,
                name: str = "rnk") -> DataFrame:
    """One-based position within ``keys``; with ``top`` Spark cuts ranks before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= top) if top is not None else ranked


def ranked_lists(*lists: DataFrame, keys: list[str], weights: list[Column] | None = None) -> DataFrame:
    """Union of ranked lists with their number and weight; each has ``keys, chunk_id, rnk``."""
    weights = weights or [F.lit(1.0)] * len(lists)
    parts = [part.select(*keys, "chunk_id", "rnk", F.lit(i).alias("list_no"), weight.alias("weight"))
             for i, (part, weight) in enumerate(zip(lists, weights))]
    return reduce(DataFrame.unionByName, parts)


def rrf_fuse(lists: DataFrame, keys: list[str], k: int = RRF_K, top: int | None = None) -> DataFrame:
    """``sum(weight / (k + rnk))`` per id; equal sums keep first-seen order (list number, then rank)."""
    scored = lists.groupBy(*keys, "chunk_id").agg(
        F.round(F.sum(F.col("weight") / (F.lit(k) + F.col("rnk"))), RRF_DIGITS).alias("rrf_score"),
        F.min(F.struct("list_no", "rnk")).alias("first_seen"))
    return rank_within(scored, keys, [F.col("rrf_score").desc(), F.col("first_seen"), F.col("chunk_id")], top)


def modality_position(modality: Column) -> Column:
    cases = F
    for i, name in enumerate(MODALITIES):
        cases = cases.when(modality == name, i)
    return cases.otherwise(len(MODALITIES))


def modality_weight(modality: Column, query: Column) -> Column:
    """Cross-modal weight: fixed for text and image, the table weight of the query for tables."""
    cases = F.when(modality == "table", table_query_weight(query))
    for name, weight in MODALITY_WEIGHT.items():
        cases = cases.when(modality == name, F.lit(weight))
    return cases.otherwise(F.lit(1.0))


def cross_modal(per_modality: DataFrame, queries: DataFrame, k: int = RRF_K, top: int | None = None,
                fusion: str = "rrf", keys: list[str] | None = None) -> DataFrame:
    """Fuse the per-modality lists (``keys, modality, chunk_id, rnk``) of each query.

    ``fusion="concat"`` keeps the lists one after the other, text first, without weighing them.
    """
    keys = keys or ["qid"]
    placed = per_modality.withColumn("list_no", modality_position(F.col("modality")))
    if fusion == "concat":
        return rank_within(placed.withColumnRenamed("rnk", "_in_list"), keys,
                           [F.col("list_no"), F.col("_in_list")], top).drop("_in_list", "list_no")
    weighted = placed.join(queries.select("qid", "query"), "qid").withColumn(
        "weight", modality_weight(F.col("modality"), F.col("query")))
    return rrf_fuse(weighted, keys, k, top)


def ordered_union(*lists: DataFrame, keys: list[str]) -> DataFrame:
    """De-duplicated union; first occurrence wins and gives the order."""
    firsts = ranked_lists(*lists, keys=keys).groupBy(*keys, "chunk_id").agg(
        F.min(F.struct("list_no", "rnk")).alias("first_seen"))
    return rank_within(firsts, keys, [F.col("first_seen")]).select(*keys, "chunk_id", "rnk")


def attach_chunks(ranked: DataFrame, chunks: DataFrame, broadcast_ranked: bool = False) -> DataFrame:
    """Inner lookup: ids without a chunk row drop out.  ``broadcast_ranked`` is for callers that know a size bound of
    the ranked side; it keeps the chunk table from being shuffled."""
    left = F.broadcast(ranked) if broadcast_ranked else ranked
    return chunks.join(left, "chunk_id")
