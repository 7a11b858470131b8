"""Model calls as batch jobs around a user's callable.

Each job takes ``load``: a function without arguments that returns the callable, run once per task, so that a model is
loaded on the worker and never shipped.  Every job has a deterministic default that needs no model.
"""
import hashlib
import re
from itertools import chain
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.intent import apply_expansion, needs_expansion
from plumbline.functions.prompts import build_guard_prompt, parse_guard
from plumbline.functions.text import TOKEN, let, tokenize
from plumbline.operators.fusion import rank_within
from plumbline.schemas import EMBED_DIM

EMBED_BATCH, RERANK_BATCH, IMAGE_BATCH = 64, 16, 8
TextToVectors = Callable[[list[str]], np.ndarray]


def _extended(df: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType(df.schema.fields + list(fields))


def _strings(values: list, like: pd.DataFrame) -> pd.Series:
    return pd.Series(values, index=like.index, dtype=object)


def _batched(values: list, size: int) -> Iterator[list]:
    return (values[i:i + size] for i in range(0, len(values), size))


class _Buckets(dict):
    """md5 bucket of each token met; forgets all when it holds ``limit`` of them."""

    def __init__(self, dim: int, limit: int = 200_000):
        super().__init__()
        self.dim, self.limit = dim, limit

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[token] = bucket = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dim
        return bucket


def hashing_embedder(dim: int) -> Callable[[], TextToVectors]:
    """Default embedder: token counts in md5 buckets.  A token is hashed once for many calls, all of a call are counted at once."""
    def load():
        find, buckets = re.compile(TOKEN).findall, _Buckets(dim)

        def embed(texts):
            found = [find((text or "").lower()) for text in texts]
            sizes = [len(tokens) for tokens in found]
            own = np.fromiter(map(buckets.__getitem__, chain.from_iterable(found)), np.int64, sum(sizes))
            return np.bincount(np.repeat(np.arange(len(texts)) * dim, sizes) + own, minlength=len(texts) * dim).reshape(len(texts), dim)
        return embed
    return load


def embed_job(df: DataFrame, load: Callable[[], TextToVectors] | None = None, dim: int = EMBED_DIM,
              text: str = "content", batch: int = EMBED_BATCH, keep_text: bool = True) -> DataFrame:
    """Add ``embedding``: unit float vectors of the ``text`` column, which without ``keep_text`` does not come back."""
    load = load or hashing_embedder(dim)
    kept = [f for f in df.schema.fields if keep_text or f.name != text]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = load()
        for part in parts:
            if not part.num_rows:
                continue
            texts = part.column(text).to_pylist()
            raw = np.vstack([np.asarray(embed(some), dtype=np.float64) for some in _batched(texts, batch)])
            yield _with_unit_vectors(part, kept, raw)

    return df.mapInArrow(run, T.StructType([*kept, EMBEDDING]))


EMBEDDING = T.StructField("embedding", T.ArrayType(T.FloatType()))


def _with_unit_vectors(part: pa.RecordBatch, kept: list[T.StructField], raw: np.ndarray) -> pa.RecordBatch:
    raw = raw.astype(np.float64, copy=False)  # counts of empty texts come as whole numbers
    norms = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
    unit = np.divide(raw, norms, out=np.zeros_like(raw), where=norms > 0).astype(np.float32)
    offsets = pa.array(np.arange(len(unit) + 1, dtype=np.int32) * unit.shape[1])
    return pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))],
                                      [*(f.name for f in kept), "embedding"])


def embed_counts(forward: DataFrame, dim: int = EMBED_DIM, rows: int = 2_048) -> DataFrame:
    """The vectors that :func:`embed_job` gives by default, from term counts (``terms, tfs``) instead of texts: a text's tokens are
    cut once for its counts and its vector, and a term is put in its bucket once per batch.  Other columns stay."""
    kept = [f for f in forward.schema.fields if f.name not in ("terms", "tfs", "dl")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(dim)
        for whole in parts:
            for part in (whole.slice(lo, rows) for lo in range(0, whole.num_rows, rows)):
                terms = part.column("terms")
                flat = terms.flatten().dictionary_encode()
                lengths = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                own = np.fromiter(map(buckets.__getitem__, flat.dictionary.to_pylist()), np.int64, len(flat.dictionary))
                cells = np.repeat(np.arange(len(terms), dtype=np.int64) * dim, lengths) + own[flat.indices.to_numpy(zero_copy_only=False)]
                counts = part.column("tfs").flatten().to_numpy(zero_copy_only=False)
                raw = np.bincount(cells, weights=counts, minlength=len(terms) * dim).reshape(len(terms), dim)
                yield _with_unit_vectors(part, kept, raw)

    return forward.drop("dl").mapInArrow(run, T.StructType([*kept, EMBEDDING]))


def token_overlap(query: Column, content: Column) -> Column:
    """Default relevance: share of the query's distinct tokens that occur in the content."""
    def share(wanted):
        shared = F.size(F.array_intersect(wanted, tokenize(content)))
        return F.when(F.size(wanted) > 0, F.round(shared / F.size(wanted), 6)).otherwise(F.lit(0.0))
    return let(F.array_distinct(tokenize(query)), share)


def rerank_job(candidates: DataFrame, load: Callable[[], Callable[[list[str], list[str]], np.ndarray]] | None = None,
               batch: int = RERANK_BATCH) -> DataFrame:
    """Add ``rerank_score`` for each ``(query, content)`` row.  The default stays in the JVM."""
    if load is None:
        return candidates.withColumn("rerank_score", token_overlap(F.col("query"), F.col("content")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for part in parts:
            pairs = list(zip(part["query"], part["content"]))
            scores = [np.asarray(score([q for q, _ in some], [c for _, c in some]), dtype=np.float64)
                      for some in _batched(pairs, batch)]
            yield part.assign(rerank_score=np.concatenate(scores) if scores else np.zeros(0))

    return candidates.mapInPandas(run, _extended(candidates, T.StructField("rerank_score", T.DoubleType())))


def rerank(candidates: DataFrame, top_n: int, load=None, provider: str = "model",
           keys: list[str] | None = None) -> DataFrame:
    """Best ``top_n`` of each query by rerank score, earlier rank first among equals, as ``rnk``; the rank before is
    kept as ``fused_rnk``.  ``provider="none"`` keeps the order given."""
    keys = keys or ["qid"]
    # Scoring is the costly part: spread it by query, which is also what ranking needs; how many tasks is for adaptive
    # execution to say.
    candidates = candidates.repartition(*keys)
    scored = (candidates.withColumn("rerank_score", F.lit(None).cast("double")) if provider == "none"
              else rerank_job(candidates, load)).withColumnRenamed("rnk", "fused_rnk")
    order = [F.col("fused_rnk")] if provider == "none" else [F.col("rerank_score").desc(), F.col("fused_rnk")]
    return rank_within(scored, keys, order, top_n)


def expand_job(queries: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]] | None = None,
               batch: int = EMBED_BATCH, enabled: bool = True) -> DataFrame:
    """Hypothetical passages, one per query that needs one: ``qid, passage``.  The default writes none."""
    eligible = queries.where(needs_expansion(F.col("query"), enabled)).select("qid", "query")
    if load is None:
        return eligible.select("qid", F.lit(None).cast("string").alias("passage"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        write = load()
        for part in parts:
            passages = [p for texts in _batched(list(part["query"]), batch) for p in write(texts)]
            yield part[["qid"]].assign(passage=_strings(passages, part))

    return eligible.mapInPandas(run, "qid string, passage string")


def with_expansion(queries: DataFrame, passages: DataFrame | None) -> DataFrame:
    """Add ``embed_query``: the query with its stored passage, or the query alone when there is none."""
    if passages is None:
        return queries.withColumn("embed_query", F.col("query"))
    return (queries.join(passages.select("qid", "passage"), "qid", "left")
            .withColumn("embed_query", apply_expansion(F.col("query"), F.col("passage"))).drop("passage"))


def text_job(df: DataFrame, source: str, target: str, load: Callable[[], Callable[[list[str]], list[str]]],
             batch: int = EMBED_BATCH, tolerant: bool = False) -> DataFrame:
    """Add the string column ``target``: the model's reply to each ``source`` text.  A failing model fails the job, or
    with ``tolerant`` its batch gives nulls."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = load()

        def reply(texts):
            try:
                return list(call(texts))
            except Exception:
                if not tolerant:
                    raise
                return [None] * len(texts)

        for part in parts:
            replies = [r for texts in _batched(list(part[source]), batch) for r in reply(texts)]
            yield part.assign(**{target: _strings(replies, part)})

    return df.mapInPandas(run, _extended(df, T.StructField(target, T.StringType())))


def generate_job(prompts: DataFrame, load=None) -> DataFrame:
    """Add ``answer``.  The default is extractive: the content of the first source."""
    if load is None:
        return prompts.withColumn("answer", F.coalesce(F.get("sources", F.lit(0))["content"], F.lit("")))
    if "messages" in prompts.columns:
        said = prompts.withColumn("_said", F.to_json("messages"))
        return text_job(said, "_said", "answer", load).drop("_said")
    return text_job(prompts, "prompt", "answer", load)


def generation_eval(answers: DataFrame, gold: DataFrame, n: int | None = 15) -> DataFrame:
    """Generated answers beside the gold ones, for the first ``n`` queries by id."""
    rows = answers.join(gold.select("qid", F.col("answer").alias("gold")), "qid", "left").select(
        "qid", "query", F.coalesce("gold", F.lit("")).alias("gold"), F.col("answer").alias("generated"))
    return rows.orderBy("qid").limit(n) if n else rows


def guard_job(answers: DataFrame, load=None) -> DataFrame:
    """Add ``guard``: struct of verified, score, claims.  ``answers``: ``answer, source_contents``.  Without a model
    every reply is unreadable, which lets answers pass with score 0.5."""
    asked = answers.withColumn("guard_prompt", build_guard_prompt(F.col("answer"), F.col("source_contents")))
    replied = (asked.withColumn("guard_reply", F.lit("")) if load is None
               else text_job(asked, "guard_prompt", "guard_reply", load, tolerant=True))
    verdict = parse_guard(F.coalesce("guard_reply", F.lit("")), F.col("answer"), F.col("source_contents"))
    return replied.withColumn("guard", verdict).drop("guard_prompt", "guard_reply")


def describe_images_job(images: DataFrame, load: Callable[[], Callable[[list[bytes]], list[tuple[str, str]]]] | None = None,
                        image: str = "image_data", batch: int = IMAGE_BATCH) -> DataFrame:
    """Add ``caption`` and ``ocr_text``.  The model takes ``batch`` images at once; images of a batch that fails are tried one
    by one, and a failing image gets empty texts.  The default describes nothing."""
    if load is None:
        return images.withColumns({"caption": F.lit(""), "ocr_text": F.lit("")})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        describe = load()

        def safe(images):
            try:
                return [(caption or "", ocr or "") for (caption, ocr), _ in zip(describe(images), images, strict=True)]
            except Exception:
                return [("", "")] if len(images) == 1 else [safe([data])[0] for data in images]

        for part in parts:
            described = [d for images in _batched(list(part[image]), batch) for d in safe(images)]
            yield part.assign(caption=_strings([d[0] for d in described], part),
                              ocr_text=_strings([d[1] for d in described], part))

    return images.mapInPandas(run, _extended(images, T.StructField("caption", T.StringType()),
                                             T.StructField("ocr_text", T.StringType())))
