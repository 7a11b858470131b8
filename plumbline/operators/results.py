"""Results of model calls kept by content, so that a text is given to a model once.

A result is stored under the digest of model name and input.  A job asks the model only for inputs that have no stored result, each
distinct one once, in rounds: every round is a write of its own, and what a round has written is not asked again when a later one
fails, in this run or the next.
"""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import models
from plumbline.sources import generations

KEY = "_content"


def content_key(model: str, value: Column) -> Column:
    """Digest of model name and input, text or bytes; a null input has none."""
    return F.sha2(F.concat(F.lit(f"{len(model)}:{model}:").cast("binary"), value.cast("binary")), 256)


def stored_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Results of all whole rounds below ``path``; of a key that two runs asked at once, one."""
    rounds = [f"{path}/{name}" for name in generations.names(spark, path) if generations.whole(spark, f"{path}/{name}")]
    if not rounds:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*rounds)


def once(df: DataFrame, value: str, path: str, model: str, job: Callable[[DataFrame], DataFrame], round_rows: int = 1_000_000) -> DataFrame:
    """``df`` with the columns that ``job`` adds to a table of ``value``; the model behind it sees each distinct value once.

    ``job`` maps a DataFrame with ``value`` to the same rows with more columns.  Results lie below ``path``, which belongs to one
    kind of result; another ``model`` name asks anew.  A null value gets nulls.
    """
    spark = df.sparkSession
    sample = job(spark.createDataFrame([], T.StructType([T.StructField(KEY, T.StringType()), df.schema[value]])))
    added = [f for f in sample.schema.fields if f.name not in (KEY, value)]
    schema = T.StructType([T.StructField(KEY, T.StringType()), *added])
    keyed = df.withColumn(KEY, content_key(model, F.col(value)))
    wanted = keyed.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.first(value).alias(value))
    missing = wanted.join(stored_results(spark, path, schema).select(KEY), KEY, "left_anti")
    n = missing.count()
    rounds = -(-n // round_rows)
    done = len(generations.names(spark, path))
    for i in range(rounds):
        own = missing.where(F.pmod(F.xxhash64(KEY), F.lit(rounds)) == i)  # what earlier rounds wrote has other hashes
        job(own).select(*schema.names).write.parquet(f"{path}/{done + i:08}-{spark.sparkContext.applicationId}")
    results = stored_results(spark, path, schema).dropDuplicates([KEY])
    return keyed.join(results, KEY, "left").select(*df.columns, *[f.name for f in added])


def embed_once(df: DataFrame, path: str, model: str, load=None, dim: int = models.EMBED_DIM, text: str = "content",
               round_rows: int = 1_000_000) -> DataFrame:
    """:func:`plumbline.operators.models.embed_job` with stored results."""
    return once(df, text, path, f"{model}/{dim}", lambda rows: models.embed_job(rows, load, dim, text), round_rows)


def reply_once(df: DataFrame, path: str, model: str, load, source: str = "prompt", target: str = "answer", round_rows: int = 1_000_000) -> DataFrame:
    """Replies of a text model to ``source`` as ``target``, with stored results."""
    return once(df, source, path, model, lambda rows: models.text_job(rows, source, target, load), round_rows)
