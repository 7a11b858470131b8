"""Staging, loading and grouping helpers of the corpus operators."""
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from plumbline.session import remove_folder, shared_folder


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written inside :func:`scratch`, by application; None outside of it.
_held: dict[str, list[str]] = {}
_open: set[str] = set()


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: later jobs neither repeat the work nor depend on one executor."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    application = df.sparkSession.sparkContext.applicationId
    if application in _open:
        _held.setdefault(application, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that :func:`stage` wrote and nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove_folder(df.sparkSession, folder)


@contextmanager
def scratch(docs: DataFrame):
    """What is staged inside stays until the next scratch begins on documents that do not read from it.

    For steps whose result is written before the next step starts: its intermediate tables are of no more use then."""
    spark = docs.sparkSession
    application = spark.sparkContext.applicationId
    before = _held.get(application, [])
    read = "\n".join({f.rsplit("/", 1)[0] for f in docs.inputFiles()}) if before else ""
    _held[application] = [path for path in before if path.rsplit("/", 1)[1] in read]
    for path in before:
        if path not in _held[application]:
            remove_folder(spark, path)
    _open.add(application)
    try:
        yield
    finally:
        _open.discard(application)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The wanted columns under the operator's own names, whatever else the table holds."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def running_total(rows: DataFrame, order: list[str], total: str, group: str | None = None, weight: str | None = None) -> DataFrame:
    """``rows`` with ``total``: the weights (1 each) of all rows that come before it in ``order`` within its ``group``.

    ``rows`` must be written already, ``group`` and ``weight`` hold no null.  Rows are range-sorted, a task each sums up its
    range, and what came before the range is added by a join: a group of any size is spread over many ranges, as long as the
    last column of ``order`` tells equal rows apart.  A range holds at most about a million rows.
    """
    spark, n = rows.sparkSession, rows.count()
    ranges = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n >> 10), n >> 20)
    keys = [*([group] if group else []), *order]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            groups = batch.column(group).to_pylist() if group else [0] * batch.num_rows
            weights = batch.column(weight).to_pylist() if weight else [1] * batch.num_rows
            before = []
            for g, w in zip(groups, weights):
                if g != last:
                    last, at = g, 0
                before.append(at)
                at += w
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(before, pa.int64())],
                                             [*batch.schema.names, "_range", total])

    schema = StructType([*rows.schema.fields, StructField("_range", IntegerType()), StructField(total, LongType())])
    ranged = stage(rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).mapInArrow(add_up, schema), "ranges")
    own = [F.col(group) if group else F.lit(0).alias("_all")]
    sums = ranged.groupBy(*own, "_range").agg((F.sum(weight) if weight else F.count("*")).alias("_sum"))
    before = Window.partitionBy(group or "_all").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum", "_all")
    joined = ranged.join(sums, [group, "_range"] if group else ["_range"])
    return joined.withColumn(total, F.col(total) + F.col("_base")).drop("_base", "_range")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as ``a``, ``b``; the component is its smallest node.

    Rounds of large-star and small-star (Kiveris et al., 2014): each points nodes at the smallest neighbour, keeps
    connectivity and ends as stars after about log(n) rounds.  Every round is written to the shared folder, and the one
    before it removed.
    """
    spark = edges.sparkSession
    flat = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, mark = stage(flat, "edges"), None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        past, current = current, stage(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        discard(past)
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark or now[0] == 0:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def occurrences(text: Column, pattern: str) -> Column:
    """Number of characters matched by a character class."""
    return F.length(F.regexp_replace(text, f"[^{pattern}]+", ""))
