"""Big JSON objects keyed by id, read by many tasks.

A file holding one object of any size is cut at every comma by Spark's own text reader, which splits files by byte ranges.
Whether a comma ends a member of the object depends on all text before it: open quotes and brackets are added up inside each
split, for a split that begins outside and one that begins inside of a string, and then over the splits, of which a file has
few.  Members that cross the border of splits are put together by a shuffle on their number.  No task sees more than a split
and one member.
"""
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT = ["_file", "_block"]


def _depth(text: Column) -> Column:
    """Brackets opened less brackets closed."""
    return F.length(F.regexp_replace(text, r"[^\[{]+", "")) - F.length(F.regexp_replace(text, r"[^\]}]+", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text between commas, with its place and the sums of quotes and brackets before it in its split.

    ``_flip`` is 1 if an odd number of quotes comes before; ``_in0`` and ``_in1`` are the brackets for a split that begins
    outside and inside of a string.  A backslash never stands before a comma that ends a piece, so pairs are whole."""
    raw = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), "value")
    runs = F.split(F.regexp_replace("value", r"\\.", ""), '"')
    outside = lambda parity: _depth(F.array_join(F.filter("_runs", lambda r, i: i % 2 == parity), ""))
    counted = raw.withColumn("_runs", runs).select(
        *SPLIT, "_at", "value", (F.size("_runs") - 1).cast("long").alias("_quotes"), outside(0).alias("_d0"), outside(1).alias("_d1"))
    before = Window.partitionBy(*SPLIT).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    even = F.col("_flip") == 0
    turned = counted.withColumn("_flip", total("_quotes") % 2).select(
        *SPLIT, "_at", "value", "_quotes", "_flip", F.when(even, F.col("_d0")).otherwise(F.col("_d1")).alias("_s0"),
        F.when(even, F.col("_d1")).otherwise(F.col("_d0")).alias("_s1"))
    return turned.withColumns({"_in0": total("_s0"), "_in1": total("_s1")})


def _members(spark: SparkSession, path: str) -> DataFrame:
    """Pieces with ``_member``, the (split, number) of the member of the outermost value they belong to, and ``_after``,
    the brackets open behind them."""
    pieces = _pieces(spark, path)
    splits = Window.partitionBy("_file").orderBy("_block")
    earlier = splits.rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy(*SPLIT).agg(F.sum("_quotes").alias("_q"), F.sum("_s0").alias("_s0"), F.sum("_s1").alias("_s1"))
    opened = sums.withColumn("_odd", F.coalesce(F.sum("_q").over(earlier), F.lit(0)) % 2)
    opened = opened.withColumn("_open", F.coalesce(
        F.sum(F.when(F.col("_odd") == 0, F.col("_s0")).otherwise(F.col("_s1"))).over(earlier), F.lit(0)))
    placed = pieces.join(opened.select(*SPLIT, "_odd", "_open"), SPLIT, "left")
    # Splits of both branches are cut alike unless the session changed meanwhile; then fail rather than misread.
    outside = F.coalesce("_odd", F.raise_error(F.lit("splits of a JSON file changed while it was read")).cast("long")) == 0
    depth = F.col("_open") + F.when(outside, F.col("_in0")).otherwise(F.col("_in1"))
    starts = ((F.col("_flip") + F.col("_odd")) % 2 == 0) & (depth == 1)
    here = Window.partitionBy(*SPLIT).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.select(
        *SPLIT, "_at", "value", (depth + F.when(outside, F.col("_s0")).otherwise(F.col("_s1"))).alias("_after"),
        F.sum(starts.cast("long")).over(here).alias("_no"))
    ends = numbered.groupBy(*SPLIT).agg(F.max("_no").alias("_n"))
    last = F.last(F.when(F.col("_n") > 0, F.struct(F.col("_block").alias("block"), F.col("_n").alias("no"))), ignorenulls=True)
    carried = ends.select(*SPLIT, last.over(earlier).alias("_carry"))
    own = F.struct(F.col("_block").alias("block"), F.col("_no").alias("no"))
    return numbered.join(carried, SPLIT, "left").withColumn("_member", F.when(F.col("_no") > 0, own).otherwise(F.col("_carry")))


def read_keyed(spark: SparkSession, path: str, value: T.DataType) -> DataFrame:
    """Files of one JSON object each → ``qid, v``, a row per key; of a key that a file repeats the last value counts.

    An empty object gives no rows; a value that is not of the wanted type is null."""
    order = F.array_sort(F.collect_list(F.struct("_block", "_at", "value")))
    texts = _members(spark, path).groupBy("_file", "_member").agg(
        F.array_join(F.transform(order, lambda p: p["value"]), ",").alias("_text"), F.min("_after").alias("_after"))
    body = F.when(F.col("_member").isNull(), F.regexp_replace("_text", r"^\s*\{", "")).otherwise(F.col("_text"))
    body = F.when(F.col("_after") == 0, F.regexp_replace(body, r"\}\s*$", "")).otherwise(body)
    parsed = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), T.MapType(T.StringType(), value))
    return (texts.select("_file", "_member", F.explode(parsed).alias("qid", "v"))
            .groupBy("_file", "qid").agg(F.max_by(F.struct("v"), F.struct(F.col("_member").isNotNull(), "_member")).alias("_last"))
            .select("qid", "_last.v"))


def write_keyed(df: DataFrame, key: str, value: Column, path: str) -> None:
    """One JSON object keyed by ``key`` per task, as a text file; ``key`` holds no null and comes once."""
    member = F.regexp_extract(F.to_json(F.create_map(F.col(key).cast("string"), value)), r"(?s)^\{(.*)\}$", 1)

    def as_object(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "{"
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([lead + text])], ["value"])
                lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(["}" if lead == "," else "{}"])], ["value"])

    df.select(member.alias("value")).mapInArrow(as_object, "value string").write.text(path)
