"""Ordered work inside a key without pulling the key into one task.

A window partitioned by a key alone sends a key that holds a third of all rows to one task.  These helpers cut every key into
segments of about equally many rows, run the window per (key, segment), and pass what crosses a border through one small row
per segment.

Borders come from the data: of ``rows`` distinct places in the order, the hash of one is a border, the same ones whenever the
plan runs again.  A busy day is cut like a quiet year; only rows that agree in every order column stay together.  Rows meet
the borders of their key in parts dealt by a hash of their place, where a running maximum numbers them.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The key columns as one value, which holds null keys too, and the number of the segment.
KEY, SEGMENT = "_key", "_segment"


def with_segment(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """``df`` with ``_key`` and ``_segment``: segments ascend with ``order`` and hold about ``rows`` rows each."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(*[F.col(f"`{c}`") for c in order])
    placed = df.select(F.struct(*[F.col(f"`{c}`") for c in keys]).alias(KEY), place.alias("_place"),
                       F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"))
    borders = placed.where(F.pmod(F.xxhash64(KEY, "_place"), F.lit(rows)) == 0).select(KEY, "_place").distinct()
    numbered = borders.withColumn("_border", F.row_number().over(Window.partitionBy(KEY).orderBy("_place")))
    # Every part of a key needs all its borders; keys without borders have none to send.
    marks = numbered.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = placed.withColumn("_part", F.pmod(F.hash("_place"), F.lit(parts)))
    before = Window.partitionBy(KEY, "_part").orderBy("_place", F.col("_border").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, 0)
    met = dealt.unionByName(marks, allowMissingColumns=True).withColumn(SEGMENT, F.coalesce(F.max("_border").over(before), F.lit(0)))
    return met.where(F.col("_border").isNull()).select("_all.*", KEY, SEGMENT)


def ordinal(df: DataFrame, keys: list[str], order: list[str], rows: int, name: str = "ordinal",
            keep_segment: bool = False) -> DataFrame:
    """Zero-based position of each row within ``keys`` by ``order``."""
    cut = with_segment(df, keys, order, rows)
    counts = cut.groupBy(KEY, SEGMENT).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(KEY).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(KEY, SEGMENT, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(KEY, SEGMENT).orderBy(*order)) - 1
    return (cut.withColumn("_local", local).join(offsets, [KEY, SEGMENT])
            .withColumn(name, F.col("_offset") + F.col("_local"))
            .drop("_local", "_offset", *([] if keep_segment else [KEY, SEGMENT])))


def previous(df: DataFrame, keys: list[str], order: list[str], value: Column, rows: int,
             name: str = "previous") -> DataFrame:
    """``lag(value)`` within ``keys`` by ``order``.  The last value of each segment is carried to the next one."""
    cut = with_segment(df.withColumn("_value", value), keys, order, rows)
    last = cut.groupBy(KEY, SEGMENT).agg(
        F.max(F.struct(*[F.col(c) for c in order], F.col("_value")))["_value"].alias("_last"))
    carry = last.select(KEY, SEGMENT, F.lag("_last").over(Window.partitionBy(KEY).orderBy(SEGMENT)).alias("_carry"))
    in_segment = Window.partitionBy(KEY, SEGMENT).orderBy(*order)
    first = F.row_number().over(in_segment) == 1
    return (cut.withColumn("_first", first).withColumn("_lag", F.lag("_value").over(in_segment))
            .join(carry, [KEY, SEGMENT])
            .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
            .drop(KEY, SEGMENT, "_value", "_first", "_lag", "_carry"))


def trailing_rows(df: DataFrame, keys: list[str], order: list[str], row: Column, n: int, rows: int,
                  name: str = "trailing") -> DataFrame:
    """Array of the ``n`` rows before each row (oldest first) within ``keys`` by ``order``.

    Every segment but the first holds its border, so the last ``n`` earlier rows lie in the last ``n`` earlier segments:
    their tails are the carry.
    """
    cut = with_segment(df.withColumn("_row", row), keys, order, rows)
    newest = Window.partitionBy(KEY, SEGMENT).orderBy(*[F.col(c).desc() for c in order])
    tails = (cut.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= n)
             .groupBy(KEY, SEGMENT)
             .agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("_back", "_row")))),
                              lambda s: s["_row"]).alias("_tail")))
    earlier = Window.partitionBy(KEY).orderBy(SEGMENT).rowsBetween(-n, -1)
    carry = tails.select(KEY, SEGMENT, F.flatten(F.collect_list("_tail").over(earlier)).alias("_carry"))
    local = F.collect_list("_row").over(Window.partitionBy(KEY, SEGMENT).orderBy(*order).rowsBetween(-n, -1))
    both = F.concat("_carry", "_local")
    return (cut.withColumn("_local", local).join(carry, [KEY, SEGMENT])
            .withColumn(name, F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), F.lit(n)))
            .drop(KEY, SEGMENT, "_row", "_local", "_carry"))
