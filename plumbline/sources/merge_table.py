"""Tables merged on read: a change writes what it changes, reading takes the newest.

An upsert or delete of a batch appends one folder of change rows under the batch's number; nothing stored is read or
rewritten.  Reading puts the changes over the base: keys without changes are passed through by an anti join against the
changed keys, which Spark broadcasts while they are few, so the base is not shuffled.  Compaction writes base and changes
as the base of the next generation.  A batch that runs again overwrites its own folder.  One writer at a time is assumed.
"""
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources import generations
from plumbline.sources.store import align_schema

SEQ, GONE = "_seq", "_gone"


@dataclass(frozen=True)
class MergeTable:
    """``keys`` name a row; an upsert of a known key sets the columns ``update`` only, the others stay as first inserted.

    ``partition`` columns lay out the base; they must not be among ``update``."""
    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    update: tuple[str, ...]
    partition: tuple[str, ...] = ()

    def _folder(self) -> str:
        return f"{self.path}/{generations.newest(self.spark, self.path, 'base')}"

    def _append(self, rows: DataFrame, seq: int) -> None:
        folder = self._folder()
        if seq < 0 or any(int(n.split("=")[1]) > seq for n in generations.names(self.spark, f"{folder}/changes")):
            raise ValueError(f"change {seq} comes after a later one")
        rows.hint("rebalance").write.mode("overwrite").parquet(f"{folder}/changes/{SEQ}={seq}")

    def upsert(self, rows: DataFrame, seq: int) -> None:
        """Change number ``seq``: ``rows`` hold a key once, or the batch fails."""
        rows = align_schema(rows, self.schema).select(*self.schema.names)
        n = F.count(F.lit(1))
        twice = F.when(n > 1, F.raise_error(F.concat(F.lit("key comes twice in one batch: "), F.to_json(F.struct(*self.keys)))).cast("boolean")).otherwise(F.lit(False))
        others = [c for c in self.schema.names if c not in self.keys]
        once = rows.groupBy(*self.keys).agg(F.first(F.struct(*others)).alias("_r"), twice.alias(GONE))
        self._append(once.select(*self.keys, *[F.col(f"_r.{c}").alias(c) for c in others], GONE).select(*self.schema.names, GONE), seq)

    def delete(self, doomed: DataFrame, seq: int) -> None:
        """Change number ``seq``: rows of the keys in ``doomed`` go."""
        gone = doomed.select(*self.keys).distinct().withColumns(
            {**{f.name: F.lit(None).cast(f.dataType) for f in self.schema if f.name not in self.keys}, GONE: F.lit(True)})
        self._append(gone.select(*self.schema.names, GONE), seq)

    def last(self) -> int:
        """Number of the last change of this generation, -1 without any."""
        return max((int(n.split("=")[1]) for n in generations.names(self.spark, f"{self._folder()}/changes")), default=-1)

    def _stored(self, folder: str, name: str, schema: T.StructType) -> DataFrame:
        if not generations.names(self.spark, folder).count(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{folder}/{name}")

    def read(self) -> DataFrame:
        """The table as of the last change."""
        folder = self._folder()
        base = self._stored(folder, "base", self.schema).select(*self.schema.names)
        log = self._stored(folder, "changes", T.StructType([*self.schema.fields, T.StructField(GONE, T.BooleanType()), T.StructField(SEQ, T.LongType())]))
        if not generations.names(self.spark, f"{folder}/changes"):
            return base
        keys, fixed = list(self.keys), [c for c in self.schema.names if c not in (*self.keys, *self.update)]
        ends = log.groupBy(*keys).agg(F.max(F.when(F.col(GONE), F.col(SEQ))).alias("_end"))  # its last delete
        alive = log.join(ends, keys).where(~F.col(GONE) & (F.col(SEQ) > F.coalesce("_end", F.lit(-1))))
        new = alive.groupBy(*keys).agg(
            F.min_by(F.struct(*[F.col(c) for c in fixed], F.lit(0).alias("_")), SEQ).alias("_first"),
            F.max_by(F.struct(*[F.col(c) for c in self.update], F.lit(0).alias("_")), SEQ).alias("_last"), F.first("_end").alias("_end"))
        untouched = base.join(ends.select(*keys), keys, "left_anti")
        kept = base.select(*keys, F.struct(*[F.col(c) for c in fixed], F.lit(0).alias("_")).alias("_old")).join(
            ends.select(*keys), keys, "left_semi")
        merged = new.join(kept, keys, "left")
        first = F.when(F.col("_end").isNull() & F.col("_old").isNotNull(), F.col("_old")).otherwise(F.col("_first"))
        merged = merged.withColumn("_first", first)
        changed = merged.select(*[F.col(f"_last.{c}").alias(c) if c in self.update else F.col(f"_first.{c}").alias(c) if c in fixed else F.col(c)
                                  for c in self.schema.names])
        return untouched.select(*self.schema.names).unionByName(changed)

    def compact(self, keep: int = 1) -> None:
        """Write the table as the base of the next generation, in even files by partition; all but ``keep`` older generations go."""
        now = generations.newest(self.spark, self.path, "base")
        rows = self.read()
        writer = rows.hint("rebalance", *self.partition).write.mode("overwrite")
        (writer.partitionBy(*self.partition) if self.partition else writer).parquet(f"{self.path}/{now + 1}/base")
        generations.drop_before(self.spark, self.path, now + 1 - keep)
