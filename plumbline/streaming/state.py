"""Streams with state of their own, which leaves when it has served, and a sink that takes changed rows by key.

The processors run by ``transformWithState`` on the RocksDB state store: state lies on the executors' disks and in the
checkpoint, not in memory.  Events under the watermark are dropped by Spark; each processor says when a key's state goes.
"""
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.session import remove_folder, shared_folder
from plumbline.sources import store
from plumbline.streaming.jobs import ANSWER_TTL_MS, HELD, KEY_BUCKET, answers_of, once_per_life, timed_by_bucket, with_nulls

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which the processors below need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _frame(keys: list[str], key: tuple, **columns) -> pd.DataFrame:
    n = len(next(iter(columns.values())))
    return pd.DataFrame({**{k: pd.Series([v] * n, dtype=object if isinstance(v, str) else None) for k, v in zip(keys, key)}, **columns})


def _schema(df: DataFrame, keys: list[str], *others: T.StructField) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *others])


class _Keyed(StatefulProcessor):
    """What the processors share: the key's columns, and a timer that drops the key's state."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def drop_at(self, ms: int | None) -> None:
        """One timer at most: at ``ms``, or none."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if ms is not None:
            self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


class _OncePerLife(_Keyed):
    def __init__(self, keys: list[str], ttl_ms: int):
        super().__init__(keys)
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.stored = handle.getValueState("stored", HELD)

    def serve(self, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.stored.get() if self.stored.exists() else None
        answers, held = once_per_life(rows, before or ((), ()), self.keys, self.ttl_ms, timerValues.getCurrentWatermarkInMs())
        if held[0]:
            self.stored.update(held)
        elif before:
            self.stored.clear()
        self.drop_at(min(held[1]) + self.ttl_ms + 1 if held[0] else None)
        if answers is not None:
            yield answers

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self.serve(rows, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.serve(iter(()), timerValues)


def answered_once(requests: DataFrame, keys: list[str], ts: str = "ts", ttl_ms: int = ANSWER_TTL_MS, delay: str = "10 minutes",
                  buckets: int = 256) -> DataFrame:
    """Requests that need an answer, ``keys, answered_ms``, in append mode: an answer serves its key for ``ttl_ms`` from when it was stored.

    The state of a bucket of keys is those times; a timer drops them when the watermark passes the end of an answer's life.  A call of
    Python and its exchange of state are paid for by bucket, not by key.  ``buckets`` as for :func:`jobs.dedup_queries_ttl`.
    """
    watered = timed_by_bucket(requests, keys, ts, delay, buckets)
    answers = watered.groupBy(KEY_BUCKET).transformWithStateInPandas(_OncePerLife(keys, ttl_ms), answers_of(watered, keys), "append", "eventTime")
    return with_nulls(answers, keys)


class _Assembly(_Keyed):
    def __init__(self, keys: list[str], order: str, token: str, life_ms: int):
        super().__init__(keys)
        self.order, self.token, self.life_ms = order, token, life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pieces = handle.getListState("pieces", "seq long, token string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh, done, newest = [], False, 0
        for part in rows:
            newest = max(newest, int(part["ms"].max()))
            over = part["done"].to_numpy(dtype=bool)
            done = done or bool(over.any())
            fresh.extend(zip(part[self.order][~over].astype(int).tolist(), part[self.token][~over].tolist()))
        if not done:
            if fresh:
                self.pieces.appendList(fresh)
                self.drop_at(newest + self.life_ms)
            return
        held = [tuple(p) for p in self.pieces.get()] if self.pieces.exists() else []
        self.pieces.clear()
        self.drop_at(None)
        yield _frame(self.keys, key, answer=["".join(token for _, token in sorted(held + fresh))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.pieces.clear()
        return iter(())


def answers_as_they_end(tokens: DataFrame, keys: list[str], order: str = "seq", token: str = "token", ts: str = "ts",
                        life_ms: int = ANSWER_TTL_MS, delay: str = "10 minutes") -> DataFrame:
    """Text of each answer in the batch that brings its ``done`` event, in append mode; its tokens leave the state with it.

    Tokens of an answer that never ends go when the watermark is ``life_ms`` past the newest of them.  Tokens that come after
    ``done`` in a later batch are held like those of a new answer.
    """
    rows = tokens.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).select(
        *keys, order, token, "done", "_ts", F.unix_millis("_ts").alias("ms"))
    out = _schema(rows, keys, T.StructField("answer", T.StringType()))
    return rows.groupBy(*keys).transformWithStateInPandas(_Assembly(keys, order, token, life_ms), out, "append", "eventTime")


class _Latest(_Keyed):
    def __init__(self, keys: list[str], order: list[str], values: list[str], kinds: str, life_ms: int):
        super().__init__(keys)
        self.order, self.values, self.kinds, self.life_ms = order, values, kinds, life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", self.kinds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            row = part.sort_values(self.order).iloc[-1]
            place = tuple(int(row[c]) for c in self.order)
            if best is None or place > best[0]:
                best = place, {v: row[v] for v in self.values}
        if self.last.exists() and tuple(self.last.get()) >= best[0]:
            return
        self.last.update(best[0])
        self.drop_at(best[0][0] + self.life_ms)
        yield _frame(self.keys, key, **{c: [p] for c, p in zip(self.order, best[0])}, **{v: [x] for v, x in best[1].items()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())


def latest_changes(events: DataFrame, keys: list[str], values: list[str], ts: str = "ts", ties: tuple[str, ...] = (), delay: str = "10 minutes",
                   life: str = "1 hour") -> DataFrame:
    """The newest ``values`` per key whenever they change: ``keys, ms, ties, values``, for a sink that goes by key.

    Of events at one millisecond the greatest ``ties`` (whole numbers) counts.  An event older than the newest seen changes nothing; one
    under the watermark is dropped.  ``life`` after its newest event, in event time, a key's state goes: it must not be
    shorter than ``delay``, so that no event older than the state dropped can still come.
    """
    seconds = lambda text: events.sparkSession.range(1).select(F.expr(f"interval {text}").cast("interval day to second").cast("interval second")).first()[0].total_seconds()
    life_ms = int(1000 * seconds(life))
    if life_ms < 1000 * seconds(delay):
        raise ValueError("life is shorter than delay")
    order = ["ms", *ties]
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).select(
        *keys, "_ts", F.unix_millis("_ts").alias("ms"), *[F.col(t).cast("long").alias(t) for t in ties], *values)
    out = _schema(rows, keys, *(rows.schema[c] for c in (*order, *values)))
    kinds = ", ".join(f"{c} long" for c in order)
    return rows.groupBy(*keys).transformWithStateInPandas(_Latest(keys, order, values, kinds, life_ms), out, "update", "eventTime")


def upsert_sink(path: str, keys: list[str], buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows of a batch replace those of their keys in the table at ``path``; only buckets with changed keys are
    rewritten.  A batch that runs again changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark, staged = batch.sparkSession, shared_folder(batch.sparkSession, "changed")
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        rows.write.parquet(staged)
        rows = spark.read.schema(rows.schema).parquet(staged)
        spark.createDataFrame([], rows.schema).write.mode("append").partitionBy("bucket").parquet(path)  # makes the folder
        old = spark.read.schema(rows.schema).parquet(path).join(rows.select("bucket").distinct(), "bucket", "left_semi").select(*rows.columns)
        same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
        kept = old.alias("old").join(rows.alias("new"), same, "left_anti")
        if not rows.isEmpty():
            store.replace_partitions(kept.unionByName(rows), path, ["bucket"])
        remove_folder(spark, staged)

    return write
