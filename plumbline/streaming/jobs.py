"""Structured Streaming jobs.  Aggregating ones take a batch or a streaming DataFrame alike."""
import bisect
import hashlib
import uuid
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.functions.text import normalize_nfkd
from plumbline.operators import chunking, models, sparse
from plumbline.schemas import CHAT_SESSION, CHUNK, CHUNK_COLUMNS, FILE
from plumbline.session import remove_folder, shared_folder, spread
from plumbline.sources import store
from plumbline.sources.merge_table import MergeTable
from plumbline.streaming import statistics as changes

# Progress of ingestion stages, life of a cached answer, request limit.
STAGE_PROGRESS = {"parsing": 5, "captioning": 25, "preparing": 40, "embedding": 45, "storing": 80, "indexing": 90,
                  "indexed": 100}
EMBEDDING_SPAN, EMBEDDING_END = 25, 70
ANSWER_TTL_MS = 30 * 60 * 1000
RATE_WINDOW, RATE_LIMIT = "60 seconds", 100
BUCKETS = 64
ROW_GROUP_BYTES = 8 << 20  # of folders that a batch writes for itself: a file is read by several tasks


# ---- ingestion -----------------------------------------------------------------------------------------------------

GROUP = ["org_id", "modality"]
PLACE = GROUP + ["bucket"]
INGEST_CHUNK = T.StructType([f for f in CHUNK.fields if f.name in CHUNK_COLUMNS]
                            + [T.StructField("bucket", T.IntegerType())])
INGEST_VECTOR = T.StructType([T.StructField(c, T.StringType()) for c in ("chunk_id", "file_id")]
                             + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
                             + [T.StructField(c, T.StringType()) for c in GROUP]
                             + [T.StructField("bucket", T.IntegerType())])


KEYS = [*GROUP, "chunk_id"]


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def _only(table: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the places named.  These are one row per stored folder, and a place may hold any number of rows: the places are
    broadcast, as a join by place would bring each place to one task."""
    return table.join(F.broadcast(places), keys, "left_semi")


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*PLACE).parquet(path)  # makes the folder
    return spark.read.schema(schema).parquet(path)


def ingest_batch(documents: DataFrame, path: str, load=None, dim: int = 1024, buckets: int = BUCKETS,
                 arrival: str | None = None, describe=None, statistics: str = "whole", batch: str | None = None, nfkd: bool = False) -> None:
    """Chunk, embed and upsert one batch of ``doc_id, section_id, text, org_id, file_id``; refresh BM25 statistics and
    the status of its files.

    Sections with ``tables`` and ``images`` (as :func:`plumbline.sources.readers.read_corpus` gives them) are chunked
    in all modalities.  A section that comes twice in a batch counts once: the last by the column ``arrival``, or
    without one the greatest text.  Tables are split by tenant, modality and a bucket of the document, and only the
    touched parts are rewritten, so one busy tenant is not rewritten whole.  Upserts go by tenant and chunk id: a batch that
    runs again changes nothing, and tenants may use the same document and file ids.

    ``nfkd`` brings texts to that Unicode form first, as is done with pages of parsed documents.
    ``statistics``: ``whole`` recounts the touched tenants and modalities into ``corpus_stats`` and ``term_stats``; ``changes`` appends
    what the batch changes (:mod:`plumbline.streaming.statistics`), under the name ``batch``: a batch that may run again must
    bring one.
    """
    if statistics not in ("whole", "changes"):
        raise ValueError(f"statistics: {statistics}")
    spark = documents.sparkSession
    documents = documents.withColumn("text", normalize_nfkd(F.col("text"))) if nfkd else documents
    arrived = shared_folder(spark, "arrived")
    last = store.latest(documents, ["org_id", "doc_id", "section_id"], F.col(arrival or "text"))
    (last.drop(arrival) if arrival else last).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(arrived)
    documents = spread(spark.read.parquet(arrived))
    whole_sections = {"tables", "images", "caption"} <= set(documents.columns)
    chunks = chunking.chunk_corpus(documents, describe) if whole_sections else chunking.chunk_text(documents)
    fresh = chunks.withColumn("bucket", _bucket(buckets))
    staged = shared_folder(spark, "ingest")
    fresh.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(staged)
    fresh = spread(spark.read.schema(fresh.schema).parquet(staged))
    touched = fresh.select(*PLACE).distinct()

    def merge(name, schema, rows, rule):
        table = _only(_stored(spark, f"{path}/{name}", schema), touched, PLACE).select(*schema.names)
        store.replace_partitions(rule(table, rows.select(*schema.names), KEYS), f"{path}/{name}", PLACE)

    _register_files(documents, path)

    merge("chunks", INGEST_CHUNK, fresh, lambda old, new, keys: store.store_chunks(old, new, keys, stored=True))
    vectors = models.embed_job(fresh.select("chunk_id", "file_id", "content", *PLACE), load, dim)
    merge("vectors", INGEST_VECTOR, vectors, store.store_embeddings)
    changed = _only(spark.read.schema(INGEST_CHUNK).parquet(f"{path}/chunks"), touched, PLACE)
    counted = shared_folder(spark, "counted")
    if statistics == "whole":
        forward = sparse.forward_index(changed, keep=("bucket",))
        store.replace_partitions(forward, f"{path}/forward", PLACE)
        _renew_statistics(spark, path, forward.schema, touched)
    else:  # only what came is counted
        sparse.forward_index(changed.join(fresh.select(*KEYS), KEYS, "left_semi"), keep=("bucket",)).write.parquet(counted)
        new = spark.read.parquet(counted)
        new = spark.read.schema(_as_text(new.schema)).parquet(counted)
        old = _only(_stored(spark, f"{path}/forward", new.schema), touched, PLACE).select(*new.columns)
        changes.record(spark, path, batch or uuid.uuid4().hex, new, old.join(new.select(*KEYS), KEYS, "left_semi"))
        store.replace_partitions(old.join(new.select(*KEYS), KEYS, "left_anti").unionByName(new), f"{path}/forward", PLACE)
    _finish_files(documents, path)
    for folder in (staged, arrived, counted):
        remove_folder(spark, folder)


def _renew_statistics(spark: SparkSession, path: str, forward_schema: T.StructType, touched: DataFrame) -> None:
    """Statistics of the touched (tenant, modality) groups from the stored forward index; empty groups vanish."""
    groups = touched.select(*GROUP).distinct()
    whole = _only(spark.read.schema(forward_schema).parquet(f"{path}/forward"), groups, GROUP)
    stats = sparse.corpus_stats(whole)
    terms = sparse.term_stats(whole, stats)
    store.replace_partitions(stats, f"{path}/corpus_stats", GROUP, groups)
    store.replace_partitions(terms, f"{path}/term_stats", GROUP, groups)


INGEST_FILE = T.StructType([f for f in FILE.fields if f.name in ("file_id", "status", "chunk_count", "error")]
                           + [T.StructField("org_id", T.StringType())])


def _files(spark: SparkSession, path: str) -> DataFrame:
    spark.createDataFrame([], INGEST_FILE).write.mode("append").partitionBy("org_id").parquet(f"{path}/files")
    return spark.read.schema(INGEST_FILE).parquet(f"{path}/files")


def _register_files(documents: DataFrame, path: str) -> None:
    """Files of the batch as ``processing``; those stored before keep their other columns."""
    rows = documents.select("file_id", "org_id").distinct()
    tenants = rows.select("org_id").distinct()
    known = _only(_files(documents.sparkSession, path), tenants, ["org_id"]).select(*INGEST_FILE.names)
    store.replace_partitions(store.store_files(known, rows, ("org_id", "file_id")), f"{path}/files", ["org_id"])


def _finish_files(documents: DataFrame, path: str) -> None:
    """Final status and chunk count of the batch's files; a file without chunks is an error."""
    spark = documents.sparkSession
    files = documents.select("file_id", "org_id").distinct()
    chunks = spark.read.schema(INGEST_CHUNK).parquet(f"{path}/chunks").join(files, ["org_id", "file_id"], "left_semi")
    counted = files.join(store.file_chunk_counts(chunks), ["org_id", "file_id"], "left")
    results = counted.select("org_id", "file_id", "chunk_count",
                             F.when(F.col("chunk_count").isNull(), "error").otherwise("indexed").alias("status"),
                             F.when(F.col("chunk_count").isNull(), "No chunks extracted").alias("error"))
    known = _only(_files(spark, path), files.select("org_id").distinct(), ["org_id"]).select(*INGEST_FILE.names)
    done = store.update_file_status(known, results, F.lit(None).cast("timestamp"))
    store.replace_partitions(done.select(*INGEST_FILE.names), f"{path}/files", ["org_id"])


def delete_stored_files(spark: SparkSession, path: str, doomed: DataFrame, statistics: str = "whole", batch: str | None = None) -> None:
    """Remove files (``org_id, file_id``) from an index that :func:`ingest_batch` wrote: chunks, vectors, forward rows
    and file rows go, statistics are renewed (as there), and partitions and groups that held nothing else vanish."""
    pair = ["org_id", "file_id"]
    doomed = doomed.select(*pair).distinct()
    chunks = spark.read.schema(INGEST_CHUNK).parquet(f"{path}/chunks")
    kept_in = shared_folder(spark, "touched")
    chunks.join(doomed, pair, "left_semi").select(*PLACE).distinct().write.parquet(kept_in)
    touched = spark.read.schema(T.StructType([INGEST_CHUNK[c] for c in PLACE])).parquet(kept_in)
    forward_schema = read_placed(spark, f"{path}/forward").schema
    if statistics == "changes":
        gone = _only(spark.read.schema(forward_schema).parquet(f"{path}/forward"), touched, PLACE).join(doomed, pair, "left_semi")
        changes.record(spark, path, batch or uuid.uuid4().hex, gone.limit(0), gone)
    for name, schema in (("chunks", INGEST_CHUNK), ("vectors", INGEST_VECTOR), ("forward", forward_schema)):
        table = _only(spark.read.schema(schema).parquet(f"{path}/{name}"), touched, PLACE).select(*schema.names)
        store.replace_partitions(table.join(doomed, pair, "left_anti").select(*schema.names), f"{path}/{name}", PLACE, touched)
    if statistics == "whole":
        _renew_statistics(spark, path, forward_schema, touched)
    tenants = doomed.select("org_id").distinct()
    files = _only(_files(spark, path), tenants, ["org_id"]).select(*INGEST_FILE.names)
    store.replace_partitions(files.join(doomed, pair, "left_anti").select(*INGEST_FILE.names), f"{path}/files", ["org_id"], tenants)
    remove_folder(spark, kept_in)


def _as_text(schema: T.StructType) -> T.StructType:
    kinds = {"org_id": T.StringType(), "modality": T.StringType(), "bucket": T.IntegerType()}
    return T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in schema])


def read_placed(spark: SparkSession, path: str) -> DataFrame:
    """A table of the ingested index with tenant and modality as text, whatever they look like."""
    return spark.read.schema(_as_text(spark.read.parquet(path).schema)).parquet(path)


def stream_ingest(documents: DataFrame, path: str, checkpoint: str, load=None, dim: int = 1024,
                  buckets: int = BUCKETS, arrival: str | None = None, statistics: str = "changes", **trigger) -> StreamingQuery:
    """Run :func:`ingest_batch` on every micro-batch of a stream of documents.  Its changes of statistics are named by the
    stream and the batch's number, so that a batch that runs again after a failure counts once."""
    named = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    return (documents.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(lambda batch, number: ingest_batch(
                batch, path, load, dim, buckets, arrival, statistics=statistics, batch=f"{named}-{number}")).start())


# ---- status --------------------------------------------------------------------------------------------------------

def embedding_progress(batch_no: Column, n_batches: Column) -> Column:
    """Progress while embedding batch ``batch_no`` (from 0) of ``n_batches``."""
    done = ((batch_no + 1) / n_batches * EMBEDDING_SPAN).cast("int")
    return F.least(F.lit(STAGE_PROGRESS["embedding"]) + done, F.lit(EMBEDDING_END))


def latest_status(status_events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Last ``stage, progress`` per file by ``order``; update mode on a stream."""
    place = F.struct(*[F.col(c) for c in order or ["ts"]])
    last = F.max_by(F.struct("stage", "progress", "ts"), place)
    return status_events.groupBy("file_id").agg(last.alias("_s")).select(
        "file_id", F.col("_s.stage").alias("stage"), F.col("_s.progress").alias("progress"),
        F.col("_s.ts").alias("ts"))


def effective_status(active: DataFrame, stored: DataFrame) -> DataFrame:
    """Status per file: a running ingestion's stage wins over the stored status."""
    return (stored.select("file_id", F.col("status").alias("_stored"))
            .join(active.select("file_id", "stage", "progress"), "file_id", "full_outer")
            .select("file_id", F.coalesce("stage", "_stored").alias("status"), "progress"))


# ---- cached answers ------------------------------------------------------------------------------------------------

def _chain(times: np.ndarray, start: int, ttl: int) -> Iterator[int]:
    """Positions answered afresh when the one at ``start`` is."""
    while start < len(times):
        yield start
        start = int(np.searchsorted(times, times[start] + ttl, side="right"))


def dedup_queries_ttl_batch(requests: DataFrame, keys: list[str], ts: str = "ts", ttl_ms: int = ANSWER_TTL_MS,
                            segments: int = 8) -> DataFrame:
    """Requests that need an answer: ``keys, answered_ms``.  An answer serves its key for ``ttl_ms`` from when it was
    stored, and repeated requests do not prolong it.

    Which request is answered depends on the one before, all through a key's history.  To keep a busy key out of a
    single task its distinct milliseconds are cut into segments of ``segments`` lives, one row each: every segment
    maps "answer still valid until x" to its last answer, for the few x an earlier segment can leave; per key these
    maps, not the requests, are followed in order, one batch in memory at a time; then each segment marks its own
    answers.  A row holds at most one segment's milliseconds.
    """
    length = ttl_ms * segments
    ms = F.unix_millis(F.col(ts).cast("timestamp")).alias("ms")
    times = (requests.select(*keys, ms).distinct()
             .groupBy(*keys, F.floor(F.col("ms") / length).cast("long").alias("seg"))
             .agg(F.sort_array(F.collect_list("ms")).alias("times")))
    key_fields = [times.schema[k] for k in keys]
    longs = T.ArrayType(T.LongType())
    schema = lambda *fields: T.StructType(key_fields + [T.StructField(n, t) for n, t in fields])

    def exits(t, seg):
        following = np.searchsorted(t, t + ttl_ms, side="right")
        last = np.arange(len(t))
        for i in range(len(t) - 1, -1, -1):
            if following[i] < len(t):
                last[i] = last[following[i]]
        end = min(int(np.searchsorted(t, seg * length + ttl_ms, side="right")) + 1, len(t))
        run_end = np.append(last[1:end] != last[:end - 1], True)
        return t[:end][run_end], t[last[:end]][run_end]

    def map_segments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            pairs = [exits(t, seg) for t, seg in zip(part["times"], part["seg"])]
            yield part[[*keys, "seg"]].assign(entries=[p[0] for p in pairs], exits=[p[1] for p in pairs])

    def follow(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, valid = None, 0
        for part in parts:
            valids = []
            for key, entries, ends in zip(zip(*[part[k] for k in keys]), part["entries"], part["exits"]):
                if key != current:
                    current, valid = key, np.iinfo(np.int64).min
                valids.append(valid)
                at = int(np.searchsorted(entries, valid, side="right"))
                if at < len(entries):
                    valid = int(ends[at]) + ttl_ms
            yield part[[*keys, "seg"]].assign(valid_ms=np.array(valids, dtype=np.int64))

    def mark(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answered = [t[list(_chain(t, int(np.searchsorted(t, valid, side="right")), ttl_ms))]
                        for t, valid in zip(part["times"], part["valid_ms"])]
            yield part[keys].assign(answered=answered)

    maps = times.mapInPandas(map_segments, schema(("seg", T.LongType()), ("entries", longs), ("exits", longs)))
    entered = (maps.repartition(*keys).sortWithinPartitions(*keys, "seg")
               .mapInPandas(follow, schema(("seg", T.LongType()), ("valid_ms", T.LongType()))))
    marked = times.join(entered, [*keys, "seg"]).mapInPandas(mark, schema(("answered", longs)))
    return marked.select(*keys, F.explode("answered").alias("answered_ms"))


#: Keys of a stream meet in buckets, so that a bucket and not a key is a call of Python.  Whole numbers beside nulls would come there as
#: floats: they go without nulls, and one more column says where these were.
KEY_ID, KEY_BUCKET, KEY_NULLS = "request_key", "request_bucket", "request_nulls"  # Spark renames what begins with _
HELD = "ids array<string>, stored_ms array<long>"


def key_id(df: DataFrame, keys: list[str]) -> Column:
    """One text per key: lengths and values, ``-`` for null."""
    def text(name):
        kind, column = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.BinaryType):
            return F.hex(column)
        return F.to_json(F.struct(column)) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else column.cast("string")
    whole = lambda value: F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.concat(*[whole(text(k)) for k in keys])


def timed_by_bucket(requests: DataFrame, keys: list[str], ts: str, delay: str, buckets: int) -> DataFrame:
    """``keys, ms`` with the watermark, the key's text, which of its columns are null, and the bucket it meets others in."""
    nulls = F.concat(*[F.col(k).isNull().cast("int").cast("string") for k in keys])
    filled = [F.coalesce(k, F.lit(0).cast(requests.schema[k].dataType)).alias(k) if isinstance(requests.schema[k].dataType, T.IntegralType)
              else F.col(k) for k in keys]
    return requests.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias(KEY_BUCKET), *filled, nulls.alias(KEY_NULLS), "_ts",
        F.unix_millis("_ts").alias("ms"), key_id(requests, keys).alias(KEY_ID))


def answers_of(watered: DataFrame, keys: list[str]) -> T.StructType:
    """What :func:`once_per_life` gives for the rows of :func:`timed_by_bucket`."""
    return T.StructType([*(watered.schema[k] for k in (*keys, KEY_NULLS)), T.StructField("answered_ms", T.LongType())])


def with_nulls(answers: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, answered_ms`` with the nulls that keys had."""
    return answers.select(*[F.when(F.substring(KEY_NULLS, i + 1, 1) == "0", F.col(k)).alias(k) for i, k in enumerate(keys)], "answered_ms")


def once_per_life(parts: Iterator[pd.DataFrame], held: tuple, keys: list[str], ttl_ms: int, watermark: int) -> tuple[pd.DataFrame | None, tuple]:
    """Answers (:func:`answers_of`) to the requests of a bucket, given the texts and times its keys hold, and what they hold after
    it: times whose life ends under the watermark are no longer held."""
    parts = [part for part in parts if len(part)]
    held_ids, held_ms = [list(of) for of in held]
    answers, last = None, dict(zip(held_ids, held_ms))
    if parts:
        rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        code, names = pd.factorize(rows[KEY_ID])
        order = np.lexsort((rows["ms"].to_numpy(), code))
        times, answered = rows["ms"].to_numpy()[order].tolist(), []
        ends = np.cumsum(np.bincount(code)).tolist()
        for name, at, end in zip(names, [0, *ends], ends):
            if name in last:
                at = bisect.bisect_right(times, last[name] + ttl_ms, at, end)
            while at < end:
                answered.append(at)
                last[name] = times[at]
                at = bisect.bisect_right(times, times[at] + ttl_ms, at + 1, end)
        if answered:
            at = order[answered]
            answers = rows[[*keys, KEY_NULLS]].iloc[at].assign(answered_ms=rows["ms"].to_numpy()[at])
    kept = {name: ms for name, ms in last.items() if watermark <= 0 or ms + ttl_ms >= watermark}
    return answers, (list(kept), list(kept.values()))


def dedup_queries_ttl(requests: DataFrame, keys: list[str], ts: str = "ts", ttl_ms: int = ANSWER_TTL_MS,
                      delay: str = "10 minutes", buckets: int = 256) -> DataFrame:
    """The same rule on a stream.  The state of a bucket of keys is the times of their stored answers; a time is dropped when the
    watermark passes the end of its life.  ``buckets`` must stay as it is for the life of a checkpoint; the requests of a bucket in
    one micro-batch, and its live keys, are held in memory together."""
    watered = timed_by_bucket(requests, keys, ts, delay, buckets)

    def serve(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        answers, held = once_per_life(() if state.hasTimedOut else parts, state.get if state.exists else ((), ()), keys, ttl_ms, watermark)
        if answers is not None:
            yield answers
        if held[0]:
            state.update(held)
            state.setTimeoutTimestamp(max(min(held[1]) + ttl_ms + 1, watermark + 1))
        elif state.exists:
            state.remove()

    answers = watered.groupBy(KEY_BUCKET).applyInPandasWithState(serve, answers_of(watered, keys), HELD, "append", GroupStateTimeout.EventTimeTimeout)
    return with_nulls(answers, keys)


# ---- limits, tokens, messages --------------------------------------------------------------------------------------

def rate_limit_flags(requests: DataFrame, client: str, ts: str = "ts", window: str = RATE_WINDOW,
                     limit: int = RATE_LIMIT, delay: str | None = None) -> DataFrame:
    """Requests per client and aligned window, and how many of them are over the limit."""
    if delay:
        requests = requests.withWatermark(ts, delay)
    return (requests.groupBy(client, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n_requests"))
            .select(client, F.col("w.start").alias("window_start"), "n_requests",
                    F.greatest(F.col("n_requests") - limit, F.lit(0)).alias("n_rejected")))


def assemble_answers(tokens: DataFrame, keys: list[str], order: str = "seq", token: str = "token") -> DataFrame:
    """Text of each answer from its numbered tokens; only answers whose ``done`` event has arrived."""
    pieces = F.array_sort(F.collect_list(F.when(~F.col("done"), F.struct(F.col(order), F.col(token)))))
    return (tokens.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p[token]), "").alias("answer"),
                                      F.max("done").alias("_done")).where("_done").drop("_done"))


def session_table(spark: SparkSession, path: str) -> MergeTable:
    """Conversations by tenant; a batch changes ``updated_at`` only."""
    return MergeTable(spark, path, CHAT_SESSION, ("org_id", "session_id"), ("updated_at",), ("org_id",))


def append_batch(messages: DataFrame, epoch: int, message_path: str, session_path: str, compact_every: int = 100) -> None:
    """Add one batch of messages and move their sessions' ``updated_at`` in the :func:`session_table` at ``session_path``.

    What is written are the batch's messages and one change row per session they belong to; the table takes its changes into
    its base every ``compact_every`` batches.  The batch number names the partition of messages and the change, both of which
    are overwritten, so a batch that runs again is not added twice.  Messages of unknown sessions make no session.
    """
    spark = messages.sparkSession
    (messages.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").partitionBy("epoch")
     .option("partitionOverwriteMode", "dynamic").parquet(message_path))
    schema = T.StructType([*messages.schema.fields, T.StructField("epoch", T.IntegerType())])
    added = spark.read.schema(schema).parquet(message_path).where(F.col("epoch") == epoch)
    table = session_table(spark, session_path)
    newest = added.groupBy("org_id", "session_id").agg(F.max("created_at").alias("_newest"))
    moved = table.read().join(newest, ["org_id", "session_id"]).withColumn("updated_at", F.greatest("updated_at", "_newest"))
    table.upsert(moved.drop("_newest"), epoch)
    if (epoch + 1) % compact_every == 0:
        table.compact()


def append_messages(messages: DataFrame, message_path: str, session_path: str, checkpoint: str,
                    **trigger) -> StreamingQuery:
    return (messages.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(lambda batch, epoch: append_batch(batch, epoch, message_path, session_path)).start())
