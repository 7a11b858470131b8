"""Streams over several batches against their batch twins: late rows, state that goes, changed rows by key."""
import pytest
from pyspark.sql import functions as F

from plumbline.streaming import jobs, state


class Feed:
    """Files of one schema that arrive one after the other; each is a batch of the stream."""

    def __init__(self, spark, folder, schema):
        self.spark, self.schema, self.folder = spark, schema, str(folder / "in")
        self.out, self.checkpoint, self.progress = str(folder / "out"), str(folder / "checkpoint"), None
        spark.createDataFrame([], schema).write.parquet(self.folder)

    def batch(self, rows, stream, mode="append", sink=None):
        if rows:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)
        made = stream(self.spark.readStream.schema(self.schema).parquet(self.folder))
        writer = made.writeStream.option("checkpointLocation", self.checkpoint).trigger(availableNow=True).outputMode(mode)
        with state.rocksdb_state(self.spark):
            query = (writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", self.out)).start()
        query.awaitTermination()
        self.progress = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]

    def rows(self, *columns):
        return sorted(tuple(r) for r in self.spark.read.parquet(self.out).select(*columns).collect())

    def held(self):
        return self.progress[-1]["numRowsTotal"]


def at(seconds):
    return f"2024-01-01 {seconds // 3600:02}:{seconds // 60 % 60:02}:{seconds % 60:02}"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_an_answer_serves_for_its_life_and_goes(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k string, at string")
    stream = lambda df: state.answered_once(df.withColumn("ts", F.to_timestamp("at")), ["k"], ttl_ms=60_000, delay="10 seconds")
    batches = [[("a", 0), ("a", 30), ("a", 61), ("b", 5)], [("a", 100), ("b", 64), ("b", 66), ("a", 122)], [("a", 130), ("c", 131)]]
    for rows in batches:
        feed.batch([(k, at(s)) for k, s in rows], stream)
    everything = spark.createDataFrame([(k, at(s)) for b in batches for k, s in b], "k string, at string").withColumn("ts", F.to_timestamp("at"))
    want = sorted(tuple(r) for r in jobs.dedup_queries_ttl_batch(everything, ["k"], ttl_ms=60_000).collect())
    assert feed.rows("k", "answered_ms") == want and len(want) == 6
    assert feed.held() > 1
    feed.batch([("late", at(3))], stream)  # under the watermark
    assert feed.rows("k", "answered_ms") == want
    feed.batch([("end", at(3600))], stream)
    assert feed.rows("k", "answered_ms")[-1][0] == "end" and len(feed.rows("k")) == 7
    alone = feed.held()
    feed.batch([("end", at(3601))], stream)
    assert feed.held() == alone <= 2  # one key's time and timer; all others are gone


@pytest.mark.parametrize("once", [jobs.dedup_queries_ttl, state.answered_once])
def test_state_goes_by_bucket_not_by_key(spark, tmp_path, once):
    """Keys with nulls beside whole numbers no double can hold come back as they are; a thousand keys are not a thousand states."""
    feed = Feed(spark, tmp_path, "k long, w string, at string")
    stream = lambda df: once(df.withColumn("ts", F.to_timestamp("at")), ["k", "w"], ttl_ms=60_000, delay="10 seconds")
    keys = [(2 ** 60 + i, f"w{i % 3}") for i in range(1000)] + [(None, "w"), (7, None), (None, None), (1, "1:1"), (11, ":1"), (7, "")]
    batches = [[(*k, at(s)) for k in keys for s in (0, 30, 61)], [(*k, at(s)) for k in keys[500:] for s in (100, 122, 122)]]
    for rows in batches:
        feed.batch(rows, stream)
        assert 0 < feed.held() < len(keys)
    whole = [r for b in batches for r in b if r[0] is not None and r[1] is not None]
    twin = jobs.dedup_queries_ttl_batch(spark.createDataFrame(whole, feed.schema).withColumn("ts", F.to_timestamp("at")), ["k", "w"], ttl_ms=60_000)
    want = sorted(tuple(r) for r in twin.collect())
    got = [tuple(r) for r in spark.read.parquet(feed.out).select("k", "w", "answered_ms").collect()]
    assert sorted(r for r in got if r[0] is not None and r[1] is not None) == want
    nulls = [(r[0] is None, r[1] is None) for r in got if r[0] is None or r[1] is None]
    assert sorted(nulls) == sorted(3 * [(True, False), (False, True), (True, True)])


def test_tokens_leave_with_their_answer(spark, tmp_path):
    schema = "k string, seq long, token string, done boolean, at string"
    feed = Feed(spark, tmp_path, schema)
    stream = lambda df: state.answers_as_they_end(df.withColumn("ts", F.to_timestamp("at")), ["k"], life_ms=60_000, delay="10 seconds")
    batches = [[("a", 1, "lo ", False), ("a", 0, "Hel", False), ("b", 0, "x", False), ("never", 0, "y", False)],
               [("a", 2, "you", False), ("b", -1, "", True), ("c", -1, "", True)], [("a", -1, "", True)]]
    timed = [[(*r, at(5 * n)) for r in rows] for n, rows in enumerate(batches)]
    for n, rows in enumerate(timed):
        feed.batch(rows, stream)
        assert len(feed.rows("k")) == (0, 2, 3)[n] and feed.held() > 0
    everything = spark.createDataFrame([r for b in timed for r in b], schema)
    want = sorted(tuple(r) for r in jobs.assemble_answers(everything, ["k"]).collect())
    assert feed.rows("k", "answer") == want == [("a", "Hello you"), ("b", "x"), ("c", "")]
    feed.batch([("end", -1, "", True, at(100))], stream)
    feed.batch([("more", -1, "", True, at(101))], stream)
    assert feed.held() == 0 and len(feed.rows("k")) == 5  # the answer without an end is gone as well


def test_latest_status_by_upsert(spark, tmp_path):
    schema = "file_id string, at string, event_id long, stage string"
    feed = Feed(spark, tmp_path, schema)
    stream = lambda df: state.latest_changes(df.withColumn("ts", F.to_timestamp("at")), ["file_id"], ["stage"], ties=("event_id",), delay="30 seconds", life="60 seconds")
    sink = state.upsert_sink(feed.out, ["file_id"], buckets=3)
    batches = [[("f", 0, 1, "parsing"), ("f", 20, 3, "embedding"), ("f", 20, 2, "captioning"), ("g", 1, 4, "parsing")],
               [("g", 10, 5, "indexed"), ("f", 15, 6, "preparing"), ("h", 40, 7, "parsing")], [("f", 60, 8, "indexed")]]
    for rows in batches:
        feed.batch([(f, at(s), e, x) for f, s, e, x in rows], stream, "update", sink)
    everything = spark.createDataFrame([(f, at(s), e, x, 0) for b in batches for f, s, e, x in b], schema + ", progress int")
    want = sorted(tuple(r) for r in jobs.latest_status(everything.withColumn("ts", F.to_timestamp("at")), ["ts", "event_id"]).select("file_id", "stage").collect())
    assert feed.rows("file_id", "stage") == want == [("f", "indexed"), ("g", "indexed"), ("h", "parsing")]
    feed.batch([("g", at(2), 9, "late")], stream, "update", sink)
    feed.batch([("z", at(5000), 10, "parsing")], stream, "update", sink)
    feed.batch([("z", at(5001), 11, "storing")], stream, "update", sink)
    assert feed.rows("file_id", "stage") == [*want, ("z", "storing")] and feed.held() <= 2
    with pytest.raises(ValueError, match="shorter"):
        state.latest_changes(spark.createDataFrame([], schema).withColumn("ts", F.to_timestamp("at")), ["file_id"], ["stage"], delay="2 hours", life="1 hour")


def test_rate_windows_leave_by_watermark(spark, tmp_path):
    schema = "client string, at string"
    feed = Feed(spark, tmp_path, schema)
    stream = lambda df: jobs.rate_limit_flags(df.withColumn("ts", F.to_timestamp("at")), "client", window="60 seconds", limit=2, delay="30 seconds")
    sink = state.upsert_sink(feed.out, ["client", "window_start"], buckets=3)
    batches = [[("a", 1), ("a", 2), ("a", 3), ("b", 59)], [("a", 50), ("a", 61), ("b", 70)], [("a", 75), ("b", 200)]]
    for rows in batches:
        feed.batch([(c, at(s)) for c, s in rows], stream, "update", sink)
    twin = jobs.rate_limit_flags(spark.createDataFrame([(c, at(s)) for b in batches for c, s in b], schema).withColumn("ts", F.to_timestamp("at")), "client", window="60 seconds", limit=2)
    columns = ("client", F.unix_seconds("window_start"), "n_requests", "n_rejected")
    want = sorted(tuple(r) for r in twin.select(*columns).collect())
    assert feed.rows(*columns) == want and max(r[3] for r in want) == 2
    feed.batch([("a", at(5)), ("b", at(201))], stream, "update", sink)  # the first is late: its window is closed
    after = feed.rows(*columns)
    assert [r for r in after if r[1] != want[-1][1]] == [r for r in want if r[1] != want[-1][1]] and len(after) == len(want)
    assert feed.held() == 1  # the open window
