"""Registered queries: stored tables, deletes, conversations, streaming jobs."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import chat
from plumbline.schemas import CHAT_SESSION, ORG
from plumbline.session import shared_folder
from plumbline.sources import merge_table, store
from plumbline.streaming import jobs, state
from plumbline.streaming import statistics as changes
from plumbline.workload import sql, tables
from plumbline.workload.registry import register

def _now():
    return F.timestamp_seconds(F.lit(1735689600))


LANG_TEXT = sql.text_chunks("lang")
BM25_LANG = sql.with_(sql.text_chunks("lang", "chunks"), sql.QUERIES, sql.bm25())


def _str(c):
    return F.col(c).cast("string")


# ---- chunks and vectors --------------------------------------------------------------------------------------------

@register("S5 P1", sql.with_(LANG_TEXT) + "SELECT chunk_id, modality, org_id, file_id FROM text_chunks WHERE org_id = 'de'")
def tenant_chunks(spark, d):
    return store.load_chunks(tables.text_chunks(spark, d, None), "de").select("chunk_id", "modality", "org_id", "file_id")


@register("S8 D1", sql.with_(LANG_TEXT) + """SELECT chunk_id, org_id, CASE WHEN l.doc_id IS NULL THEN content ELSE reverse(content) END
  AS content, CASE WHEN l.doc_id IS NULL THEN 'old' ELSE 'new' END AS origin FROM text_chunks t
  LEFT JOIN labels l ON l.doc_id::VARCHAR = t.doc_id
UNION ALL SELECT 'c' || conv_id || '_' || turn, 'chat', text, 'new' FROM conversations""")
def chunk_upsert(spark, d):
    """Judged documents come again with other content and another tenant (which must not change), turns come anew."""
    origin = lambda v: F.create_map(F.lit("origin"), F.lit(v))
    path = shared_folder(spark, "target")
    tables.text_chunks(spark, d, None).withColumn("metadata", origin("old")).write.parquet(path)
    target = spark.read.parquet(path)
    again = (target.join(tables.load(spark, d, "labels").select(_str("doc_id").alias("doc_id")), "doc_id", "left_semi")
             .withColumns({"content": F.reverse("content"), "org_id": F.lit("other"), "metadata": origin("new")}))
    turns = tables.load(spark, d, "conversations").select(
        F.concat(F.lit("c"), _str("conv_id"), F.lit("_"), _str("turn")).alias("chunk_id"), _str("conv_id").alias("doc_id"),
        F.lit(0).alias("section_id"), F.lit("text").alias("modality"), F.col("text").alias("content"),
        origin("new").alias("metadata"), F.lit("chat").alias("org_id"), _str("conv_id").alias("file_id"))
    return store.store_chunks(target, again.unionByName(turns)).select(
        "chunk_id", "org_id", "content", F.col("metadata")["origin"].alias("origin"))


@register("S9 D1", """SELECT vec_id::VARCHAR AS chunk_id, round((CASE WHEN label % 2 = 0 THEN embedding[64] ELSE embedding[1] END)::DOUBLE, 6)
  AS first FROM embeddings UNION ALL SELECT 'n' || vec_id, round(embedding[1]::DOUBLE, 6) FROM embeddings WHERE label = 5""")
def vector_upsert(spark, d):
    """Even labels come reversed, odd ones without vector (skipped), label five also under new ids."""
    e = tables.load(spark, d, "embeddings")
    target = e.select(_str("vec_id").alias("chunk_id"), "embedding")
    again = e.select(_str("vec_id").alias("chunk_id"), F.when(F.col("label") % 2 == 0, F.reverse("embedding")).alias("embedding"))
    new = e.where("label = 5").select(F.concat(F.lit("n"), _str("vec_id")).alias("chunk_id"), "embedding")
    return store.store_embeddings(target, again.unionByName(new)).select(
        "chunk_id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


@register("D1", """SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id""")
def last_write_wins(spark, d):
    """A batch holding a key many times keeps its last row."""
    rows = tables.load(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return store.latest(rows, ["user_id"], F.col("event_id")).select("user_id", "event_type", "value")


# ---- files and tenants ---------------------------------------------------------------------------------------------

def _files(spark, d):
    doc = _str("doc_id")
    return tables.load(spark, d, "documents").select(
        doc.alias("file_id"), F.col("lang").alias("org_id"), F.concat(doc, F.lit(".txt")).alias("filename"),
        F.lit("txt").alias("file_type"),
        F.when(F.col("n_chars") > 3000, "completed").when(F.col("n_chars") > 1000, "indexed").otherwise("error").alias("status"),
        F.lit(0).alias("chunk_count"), F.lit(None).cast("string").alias("error"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("n_chars")).alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"))


FILES = """files AS (SELECT doc_id::VARCHAR AS file_id, lang AS org_id, doc_id || '.txt' AS filename, CASE WHEN n_chars > 3000
  THEN 'completed' WHEN n_chars > 1000 THEN 'indexed' ELSE 'error' END AS status, 1704067200 + n_chars AS created FROM documents)"""


@register("D1 S8", sql.with_(FILES) + """SELECT file_id, org_id, CASE WHEN l.doc_id IS NULL THEN status ELSE 'processing' END AS status,
  filename FROM files f LEFT JOIN labels l ON l.doc_id::VARCHAR = file_id
UNION ALL SELECT 'page' || page_id, 'web', 'processing', url FROM pages""")
def file_registration(spark, d):
    again = tables.load(spark, d, "labels").select(_str("doc_id").alias("file_id"), F.lit("x").alias("org_id"),
                                                   F.lit("y").alias("filename"))
    new = tables.load(spark, d, "pages").select(F.concat(F.lit("page"), _str("page_id")).alias("file_id"),
                                                F.lit("web").alias("org_id"), F.col("url").alias("filename"))
    return store.store_files(_files(spark, d), again.unionByName(new)).select("file_id", "org_id", "status", "filename")


@register("P6", sql.with_(FILES) + """SELECT file_id AS id, filename AS name, filename, CASE status WHEN 'completed' THEN 'indexed'
  ELSE status END AS status FROM files""")
def normalized_files(spark, d):
    return store.normalize_files(_files(spark, d)).select("id", "name", "filename", "status")


@register("P9", sql.with_(FILES) + "SELECT file_id AS id FROM files WHERE status IN ('completed', 'indexed')")
def indexed_file_ids(spark, d):
    return store.indexed_files(store.normalize_files(_files(spark, d))).select("id")


@register("T6", sql.with_(FILES) + "SELECT file_id, org_id, created FROM files ORDER BY created DESC, file_id")
def file_listing(spark, d):
    return store.newest_first(_files(spark, d), "file_id").select(
        "file_id", "org_id", F.unix_seconds("created_at").alias("created"))


@register("A5", sql.with_(LANG_TEXT, FILES) + """SELECT file_id, f.org_id, CASE WHEN n IS NULL THEN status ELSE 'indexed' END AS status,
  coalesce(n, 0)::INT AS chunk_count FROM files f LEFT JOIN (SELECT file_id, count(*) AS n FROM text_chunks GROUP BY file_id)
  USING (file_id)""")
def file_status_update(spark, d):
    """Chunk counts per file written back with the final status."""
    counts = store.file_chunk_counts(tables.text_chunks(spark, d, None))
    results = counts.withColumns({"status": F.lit("indexed"), "error": F.lit("")})
    return store.update_file_status(_files(spark, d), results, _now()).select("file_id", "org_id", "status", "chunk_count")


@register("A4", sql.with_(sql.CORPUS) + "SELECT coalesce(modality, 'all') AS modality, count(*) AS n_chunks FROM chunks GROUP BY ROLLUP (modality)")
def modality_counts(spark, d):
    return store.modality_counts(tables.corpus_chunks(spark, d))


@register("A10", sql.with_(sql.CORPUS) + "SELECT DISTINCT org_id, modality FROM chunks")
def modalities_present(spark, d):
    return store.modalities_present(tables.corpus_chunks(spark, d))


def _orgs(spark, d):
    return tables.load(spark, d, "nation").select(
        _str("n_nationkey").alias("org_id"), F.col("n_name").alias("name"), F.lit("{}").alias("config"),
        F.lit(None).cast("timestamp").alias("created_at"))


@register("D1", """SELECT n_nationkey::VARCHAR AS org_id, n_name AS name FROM nation UNION ALL SELECT s_suppkey::VARCHAR, s_name
FROM supplier WHERE s_suppkey::VARCHAR NOT IN (SELECT n_nationkey::VARCHAR FROM nation)""")
def ensured_orgs(spark, d):
    """Tenants are added when absent; known ones keep their name."""
    rows = tables.load(spark, d, "supplier").select(_str("s_suppkey").alias("org_id"), F.col("s_name").alias("name"))
    return store.ensure_orgs(_orgs(spark, d), rows).select("org_id", "name")


@register("D1", """SELECT coalesce(s_suppkey::VARCHAR, n_nationkey::VARCHAR) AS org_id, CASE WHEN s_suppkey IS NULL THEN n_name
  WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR ELSE s_name END AS name, CASE WHEN s_suppkey IS NULL THEN '{}' ELSE
  '{"top_k":' || s_nationkey || '}' END AS config FROM nation FULL JOIN supplier ON s_suppkey = n_nationkey""")
def org_config_update(spark, d):
    """Name and config are replaced; an empty name falls back to the id."""
    rows = tables.load(spark, d, "supplier").select(
        _str("s_suppkey").alias("org_id"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.col("s_name")).alias("name"),
        F.to_json(F.struct(F.col("s_nationkey").alias("top_k"))).alias("config"))
    return store.update_org_config(_orgs(spark, d), rows).select("org_id", "name", "config")


@register("S13", """SELECT c_custkey::VARCHAR AS org_id, c_name AS name, '{}' AS config, NULL::VARCHAR AS created, c_mktsegment FROM customer""")
def aligned_schema(spark, d):
    """An old table without config and date gets them; its own extra column stays."""
    old = tables.load(spark, d, "customer").select(_str("c_custkey").alias("org_id"), F.col("c_name").alias("name"), "c_mktsegment")
    return store.align_schema(old, ORG, {"config": "{}"}).select(
        "org_id", "name", "config", F.col("created_at").cast("string").alias("created"), "c_mktsegment")


@register("S12", "SELECT count(*) AS n_before, 0::BIGINT AS n_after FROM customer")
def cleared_table(spark, d):
    path, customers = shared_folder(spark, "cleared"), tables.load(spark, d, "customer")
    customers.write.parquet(path)
    store.clear_table(spark, path, customers.schema)
    after = spark.read.schema(customers.schema).parquet(path).select(F.lit("after").alias("moment"))
    both = customers.select(F.lit("before").alias("moment")).unionByName(after)
    return both.agg(F.count_if(F.col("moment") == "before").alias("n_before"),
                    F.count_if(F.col("moment") == "after").alias("n_after"))


@register("J7 Q4", sql.with_(LANG_TEXT, FILES, "doomed AS (SELECT doc_id::VARCHAR AS file_id FROM labels WHERE toxic = 1 OR quality = 0)")
          + """SELECT 'chunks' AS part, org_id, count(*) AS n FROM text_chunks WHERE file_id NOT IN (SELECT file_id FROM doomed) GROUP BY org_id
UNION ALL SELECT 'vectors', org_id, count(*) FROM text_chunks WHERE file_id NOT IN (SELECT file_id FROM doomed) GROUP BY org_id
UNION ALL SELECT 'files', org_id, count(*) FROM files WHERE file_id NOT IN (SELECT file_id FROM doomed) GROUP BY org_id""")
def file_deletion(spark, d):
    """Deleted files take their chunks and vectors along.  Chunks and vectors are stored first, as the tables they are deleted from."""
    path = shared_folder(spark, "chunks")
    tables.text_chunks(spark, d, None).select("chunk_id", "org_id", "file_id").write.parquet(path)
    chunks = spark.read.parquet(path)
    vectors = chunks.select("chunk_id")
    kept, vectors_kept, files_kept = store.delete_files(chunks, vectors, _files(spark, d), _doomed(spark, d))
    count = lambda df, part: df.groupBy("org_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "org_id", "n")
    owners = chunks.select("chunk_id", "org_id")
    return (count(kept, "chunks").unionByName(count(vectors_kept.join(owners, "chunk_id"), "vectors"))
            .unionByName(count(files_kept, "files")))


def _doomed(spark, d):
    bad = tables.load(spark, d, "labels").where("toxic = 1 OR quality = 0").select(_str("doc_id").alias("file_id"))
    return _files(spark, d).join(bad, "file_id", "left_semi").select("org_id", "file_id")


@register("Q4 A1", sql.with_(sql.text_chunks("lang", "all_chunks"), """chunks AS (SELECT * FROM all_chunks WHERE file_id NOT IN (
  SELECT doc_id::VARCHAR FROM labels WHERE toxic = 1 OR quality = 0))""", sql.QUERIES, sql.bm25())
          + "SELECT org_id, modality, term, df, round(idf, 6) AS idf FROM ts")
def reindex_after_deletion(spark, d):
    """The index over what is left after a deletion."""
    chunks = tables.text_chunks(spark, d, None)
    kept, _, _ = store.delete_files(chunks, chunks.select("chunk_id"), _files(spark, d), _doomed(spark, d))
    return store.rebuild_bm25(kept)[2].select("org_id", "modality", "term", "df", F.round("idf", 6).alias("idf"))


@register("J10 U4", """SELECT DISTINCT 'o' || s.nation AS org_id, s.modality FROM (SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS modality
  FROM customer) s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.nation AND c.c_mktsegment = s.modality AND c_acctbal > 8000)""")
def stale_index_groups(spark, d):
    """Stored (tenant, modality) groups with nothing left after poorer customers are removed."""
    rows = tables.load(spark, d, "customer").select(F.concat(F.lit("o"), _str("c_nationkey")).alias("org_id"),
                                                    F.col("c_mktsegment").alias("modality"), "c_acctbal")
    return store.stale_groups(rows, rows.where("c_acctbal > 8000"))


# ---- conversations -------------------------------------------------------------------------------------------------

def _messages(spark, d):
    return tables.load(spark, d, "conversations").select(
        _str("conv_id").alias("session_id"), F.concat_ws(":", "conv_id", "turn").alias("message_id"),
        F.concat(F.lit("org"), (F.col("conv_id") % 7).cast("string")).alias("org_id"), "role", F.col("text").alias("content"),
        "turn", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_at"))


def _sessions(spark, d):
    firsts = _messages(spark, d).groupBy("session_id", "org_id").agg(F.min("created_at").alias("created_at"))
    return store.align_schema(firsts, CHAT_SESSION).select(*CHAT_SESSION.names)


SESSIONS = """sessions AS (SELECT conv_id::VARCHAR AS session_id, 'org' || (conv_id % 7) AS org_id,
  1704067200 + conv_id * 3600 + min(turn) * 60 AS created FROM conversations GROUP BY conv_id)"""
LINES = "string_agg(role || ':' || substr(text, 1, 500), chr(10) ORDER BY turn)"


def _joined(history):
    return F.array_join(F.transform(history, lambda m: F.concat_ws(":", m["role"], m["content"])), "\n")


@register("W4", f"""SELECT session_id, {LINES} AS history FROM (SELECT conv_id::VARCHAR AS session_id, *, row_number() OVER (
  PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE text <> '') WHERE back <= 6 GROUP BY session_id""")
def history_window(spark, d):
    return chat.history_window(_messages(spark, d)).select("session_id", _joined("history").alias("history"))


@register("W4", f"""SELECT a.conv_id::VARCHAR AS session_id, a.turn, coalesce((SELECT {LINES} FROM conversations b
  WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.turn >= a.turn - 6), '') AS history FROM conversations a""")
def history_at_each_turn(spark, d):
    """The six messages before each one, with sessions cut into segments of three turns."""
    return chat.history_at_each_turn(_messages(spark, d), rows=3).select(
        "session_id", "turn", _joined("history").alias("history"))


@register("F22", """SELECT conv_id::VARCHAR AS session_id, CASE WHEN length(t) > 30 THEN substr(t, 1, 30) || '...' ELSE t END AS title
FROM (SELECT conv_id, min_by(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)""")
def session_titles(spark, d):
    return chat.session_titles(_messages(spark, d))


@register("D1 F22", sql.with_(SESSIONS) + """SELECT session_id, org_id, t AS title, updated FROM (SELECT s.session_id, s.org_id,
  CASE WHEN length(t) > 30 THEN substr(t, 1, 30) || '...' ELSE t END AS t, CASE WHEN t IS NULL THEN NULL ELSE 1735689600::BIGINT END AS updated
  FROM sessions s LEFT JOIN (SELECT conv_id::VARCHAR AS session_id, min_by(text, turn) AS t FROM conversations WHERE role = 'user'
  GROUP BY conv_id) USING (session_id))""")
def session_upsert(spark, d):
    """Sessions opened again take the new title and time."""
    rows = chat.session_titles(_messages(spark, d))
    return store.create_sessions(_sessions(spark, d), rows, _now()).select(
        "session_id", "org_id", "title", F.unix_seconds("updated_at").alias("updated"))


@register("J9", sql.with_(SESSIONS) + "SELECT session_id, org_id FROM sessions WHERE org_id = 'org' || (session_id::BIGINT % 5)")
def owned_sessions(spark, d):
    return store.owned(_sessions(spark, d), _claims(spark, d)).select("session_id", "org_id")


def _claims(spark, d):
    return tables.load(spark, d, "conversations").select(
        _str("conv_id").alias("session_id"), F.concat(F.lit("org"), (F.col("conv_id") % 5).cast("string")).alias("org_id")).distinct()


@register("D2", sql.with_(SESSIONS) + """SELECT u.user_id AS session_id, org_id FROM (SELECT DISTINCT user_id::VARCHAR AS user_id FROM events) u
  LEFT JOIN sessions ON session_id = u.user_id""")
def session_owners(spark, d):
    keys = tables.load(spark, d, "events").select(_str("user_id").alias("session_id")).distinct()
    return store.lookup(_sessions(spark, d), keys, "session_id", ["org_id"])


@register("D3 J7", sql.with_(SESSIONS, "gone AS (SELECT session_id FROM sessions WHERE org_id = 'org' || (session_id::BIGINT % 5))")
          + """SELECT s.session_id, count(*) AS n_messages FROM sessions s JOIN conversations c ON c.conv_id::VARCHAR = s.session_id
  WHERE s.session_id NOT IN (SELECT session_id FROM gone) GROUP BY s.session_id""")
def session_deletion(spark, d):
    sessions, messages = store.delete_sessions(_sessions(spark, d), _messages(spark, d), _claims(spark, d))
    counts = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return sessions.select("session_id").join(counts, "session_id", "left")


@register("A9", """SELECT 'org' || r_regionkey AS org_id, (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 7 = r_regionkey) AS n_deleted
FROM region""")
def tenant_session_purge(spark, d):
    orgs = tables.load(spark, d, "region").select(F.concat(F.lit("org"), _str("r_regionkey")).alias("org_id"))
    return store.delete_all_sessions(_sessions(spark, d), _messages(spark, d), orgs)[2]


@register("T6", """SELECT conv_id::VARCHAR AS session_id, conv_id || ':' || turn AS message_id, role FROM conversations ORDER BY conv_id, turn""")
def message_listing(spark, d):
    return chat.message_listing(_messages(spark, d)).select("session_id", "message_id", "role")


# ---- status, limits, streams ---------------------------------------------------------------------------------------

def _status_log(events):
    return events.select("event_id", _str("user_id").alias("file_id"), F.col("event_type").alias("status"),
                         F.col("event_type").alias("stage"), F.col("value").cast("int").alias("progress"), "ts")


@register("W5", """SELECT event_id, file_id, previous_status FROM (SELECT event_id, user_id::VARCHAR AS file_id, event_type,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_status FROM events)
  WHERE event_type = 'purchase' AND previous_status <> 'purchase'""")
def newly_indexed(spark, d):
    """Status changes; the log of each file is cut into segments of about equally many rows."""
    log = _status_log(tables.load(spark, d, "events"))
    return chat.newly_indexed(log, order=["ts", "event_id"], target="purchase").select("event_id", "file_id", "previous_status")


STATUS_SQL = """SELECT user_id::VARCHAR AS file_id, max_by(event_type, (ts, event_id)) AS stage,
  trunc(max_by(value, (ts, event_id)))::INT AS progress FROM events GROUP BY user_id"""


@register("ST2", STATUS_SQL)
def latest_status(spark, d):
    log = _status_log(tables.load(spark, d, "events"))
    return jobs.latest_status(log, ["ts", "event_id"]).select("file_id", "stage", "progress")


def _stream(spark, d, name):
    """A table as a stream, whether it is one file or a folder of files.  The pattern names just the table; a plain path to a
    file is refused by a streaming source."""
    return spark.readStream.schema(tables.load(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _drain(spark, stream, writer=None):
    """Run a stream over what is there now, each result replacing the one before, and read it back."""
    path, checkpoint = shared_folder(spark, "out"), shared_folder(spark, "checkpoint")
    sink = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if writer == "append":
        query = sink.format("parquet").option("path", path).start()
    else:
        query = sink.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.parquet(path)


@register("ST2", STATUS_SQL)
def streamed_status(spark, d):
    log = _status_log(_stream(spark, d, "events"))
    return _drain(spark, jobs.latest_status(log, ["ts", "event_id"])).select("file_id", "stage", "progress")


@register("ST2 D2", f"""SELECT coalesce(a.file_id, c_custkey::VARCHAR) AS file_id, coalesce(stage, c_mktsegment) AS status, progress
FROM customer FULL JOIN ({STATUS_SQL}) a ON a.file_id = c_custkey::VARCHAR""")
def effective_status(spark, d):
    stored = tables.load(spark, d, "customer").select(_str("c_custkey").alias("file_id"), F.col("c_mktsegment").alias("status"))
    return jobs.effective_status(latest_status(spark, d), stored)


@register("ST2", """SELECT l_orderkey, l_linenumber, l_partkey, least(45 + trunc(l_linenumber::DOUBLE / 7 * 25)::INT, 70) AS progress FROM lineitem""")
def embedding_progress(spark, d):
    progress = jobs.embedding_progress(F.col("l_linenumber") - 1, F.lit(7))
    return tables.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", progress.alias("progress"))


TTL_MS = 6 * 3600 * 1000
TTL_SQL = f"""SELECT user_id, event_type, unnest(stored) AS answered_ms FROM (SELECT user_id, event_type, list_reduce(list_transform(
  list_sort(list(epoch_us(ts) // 1000)), lambda t: [t]), lambda a, t: CASE WHEN t[1] - a[len(a)] > {TTL_MS} THEN list_append(a, t[1]) ELSE a END)
  AS stored FROM events GROUP BY user_id, event_type)"""


@register("ST3 F11", TTL_SQL)
def answered_once_per_life(spark, d):
    """Requests answered afresh when answers live six hours; history is cut into segments of two lives."""
    events = tables.load(spark, d, "events")
    return jobs.dedup_queries_ttl_batch(events, ["user_id", "event_type"], ttl_ms=TTL_MS, segments=2)


@register("ST3", TTL_SQL)
def streamed_answered_once(spark, d):
    events = _stream(spark, d, "events")
    return _drain(spark, jobs.dedup_queries_ttl(events, ["user_id", "event_type"], ttl_ms=TTL_MS), "append")


RATE_SQL = """SELECT user_id, epoch(w)::BIGINT AS window_start, n AS n_requests, greatest(n - 2, 0) AS n_rejected FROM (
  SELECT user_id, time_bucket(INTERVAL 6 HOURS, ts) AS w, count(*) AS n FROM events GROUP BY ALL)"""


def _rates(events):
    flags = jobs.rate_limit_flags(events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", window="6 hours", limit=2)
    return flags.select("user_id", F.unix_seconds("window_start").alias("window_start"), "n_requests", "n_rejected")


@register("ST4", RATE_SQL)
def rate_limits(spark, d):
    return _rates(tables.load(spark, d, "events"))


@register("ST4", RATE_SQL)
def streamed_rate_limits(spark, d):
    return _drain(spark, _rates(_stream(spark, d, "events")))


def _arriving(spark, parts, stream, mode="append", keys=None):
    """Run a stream over parts of a table that arrive one after the other, each a batch (or more) of its own; its state and its
    watermark go on from batch to batch.  With ``keys`` changed rows replace those of their key."""
    files, out, checkpoint = (shared_folder(spark, name) for name in ("arriving", "out", "checkpoint"))
    for rows in parts:
        rows.write.mode("append").parquet(files)
        made = stream(spark.readStream.schema(rows.schema).parquet(files)).writeStream.outputMode(mode)
        writer = made.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        with state.rocksdb_state(spark):
            query = (writer.foreachBatch(state.upsert_sink(out, keys)) if keys else writer.format("parquet").option("path", out)).start()
        query.awaitTermination()
    return spark.read.parquet(out)


def _thirds(rows, ts="ts"):
    """Three parts of a table, by time."""
    first, last = rows.agg(F.min(F.unix_millis(ts)), F.max(F.unix_millis(ts))).first()
    third = F.least(F.floor((F.unix_millis(ts) - first) * 3 / max(1, last - first)), F.lit(2))
    return [rows.where(third == i) for i in range(3)]


def _timed_events(spark, d):
    return tables.load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@register("ST2", STATUS_SQL)
def streamed_status_in_batches(spark, d):
    """Status changes of three batches, upserted by file; a file's state goes a day after its newest event."""
    log = _status_log(_timed_events(spark, d))
    stream = lambda rows: state.latest_changes(rows, ["file_id"], ["stage", "progress"], ties=("event_id",), delay="1 hour", life="1 day")
    return _arriving(spark, _thirds(log), stream, "update", ["file_id"]).select("file_id", "stage", "progress")


@register("ST3", TTL_SQL)
def streamed_answered_in_batches(spark, d):
    """Requests answered afresh over three batches; an answer's state goes when its life has ended."""
    stream = lambda rows: state.answered_once(rows, ["user_id", "event_type"], ttl_ms=TTL_MS, delay="1 hour")
    return _arriving(spark, _thirds(_timed_events(spark, d)), stream)


@register("ST4", RATE_SQL)
def streamed_rates_in_batches(spark, d):
    """Windows of three batches, upserted by user and window; a window's state goes with the watermark."""
    stream = lambda rows: jobs.rate_limit_flags(rows, "user_id", window="6 hours", limit=2, delay="1 hour")
    found = _arriving(spark, _thirds(_timed_events(spark, d)), stream, "update", ["user_id", "window_start"])
    return found.select("user_id", F.unix_seconds("window_start").alias("window_start"), "n_requests", "n_rejected")


def _tokens(messages):
    words = messages.select("conv_id", "turn", "role", F.posexplode(F.split("text", "(?<= )")).alias("seq", "token"))
    body = words.select("conv_id", "turn", "seq", "token", F.lit(False).alias("done"))
    ends = messages.where("role <> 'system'").select("conv_id", "turn", F.lit(-1).alias("seq"), F.lit("").alias("token"),
                                                     F.lit(True).alias("done"))
    return body.unionByName(ends)


@register("ST5", "SELECT conv_id, turn, text AS answer FROM conversations WHERE role <> 'system'")
def assembled_answers(spark, d):
    """Texts put together from word tokens; answers without a done event are left out."""
    return jobs.assemble_answers(_tokens(tables.load(spark, d, "conversations")), ["conv_id", "turn"])


@register("ST5", "SELECT conv_id, turn, text AS answer FROM conversations WHERE role <> 'system'")
def streamed_answers(spark, d):
    return _drain(spark, jobs.assemble_answers(_tokens(_stream(spark, d, "conversations")), ["conv_id", "turn"]))


@register("ST5", "SELECT conv_id, turn, text AS answer FROM conversations WHERE role <> 'system'")
def streamed_answers_in_batches(spark, d):
    """Tokens of every answer over three batches; it is given out, and its tokens leave the state, with its done event."""
    tokens = _tokens(tables.load(spark, d, "conversations"))
    part = F.when(F.col("done"), F.lit(2)).otherwise(F.pmod(F.xxhash64("conv_id", "turn", "seq"), F.lit(3)))
    timed = tokens.withColumn("part", part).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("part")))
    stream = lambda rows: state.answers_as_they_end(rows, ["conv_id", "turn"])
    return _arriving(spark, [timed.where(F.col("part") == i).drop("part") for i in range(3)], stream)


@register("ST6", """SELECT conv_id::VARCHAR AS session_id, count(*) AS n_messages, 1704067200 + conv_id * 3600 + max(turn) * 60 AS updated
FROM conversations GROUP BY conv_id""")
def streamed_messages(spark, d):
    """Messages appended from a stream move their session's time."""
    messages, sessions = shared_folder(spark, "messages"), shared_folder(spark, "sessions")
    table = jobs.session_table(spark, sessions)
    table.upsert(_sessions(spark, d), 0)
    table.compact()
    source = _stream(spark, d, "conversations").select(
        _str("conv_id").alias("session_id"), F.concat_ws(":", "conv_id", "turn").alias("message_id"),
        F.concat(F.lit("org"), (F.col("conv_id") % 7).cast("string")).alias("org_id"), "role", F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_at"))
    jobs.append_messages(source, messages, sessions, shared_folder(spark, "checkpoint")).awaitTermination()
    counts = spark.read.parquet(messages).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return table.read().join(counts, "session_id").select(
        "session_id", "n_messages", F.unix_seconds("updated_at").alias("updated"))


@register("D1 S8 J7 S12", """SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 10 = 0 THEN 'again' ELSE source END AS source, lang,
  CASE WHEN doc_id % 10 = 0 OR doc_id % 3 = 0 THEN text ELSE reverse(text) END AS text FROM documents WHERE doc_id % 10 = 0 OR doc_id % 5 <> 0""")
def merged_on_read(spark, d):
    """Upserts, a delete and inserts as changes over a stored base, compacted on the way: known rows take the new text only, deleted
    ones come back whole."""
    docs = tables.load(spark, d, "documents")
    row = lambda source, text: docs.select("doc_id", _str("doc_id").alias("id"), source.alias("source"), "lang", text.alias("text"))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "source", "lang", "text")])
    table = merge_table.MergeTable(spark, shared_folder(spark, "merged"), schema, ("doc_id",), ("text",), ("lang",))
    part = lambda rows, where: rows.where(where).drop("doc_id").withColumnRenamed("id", "doc_id")
    table.upsert(part(row(F.col("source"), F.reverse("text")), "true"), 0)
    table.upsert(part(row(F.lit("changed"), F.col("text")), "doc_id % 3 = 0"), 1)
    table.compact()
    table.delete(part(row(F.col("source"), F.col("text")), "doc_id % 5 = 0"), 2)
    table.upsert(part(row(F.lit("again"), F.col("text")), "doc_id % 10 = 0"), 3)
    return table.read()


def _ingested(spark, d, statistics="whole"):
    path = shared_folder(spark, "ingested")
    doc = _str("doc_id")
    documents = _stream(spark, d, "documents").select(doc.alias("doc_id"), F.lit(0).alias("section_id"), "text",
                                                      F.col("lang").alias("org_id"), doc.alias("file_id"))
    jobs.stream_ingest(documents, path, shared_folder(spark, "checkpoint"), dim=64, buckets=4, statistics=statistics).awaitTermination()
    return path


@register("ST1 S8 S9 S10", BM25_LANG + "SELECT org_id, modality, term, df, round(idf, 6) AS idf FROM ts")
def streamed_ingest(spark, d):
    """Documents from a stream are chunked, embedded and upserted, and their tenants' statistics renewed."""
    return spark.read.parquet(f"{_ingested(spark, d)}/term_stats").select(
        "org_id", "modality", "term", "df", F.round("idf", 6).alias("idf"))


@register("ST1 A1 S10 D1", sql.with_(sql.text_chunks("lang", "own"), "chunks AS (SELECT * FROM own UNION ALL SELECT * REPLACE ('all' AS org_id) FROM own)", sql.QUERIES, sql.bm25())
          + "SELECT org_id, modality, term, df, round(idf, 6) AS idf, n_docs, round(avgdl, 6) AS avgdl FROM ts JOIN cs USING (org_id, modality)")
def streamed_ingest_in_batches(spark, d):
    """Three micro-batches and a deletion; every document belongs to its language's tenant and, under the same ids, to a tenant of
    all.  The first batch brings reversed texts and files that are deleted again.  Statistics are sums of the batches' changes."""
    path, files, doc = shared_folder(spark, "ingested"), shared_folder(spark, "arriving"), _str("doc_id")
    tenants = F.explode(F.array("lang", F.lit("all"))).alias("org_id")
    documents = tables.load(spark, d, "documents").select(doc.alias("doc_id"), F.lit(0).alias("section_id"), "text", tenants, doc.alias("file_id"))
    extra = documents.where("length(text) < 2000").withColumns({c: F.concat(F.lit("gone"), c) for c in ("doc_id", "file_id")})
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    for rows in (documents.where(half).withColumn("text", F.reverse("text")).unionByName(extra), documents.where(~half), documents.where(half)):
        rows.write.mode("append").parquet(files)  # each run of the stream takes what is new as one micro-batch
        stream = spark.readStream.schema(documents.schema).parquet(files)
        jobs.stream_ingest(stream, path, f"{files}-checkpoint", dim=16, buckets=4).awaitTermination()
    changes.compact(spark, path)
    jobs.delete_stored_files(spark, path, extra.select("org_id", "file_id"), statistics="changes")
    stats, terms = changes.read_statistics(spark, path)
    return terms.join(stats, ["org_id", "modality"]).select("org_id", "modality", "term", "df", F.round("idf", 6).alias("idf"), "n_docs",
                                                            F.round("avgdl", 6).alias("avgdl"))


@register("ST1 S8 G1", sql.with_(LANG_TEXT) + "SELECT chunk_id, doc_id, section_id, modality, content, org_id, file_id FROM text_chunks",
          ints="section_id")
def ingested_chunks(spark, d):
    """Chunk rows of a streamed ingest."""
    return jobs.read_placed(spark, f"{_ingested(spark, d)}/chunks").select(
        "chunk_id", "doc_id", "section_id", "modality", "content", "org_id", "file_id")


@register("ST1 S9 M1", sql.with_(LANG_TEXT, sql.embedded("e", "text_chunks", "chunk_id", "content", 64))
          + "SELECT chunk_id, org_id, b, round(w, 6) AS w FROM e JOIN text_chunks USING (chunk_id)")
def ingested_vectors(spark, d):
    """Vectors of a streamed ingest, by place."""
    return (jobs.read_placed(spark, f"{_ingested(spark, d)}/vectors")
            .select("chunk_id", "org_id", F.posexplode("embedding").alias("b", "w")).where("w <> 0")
            .select("chunk_id", "org_id", F.col("b").cast("long").alias("b"), F.round(F.col("w").cast("double"), 6).alias("w")))


@register("ST1 A5 S8", sql.with_(LANG_TEXT) + """SELECT doc_id::VARCHAR AS file_id, lang AS org_id, CASE WHEN n IS NULL THEN 'error'
  ELSE 'indexed' END AS status, coalesce(n, 0)::INT AS chunk_count, CASE WHEN n IS NULL THEN 'No chunks extracted' ELSE '' END AS error
FROM documents LEFT JOIN (SELECT file_id, count(*) AS n FROM text_chunks GROUP BY file_id) c ON c.file_id = doc_id::VARCHAR""")
def ingest_file_status(spark, d):
    """Files of a streamed ingest with their final status."""
    return jobs.read_placed(spark, f"{_ingested(spark, d)}/files").select("file_id", "org_id", "status", "chunk_count", "error")


@register("ST1 D1", sql.with_(LANG_TEXT) + "SELECT chunk_id, content, org_id FROM text_chunks")
def ingest_same_document_twice(spark, d):
    """A batch that holds every document twice keeps the version that arrived last, once."""
    path, doc = shared_folder(spark, "ingested"), _str("doc_id")
    versions = F.explode(F.array(F.struct(F.reverse("text").alias("text"), F.lit(1).alias("arrival")),
                                 F.struct(F.col("text"), F.lit(2).alias("arrival")))).alias("v")
    documents = tables.load(spark, d, "documents").select(
        doc.alias("doc_id"), F.lit(0).alias("section_id"), F.col("lang").alias("org_id"), doc.alias("file_id"), versions)
    documents = documents.select("doc_id", "section_id", "org_id", "file_id", "v.*")
    jobs.ingest_batch(documents, path, dim=16, buckets=4, arrival="arrival")
    return jobs.read_placed(spark, f"{path}/chunks").select("chunk_id", "content", "org_id")


@register("Q4 J7 J10 U4", sql.with_(sql.text_chunks("lang", "all_chunks"), """doomed AS (SELECT doc_id::VARCHAR AS file_id FROM labels
  WHERE toxic = 1 OR quality = 0 UNION SELECT doc_id::VARCHAR FROM documents WHERE lang = 'es')""",
                                 "chunks AS (SELECT * FROM all_chunks WHERE file_id NOT IN (SELECT file_id FROM doomed))", sql.QUERIES, sql.bm25())
          + """SELECT 'chunk' AS part, org_id, chunk_id AS id FROM chunks UNION ALL SELECT 'vector', org_id, chunk_id FROM chunks
UNION ALL SELECT 'forward', org_id, chunk_id FROM chunks UNION ALL SELECT 'file', lang, doc_id::VARCHAR FROM documents
  WHERE doc_id::VARCHAR NOT IN (SELECT file_id FROM doomed)
UNION ALL SELECT 'term', org_id, term || ' ' || df FROM ts""")
def stored_deletion(spark, d):
    """Files deleted from a stored index; one tenant loses all of them and vanishes from every table."""
    path = _ingested(spark, d)
    spanish = tables.load(spark, d, "documents").where("lang = 'es'").select(F.col("lang").alias("org_id"), _str("doc_id").alias("file_id"))
    jobs.delete_stored_files(spark, path, _doomed(spark, d).unionByName(spanish))
    rows = lambda name, part, i: jobs.read_placed(spark, f"{path}/{name}").select(F.lit(part).alias("part"), "org_id", i.alias("id"))
    return (rows("chunks", "chunk", F.col("chunk_id")).unionByName(rows("vectors", "vector", F.col("chunk_id")))
            .unionByName(rows("forward", "forward", F.col("chunk_id"))).unionByName(rows("files", "file", F.col("file_id")))
            .unionByName(rows("term_stats", "term", F.concat_ws(" ", "term", "df"))))
