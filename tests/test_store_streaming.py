import random

import pytest
from oracle_compare import compare, connect
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import sparse
from plumbline.plans import segments
from plumbline.schemas import FILE
from plumbline.sources import store
from plumbline.streaming import jobs
from plumbline.streaming import statistics as changes
from plumbline.workload import operations
from plumbline.workload.catalog import ENTRIES


def test_upsert_rules(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    rows = spark.createDataFrame([("b", 20, "Y"), ("c", 30, "Z")], "k string, v int, w string")
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(store.upsert(target, rows, ["k"], ["v"])) == [("a", 1, "x"), ("b", 20, "y"), ("c", 30, "Z")]
    assert got(store.upsert(target, rows, ["k"])) == [("a", 1, "x"), ("b", 2, "y"), ("c", 30, "Z")]
    ruled = store.upsert(target, rows, ["k"], {"w": F.concat("old.w", "new.w")})
    assert got(ruled) == [("a", 1, "x"), ("b", 2, "yY"), ("c", 30, "Z")]


def test_files_registered_again_keep_their_tenant(spark):
    schema = "file_id string, org_id string, filename string, status string"
    known = spark.createDataFrame([("f1", "o", "n.txt", "completed"), ("f2", "o", "m.txt", "error")], schema)
    rows = spark.createDataFrame([("f1", "x", "y"), ("f3", "x", "z")], "file_id string, org_id string, filename string")
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(store.store_files(known, rows)) == [("f1", "o", "n.txt", "processing"), ("f2", "o", "m.txt", "error"), ("f3", "x", "z", "processing")]
    assert got(store.store_files(known, rows, ("org_id", "file_id"))) == [
        ("f1", "o", "n.txt", "completed"), ("f1", "x", "y", "processing"), ("f2", "o", "m.txt", "error"), ("f3", "x", "z", "processing")]


def test_a_place_is_not_brought_to_one_task(spark, tmp_path, monkeypatch):
    """Whatever Spark guesses of its size, the list of touched places is broadcast and the stored rows stay where they are."""
    places, plans, replace = set(), [], store.replace_partitions

    def seen(df, path, *more):
        plans.append((path.rsplit("/", 1)[1], df._jdf.queryExecution().optimizedPlan().toString()))
        replace(df, path, *more)

    monkeypatch.setattr(store, "replace_partitions", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(f"d{i}", 0, "a word. " * 20, "o", f"d{i}") for i in range(20)]
        jobs.ingest_batch(spark.createDataFrame(rows, "doc_id string, section_id int, text string, org_id string, file_id string"),
                          str(tmp_path / "index"), dim=4, buckets=2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for name, plan in plans:
        semi = [line for line in plan.splitlines() if "Join LeftSemi" in line and ("bucket" in line or "modality" in line) and "chunk_id" not in line]
        places |= {name} if semi else set()
        assert all("strategy=broadcast" in line for line in semi), (name, semi)
    assert {"chunks", "vectors", "forward"} <= places


def test_tables_stream_from_a_file_and_from_a_folder(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    rows.limit(3).write.parquet(str(tmp_path / "other.parquet"))
    want = sorted(tuple(r) for r in rows.where("role <> 'system'").select("conv_id", "turn", "text").collect())
    for folder in ("/root/testdata/sf0.001", str(tmp_path)):
        for run in (operations.streamed_answers, operations.streamed_messages):
            found = run(spark, folder)
            assert found.count() == (len(want) if run is operations.streamed_answers else rows.select("conv_id").distinct().count())
        assert sorted(tuple(r) for r in operations.streamed_answers(spark, folder).select("conv_id", "turn", "answer").collect()) == want


@pytest.mark.parametrize("name", ["ingested_chunks", "ingested_vectors", "streamed_ingest", "stored_deletion"])
def test_ingest_of_tables_that_are_folders(spark, tmp_path, name):
    for table in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    entry = ENTRIES[name]
    found, wanted, problems = compare(entry.run(spark, str(tmp_path)), connect("/root/testdata/sf0.001"), entry.sql)
    assert found == wanted > 0 and not problems


def test_replace_partitions_reads_and_writes_one_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1), ("b", 2)], "p string, v int").write.partitionBy("p").parquet(path)
    table = spark.read.schema("v int, p string").parquet(path)
    changed = table.where("p = 'b'").withColumn("v", F.col("v") + 10)
    store.replace_partitions(changed, path, ["p"])
    assert sorted(tuple(r) for r in spark.read.schema("v int, p string").parquet(path).collect()) == [(1, "a"), (12, "b")]


def test_schema_files_and_clear(spark, tmp_path):
    old = spark.createDataFrame([("f1", "o", "n.txt", "completed")], "file_id string, org_id string, filename string, status string")
    full = store.align_schema(old, FILE, {"chunk_count": 0})
    assert set(FILE.names) <= set(full.columns) and full.first().chunk_count == 0
    shown = store.normalize_files(full).first()
    assert (shown.id, shown.name, shown.status) == ("f1", "n.txt", "indexed")
    path = str(tmp_path / "c")
    full.write.parquet(path)
    store.clear_table(spark, path, full.schema)
    assert spark.read.schema(full.schema).parquet(path).count() == 0


@pytest.fixture(scope="module")
def hot_log(spark):
    """A third of the rows share one key; order values repeat."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.35 else rng.choice([None, *(f"k{i}" for i in range(20))]), rng.randrange(400), i, rng.choice(["a", "b", "indexed"]))
            for i in range(1500)]
    return spark.createDataFrame(rows, "k string, t int, i int, s string").repartition(6)


@pytest.mark.parametrize("rows", [1, 7, 100, 10_000])
def test_segmented_windows_equal_plain_windows(hot_log, rows):
    order = ["t", "i"]
    w = Window.partitionBy("k").orderBy(*order)
    plain = hot_log.select("i", (F.row_number().over(w) - 1).alias("o"), F.lag("s").over(w).alias("p"),
                           F.collect_list("s").over(w.rowsBetween(-6, -1)).alias("h"))
    expected = {r.i: (r.o, r.p, r.h) for r in plain.collect()}
    o = {r.i: r.ordinal for r in segments.ordinal(hot_log, ["k"], order, rows).collect()}
    p = {r.i: r.previous for r in segments.previous(hot_log, ["k"], order, F.col("s"), rows).collect()}
    h = {r.i: r.trailing for r in segments.trailing_rows(hot_log, ["k"], order, F.col("s"), 6, rows).collect()}
    assert {i: (o[i], p[i], h[i]) for i in expected} == expected


def test_a_busy_day_is_many_segments(spark):
    """One key, one time for half of the rows, the rest far apart: no segment holds much more than its share."""
    log = spark.range(20_000).select(F.lit("hot").alias("k"), F.when(F.col("id") < 10_000, 0).otherwise(F.col("id") * 86_400).alias("t"),
                                     F.col("id").alias("i"))
    sizes = [r["count"] for r in segments.with_segment(log, ["k"], ["t", "i"], 500).groupBy(segments.SEGMENT).count().collect()]
    assert sum(sizes) == 20_000 and 20 <= len(sizes) <= 65 and max(sizes) < 500 * 8
    again = segments.with_segment(log.repartition(5), ["k"], ["t", "i"], 500).groupBy(segments.SEGMENT).count()
    assert sorted(r["count"] for r in again.collect()) == sorted(sizes)


@pytest.mark.parametrize("segments_", [2, 5, 1000])
def test_answer_life_equals_a_plain_loop(spark, segments_):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}", rng.randrange(200_000)) for _ in range(3000)]
    expected, last = set(), {}
    for k, ms in sorted(rows, key=lambda r: r[1]):
        if k not in last or ms - last[k] > 1000:
            last[k] = ms
            expected.add((k, ms))
    df = spark.createDataFrame(rows, "k string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = jobs.dedup_queries_ttl_batch(df, ["k"], ttl_ms=1000, segments=segments_).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_ingest_twice_changes_nothing_and_updates_stick(spark, tmp_path):
    path = str(tmp_path / "ix")
    docs = lambda *rows: spark.createDataFrame([(i, 0, t, "o", i) for i, t in rows],
                                               "doc_id string, section_id int, text string, org_id string, file_id string")
    first = docs(("a", "Alpha beta."), ("b", "Beta gamma."))
    jobs.ingest_batch(first, path, dim=16, buckets=4)
    jobs.ingest_batch(first, path, dim=16, buckets=4)
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    assert read("chunks").count() == read("vectors").count() == read("forward").count() == 2
    jobs.ingest_batch(docs(("b", "Delta only."), ("c", "Alpha.")), path, dim=16, buckets=4)
    assert {r.doc_id: r.content for r in read("chunks").collect()} == {"a": "Alpha beta.", "b": "Delta only.", "c": "Alpha."}
    assert {r.term: r.df for r in read("term_stats").collect()} == {"alpha": 2, "beta": 1, "delta": 1, "only": 1}
    assert read("corpus_stats").first().n_docs == 3


def test_status_and_progress(spark):
    log = spark.createDataFrame([("f", "parsing", 5, 1), ("f", "embedding", 45, 2), ("g", "indexed", 100, 1)],
                                "file_id string, stage string, progress int, ts int")
    stored = spark.createDataFrame([("f", "processing"), ("h", "indexed")], "file_id string, status string")
    got = {r.file_id: (r.status, r.progress) for r in jobs.effective_status(jobs.latest_status(log), stored).collect()}
    assert got == {"f": ("embedding", 45), "g": ("indexed", 100), "h": ("indexed", None)}
    values = spark.createDataFrame([(0, 4), (3, 4), (9, 10)], "b int, n int").select(
        jobs.embedding_progress(F.col("b"), F.col("n"))).collect()
    assert [v[0] for v in values] == [51, 70, 70]


DOCS = "doc_id string, section_id int, text string, org_id string, file_id string"


def test_upsert_refuses_a_key_twice_and_makes_rows_once(spark):
    target = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(ValueError, match="twice"):
        store.upsert(target, spark.createDataFrame([("b", 1), ("b", 2)], "k string, v int"), ["k"], ["v"])
    calls = spark.sparkContext.accumulator(0)

    def made(parts):
        for part in parts:
            calls.add(len(part))
            yield part

    rows = spark.createDataFrame([("a", 5), ("b", 6)], "k string, v int").mapInPandas(made, "k string, v int")
    assert sorted(tuple(r) for r in store.upsert(target, rows, ["k"], ["v"]).collect()) == [("a", 5), ("b", 6)]
    assert calls.value == 2


def test_emptied_partitions_go(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a/b", 1), ("b", 2), ("c", 3)], "p string, v int").write.partitionBy("p").parquet(path)
    read = lambda: spark.read.schema("v int, p string").parquet(path)
    touched = spark.createDataFrame([("a/b",), ("b",)], "p string")
    store.replace_partitions(read().where("p = 'b'"), path, ["p"], touched)
    assert sorted(tuple(r) for r in read().collect()) == [(2, "b"), (3, "c")]


def test_one_document_twice_in_a_batch(spark, tmp_path):
    path = str(tmp_path / "ix")
    rows = [("a", 0, "Old words.", "o", "a", 1), ("a", 0, "New words here.", "o", "a", 2), ("b", 0, " ", "o", "b", 1)]
    jobs.ingest_batch(spark.createDataFrame(rows, DOCS + ", at int"), path, dim=16, buckets=4, arrival="at")
    read = lambda name: jobs.read_placed(spark, f"{path}/{name}")
    assert [r.content for r in read("chunks").collect()] == ["New words here."] and read("vectors").count() == 1
    assert read("corpus_stats").first().n_docs == 1
    files = {r.file_id: (r.status, r.chunk_count, r.error) for r in read("files").collect()}
    assert files == {"a": ("indexed", 1, ""), "b": ("error", 0, "No chunks extracted")}


def test_stored_delete_removes_groups(spark, tmp_path):
    path = str(tmp_path / "ix")
    rows = [("a", 0, "Alpha beta.", "007", "a"), ("b", 0, "Beta.", "o", "b"), ("c", 0, "Gamma.", "o", "c")]
    jobs.ingest_batch(spark.createDataFrame(rows, DOCS), path, dim=16, buckets=4)
    jobs.delete_stored_files(spark, path, spark.createDataFrame([("007", "a"), ("o", "c"), ("o", "zz")], "org_id string, file_id string"))
    read = lambda name: jobs.read_placed(spark, f"{path}/{name}")
    for name in ("chunks", "vectors", "forward", "files"):
        assert [(r.org_id, r.file_id) for r in read(name).collect()] == [("o", "b")], name
    assert [(r.org_id, r.term, r.df) for r in read("term_stats").collect()] == [("o", "beta", 1)]
    assert [r.org_id for r in read("corpus_stats").collect()] == ["o"]


def test_sections_with_tables_are_ingested_whole(spark, tmp_path):
    path = str(tmp_path / "ix")
    schema = DOCS + ", tables map<string,string>, images map<string,string>, caption string"
    rows = [("a", 0, "Some text.", "o", "a", {"t": "| x | y |\n|---|---|\n| 1 | 2 |"}, {}, "")]
    jobs.ingest_batch(spark.createDataFrame(rows, schema), path, dim=16, buckets=4)
    assert {r.modality for r in jobs.read_placed(spark, f"{path}/vectors").collect()} == {"text", "table"}


def statistics_of(path, spark):
    stats, terms = changes.read_statistics(spark, path)
    return (sorted(tuple(r) for r in stats.select("org_id", "modality", "n_docs", F.round("avgdl", 9)).collect()),
            sorted(tuple(r) for r in terms.select("org_id", "modality", "term", "df", F.round("idf", 9)).collect()))


def test_changes_of_statistics_equal_a_rebuild_after_ten_batches(spark, tmp_path):
    path, rng = str(tmp_path / "ix"), random.Random(4)
    words = [f"w{i}" for i in range(40)]
    doc = lambda i, org: (f"d{i}", 0, " ".join(rng.choices(words, k=rng.randrange(1, 30))) + ".", org, f"d{i}")
    for n in range(10):
        rows = spark.createDataFrame([doc(rng.randrange(12), org) for org in ("o", "p") for _ in range(3)], DOCS).dropDuplicates(["org_id", "doc_id"])
        jobs.ingest_batch(rows, path, dim=8, buckets=1, statistics="changes", batch=f"b{n}")
        if n == 3:
            before = statistics_of(path, spark)
            jobs.ingest_batch(rows, path, dim=8, buckets=1, statistics="changes", batch=f"b{n}")  # runs again after a failure
            assert statistics_of(path, spark) == before
        if n in (5, 7):
            jobs.delete_stored_files(spark, path, spark.createDataFrame([("o", f"d{i}") for i in range(6)], "org_id string, file_id string"), "changes")
        if n == 6:
            changes.compact(spark, path)
    forward = jobs.read_placed(spark, f"{path}/forward")
    stats = sparse.corpus_stats(forward)
    terms = sparse.term_stats(forward, stats)
    assert statistics_of(path, spark) == (
        sorted(tuple(r) for r in stats.select("org_id", "modality", "n_docs", F.round("avgdl", 9)).collect()),
        sorted(tuple(r) for r in terms.select("org_id", "modality", "term", "df", F.round("idf", 9)).collect()))
    old = forward.where("org_id = 'o' and chunk_id = 'd1_s0_t0'").first()
    rows = spark.createDataFrame([("d1", 0, "w1 fresh.", "o", "d1")], DOCS)
    jobs.ingest_batch(rows, path, dim=8, buckets=1, statistics="changes", batch="last")
    now = changes.generation(spark, path)
    written = spark.read.parquet(f"{path}/statistics/{now}/terms/batch=last")
    assert now == 1 and written.count() <= 2 + len(old.terms if old else ())  # what it brings and takes, whatever is stored
    changes.compact(spark, path)
    assert changes.generation(spark, path) == 2 and statistics_of(path, spark)[0][0][2] == jobs.read_placed(spark, f"{path}/forward").where("org_id = 'o'").count()


def test_two_tenants_share_ids(spark, tmp_path):
    for statistics in ("whole", "changes"):
        path = str(tmp_path / statistics)
        rows = [("1", 0, "Alpha beta.", "o", "1"), ("1", 0, "Gamma.", "p", "1"), ("2", 0, " ", "p", "2")]
        for _ in range(2):
            jobs.ingest_batch(spark.createDataFrame(rows, DOCS), path, dim=8, buckets=2, statistics=statistics)
        read = lambda name: jobs.read_placed(spark, f"{path}/{name}")
        assert sorted((r.org_id, r.chunk_id, r.content) for r in read("chunks").collect()) == [("o", "1_s0_t0", "Alpha beta."), ("p", "1_s0_t0", "Gamma.")]
        assert read("vectors").count() == read("forward").count() == 2
        files = sorted((r.org_id, r.file_id, r.status, r.chunk_count) for r in read("files").collect())
        assert files == [("o", "1", "indexed", 1), ("p", "1", "indexed", 1), ("p", "2", "error", 0)]
        jobs.delete_stored_files(spark, path, spark.createDataFrame([("o", "1")], "org_id string, file_id string"), statistics)
        assert [r.org_id for r in read("chunks").collect()] == ["p"]


def test_pages_are_normalised_on_the_way_in(spark, tmp_path):
    path = str(tmp_path / "ix")
    jobs.ingest_batch(spark.createDataFrame([("a", 0, "\ufb01ne  caf\u00e9 \u2167.", "o", "a"), ("b", 0, None, "o", "b")], DOCS), path, dim=8, buckets=1, nfkd=True)
    assert [r.content for r in jobs.read_placed(spark, f"{path}/chunks").collect()] == ["fine cafe\u0301 VIII."]


def test_messages_touch_their_sessions_only(spark, tmp_path):
    """Batches over two tenants, one of them run again, with a compaction between; an unknown session makes no row."""
    path, table = str(tmp_path / "m"), jobs.session_table(spark, str(tmp_path / "s"))
    at = lambda n: F.timestamp_seconds(F.lit(n))
    known = spark.range(50).select(F.concat(F.lit("s"), F.col("id")).alias("session_id"), F.concat(F.lit("o"), F.col("id") % 2).alias("org_id"),
                                   F.lit("t").alias("title"), at(0).alias("created_at"), at(5).alias("updated_at"))
    table.upsert(known, 0)
    table.compact()
    batch = lambda rows: spark.createDataFrame(rows, "session_id string, org_id string, t long").select("session_id", "org_id", at(F.col("t")).alias("created_at"))
    first = batch([("s0", "o0", 9), ("s0", "o0", 7), ("s1", "o1", 3), ("s1", "o0", 99), ("new", "o0", 4)])
    for epoch, rows in [(0, first), (0, first), (1, batch([("s0", "o0", 8)])), (2, batch([("s3", "o1", 20)]))]:
        jobs.append_batch(rows, epoch, path, table.path, compact_every=2)
    changes_ = spark.read.parquet(f"{table.path}/{max(p.name for p in (tmp_path / 's').iterdir())}/changes")
    assert [r.session_id for r in changes_.collect()] == ["s3"]
    got = {(r.session_id, r.org_id): r.u for r in table.read().select("session_id", "org_id", F.unix_seconds("updated_at").alias("u")).collect()}
    assert len(got) == 50 and got["s0", "o0"] == 9 and got["s1", "o1"] == 5 and got["s3", "o1"] == 20 and got["s2", "o0"] == 5
    assert spark.read.parquet(path).count() == 7


def test_a_table_is_replaced_in_one_write_and_stored_rows_are_not_written_again(spark, tmp_path, monkeypatch):
    made = []
    real = store.shared_folder
    monkeypatch.setattr(store, "shared_folder", lambda session, purpose: made.append(purpose) or real(session, purpose))
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, p string").write.partitionBy("p").parquet(path)
    old = spark.read.schema("k string, v int, p string").parquet(path)
    new = spark.createDataFrame([("b", 20, "y"), ("c", 3, "y")], "k string, v int, p string")
    store.replace_partitions(store.upsert(old.where("p = 'y'"), new, ["k"], ["v"], stored=True), path, ["p"])
    got = sorted(tuple(r) for r in spark.read.schema("k string, v int, p string").parquet(path).collect())
    assert got == [("a", 1, "x"), ("b", 20, "y"), ("c", 3, "y")] and made == []
    with pytest.raises(ValueError, match="comes twice"):
        store.upsert(old, new.unionByName(new), ["k"], ["v"], stored=True)
