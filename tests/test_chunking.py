import duckdb
from oracle_compare import compare
from pyspark.sql import functions as F

from plumbline.operators import chunking, models
from plumbline.sources import readers
from plumbline.workload.catalog import ENTRIES


def tables_of(spark, *texts):
    rows = [("d", 0, f"t{i}", t, "o", "f") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, section_id int, table_id string, table_text string, org_id string, "
                                       "file_id string")


def test_table_groups_shift_and_stop(spark):
    text = "| a | b | c |\n|---|---|---|\n| 1 |  | 3 |\n| 4 | 5 | 6 | 7 |\n\n| 8 |" + "\n| r | s | t |" * 3
    rows = {r.chunk_id: r for r in chunking.chunk_table(tables_of(spark, text)).collect()}
    assert set(rows) == {"d_s0_t0_r0", "d_s0_t0_r1"}
    assert rows["d_s0_t0_r0"].content == (
        "[TABLE] Columns: a, b, c.\na: 1 | b: 3\na: 4 | b: 5 | c: 6\na: 8\na: r | b: s | c: t\na: r | b: s | c: t"
        "\n\nMarkdown:\n| a | b | c |\n| 1 |  | 3 |\n| 4 | 5 | 6 | 7 |\n| 8 |\n| r | s | t |\n| r | s | t |")
    assert rows["d_s0_t0_r1"].metadata == {"table_id": "t0", "row_group": "1", "headers": '["a","b","c"]'}


def test_short_tables(spark):
    rows = chunking.chunk_table(tables_of(spark, " only  one line ", "h1 | h2\n---|---", "")).orderBy("chunk_id").collect()
    assert [r.content for r in rows] == ["[TABLE] only one line",
                                         "[TABLE] Columns: h1, h2.\n\n\nMarkdown:\nh1 | h2\n", "[TABLE] "]
    assert [r.metadata.get("row_group") for r in rows] == [None, "0", None]


def test_rows_without_whole_text_give_the_same_chunks(spark):
    n = 57
    rows = spark.range(n).select(
        F.lit("d").alias("doc_id"), F.lit(0).alias("section_id"), F.lit("t").alias("table_id"), F.lit("o").alias("org_id"),
        F.lit("f").alias("file_id"), (F.col("id") * 3).alias("no"), F.concat(F.lit("v"), "id").alias("x"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("a\nb"), "id")).alias("y"))
    keys = ["doc_id", "section_id", "table_id", "org_id", "file_id"]
    direct = chunking.chunk_table_rows(rows, "no", ["x", "y"], rows=10)
    whole = chunking.chunk_table(chunking.rows_to_markdown(rows, keys, "no", ["x", "y"], width=4))
    pick = lambda df: sorted((r.chunk_id, r.content, tuple(sorted(r.metadata.items()))) for r in df.collect())
    assert pick(direct) == pick(whole) and direct.count() == -(-n // 5)


def test_image_rules(spark):
    rows = [("logo of x", "short", "", "near"), ("A LOGO", "long enough text", "", ""), ("chart", "", "fig", "n" * 400),
            ("", "", "", ""), (None, None, "only", None)]
    df = spark.createDataFrame([("d", 1, f"i{i}", *r, "o", "f") for i, r in enumerate(rows)],
                               "doc_id string, section_id int, image_id string, caption string, ocr_text string, "
                               "fig_caption string, nearby_text string, org_id string, file_id string")
    kept = chunking.drop_decorative_images(df)
    assert kept.count() == 4 and chunking.drop_decorative_images(df, enabled=False).count() == 5
    chunks = {r.chunk_id: r for r in chunking.assemble_image_chunks(kept).collect()}
    assert set(chunks) == {"d_s1_i1", "d_s1_i2", "d_s1_i4"}
    assert chunks["d_s1_i2"].content == "[Caption]: chart [Figure caption]: fig [Context]: " + "n" * 300
    assert chunks["d_s1_i1"].metadata["has_ocr"] == "true" and chunks["d_s1_i4"].metadata["has_caption"] == "false"


def test_image_gate_counts_before_size(spark):
    df = spark.createDataFrame([("p", i, 10 if i == 1 else 40, 40) for i in range(5)],
                               "page string, image_no int, width int, height int")
    assert sorted(r.image_no for r in chunking.image_gate(df, ["page"]).collect()) == [0, 2]


def test_corpus_files(spark, tmp_path):
    (tmp_path / "corpus.json").write_text(
        '[{"id": "p1", "title": "T", "sections": [{"text": "One. Two.", "tables": {"t1": "a|b\\n1|2", "t2": " "},'
        ' "images": {"i0": "x", "i1": "", "i2": "y", "i3": "z"}, "caption": "C"}, {"text": ""}]}, {"title": "no id"}]')
    (tmp_path / "queries.json").write_text('{"q1": {"query": "x"}, "q2": {"query": "y", "type": "extractive"}}')
    (tmp_path / "qrels.json").write_text('{"q1": {"doc_id": "p1", "section_id": 0}}')
    (tmp_path / "answers.json").write_text('{"q1": "yes"}')
    sections = readers.read_corpus(spark, str(tmp_path / "corpus.json"))
    assert [(r.doc_id, r.section_id) for r in sections.orderBy("section_id").collect()] == [("p1", 0), ("p1", 1)]

    def describe(images):
        return models.describe_images_job(images, lambda: lambda some: [(f"cap {data}", 1 / 0 if data == "y" else "ocr") for data in some])

    got = {r.chunk_id: r.content for r in chunking.chunk_corpus(sections, describe).collect()}
    assert set(got) == {"p1_s0_t0", "p1_s0_t1_r0", "p1_s0_i0", "p1_s0_i2"}  # i1 is empty, i3 is the fourth
    assert got["p1_s0_i0"].startswith("[Caption]: cap x [OCR]: ocr") and "[Caption]" not in got["p1_s0_i2"]
    queries = {r.qid: (r.type, r.source) for r in readers.read_queries(spark, str(tmp_path / "queries.json")).collect()}
    assert queries == {"q1": ("abstractive", "text"), "q2": ("extractive", "text")}
    assert readers.read_qrels(spark, str(tmp_path / "qrels.json")).collect()[0].section_id == 0
    assert readers.read_answers(spark, str(tmp_path / "answers.json")).collect()[0].answer == "yes"


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff ok")
    (tmp_path / "b.CSV").write_text("x,y\n1,2")
    (tmp_path / "c.exe").write_text("no")
    (tmp_path / "d.png").write_text("no")
    got = {r.doc_id: r.text for r in readers.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "café  ok", "b.CSV": "x,y\n1,2"}
    good, bad = readers.accept_files(readers.read_files(spark, str(tmp_path)).select("path", "length"))
    assert good.count() == 2
    assert sorted(r.error for r in bad.collect()) == ["Unsupported file type: .exe", "Unsupported file type: .png"]


def test_corpus_chunk_rows_of_odd_documents(spark, tmp_path):
    texts = [None, "", " \n ", "a | b\nc | d\n--|--\ne", "|", "long. " * 700]
    rows = [(i, text, source) for i, (text, source) in enumerate((t, s) for t in texts for s in (None, "", " ", "logo"))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).coalesce(1).write.parquet(
        str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    entry = ENTRIES["corpus_chunk_rows"]
    n, _, problems = compare(entry.run(spark, str(tmp_path)), con, entry.sql)
    assert not problems and n > 3 * len(rows)
