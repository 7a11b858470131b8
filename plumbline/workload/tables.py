"""The test tables seen as the retrieval data model."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import clean_text
from plumbline.operators import chunking
from plumbline.operators.passages import verbatim_places
from plumbline.operators.postings import Postings, write_postings
from plumbline.plans.retrieval import RetrievalIndex, write_counts, write_index
from plumbline.schemas import CHUNK_COLUMNS
from plumbline.session import shared_folder, spread

DIM = 128
ORG = "default"
_indexes: dict[tuple[str, str], RetrievalIndex] = {}
_counts: dict[tuple[str, str], tuple[DataFrame, DataFrame, DataFrame]] = {}
_postings: dict[tuple[str, str], Postings] = {}
_qrels: dict[tuple[str, str], DataFrame] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_sections(spark: SparkSession, sf_dir: str, org: str | None = ORG) -> DataFrame:
    """Documents as one section each; the tenant is ``org`` or, when None, the language."""
    doc = F.col("doc_id").cast("string")
    return spread(load(spark, sf_dir, "documents")).select(
        doc.alias("doc_id"), F.lit(0).alias("section_id"), "text",
        (F.lit(org) if org else F.col("lang")).alias("org_id"), doc.alias("file_id"), "lang", "source")


def text_chunks(spark: SparkSession, sf_dir: str, org: str | None = ORG) -> DataFrame:
    return chunking.chunk_text(text_sections(spark, sf_dir, org))


def table_rows(df: DataFrame, name: str, row_no: str, columns: dict) -> DataFrame:
    """A relational table as the rows of one document table."""
    return df.select(F.lit(name).alias("doc_id"), F.lit(0).alias("section_id"), F.lit("tbl0").alias("table_id"),
                     F.lit(ORG).alias("org_id"), F.lit(name).alias("file_id"), F.col(row_no).alias("row_no"),
                     *[F.expr(e).alias(c) for c, e in columns.items()])


PART_COLUMNS = {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size"}
SUPPLIER_COLUMNS = {"name": "s_name", "nation": "s_nationkey", "balance": "cast(s_acctbal as decimal(12,2))"}


def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table_rows(spread(load(spark, sf_dir, "part")), "part", "p_partkey", PART_COLUMNS)
    supplier = table_rows(spread(load(spark, sf_dir, "supplier")), "supplier", "s_suppkey", SUPPLIER_COLUMNS)
    return chunking.chunk_table_rows(part, "row_no", list(PART_COLUMNS)).unionByName(
        chunking.chunk_table_rows(supplier, "row_no", list(SUPPLIER_COLUMNS)))


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image description per page: title, banner text, heading and page text stand in for caption, OCR, figure
    caption and context."""
    doc = F.concat(F.lit("page"), F.col("page_id").cast("string"))
    inner = lambda tag: F.regexp_extract("html", tag, 1)
    return spread(load(spark, sf_dir, "pages")).select(
        doc.alias("doc_id"), F.lit(0).alias("section_id"), F.lit("img0").alias("image_id"),
        inner("<title>(.*?)</title>").alias("caption"), inner('<div class="ad">(.*?)</div>').alias("ocr_text"),
        inner("<h1>(.*?)</h1>").alias("fig_caption"),
        F.substring(clean_text(F.regexp_replace("html", "<[^>]*>", " ")), 1, 400).alias("nearby_text"),
        F.lit(ORG).alias("org_id"), doc.alias("file_id"))


def image_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.assemble_image_chunks(chunking.drop_decorative_images(page_images(spark, sf_dir)))


def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, table and image chunks of one tenant."""
    parts = [text_chunks(spark, sf_dir), table_chunks(spark, sf_dir), image_chunks(spark, sf_dir)]
    chunks = parts[0].select(*CHUNK_COLUMNS)
    for part in parts[1:]:
        chunks = chunks.unionByName(part.select(*CHUNK_COLUMNS))
    return chunks


def index(spark: SparkSession, sf_dir: str) -> RetrievalIndex:
    """The stored index of :func:`corpus_chunks`, built once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = write_index(corpus_chunks(spark, sf_dir), shared_folder(spark, "index"), dim=DIM)
    return _indexes[key]


def counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forward index, corpus and term statistics of :func:`index`, or of their own where only a sparse search needs them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _indexes:
        found = _indexes[key]
        return found.forward, found.corpus_stats, found.term_stats
    if key not in _counts:
        _counts[key] = write_counts(corpus_chunks(spark, sf_dir), shared_folder(spark, "counts"))
    return _counts[key]


def postings(spark: SparkSession, sf_dir: str) -> Postings:
    """Stored posting blocks of :func:`counts`, in small parts as the test tables are small."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _postings:
        _postings[key] = write_postings(counts(spark, sf_dir)[0], shared_folder(spark, "postings"), bucket_chunks=128, part_entries=50_000)
    return _postings[key]


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("qid"), F.lit(ORG).alias("org_id"), F.col("text").alias("query"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored :func:`find_qrels`, found once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _qrels:
        path = shared_folder(spark, "qrels")
        find_qrels(spark, sf_dir).write.parquet(path)
        _qrels[key] = spark.read.parquet(path)
    return _qrels[key]


def find_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, doc_id, section_id``: documents that contain the query text verbatim."""
    docs = text_sections(spark, sf_dir).select("doc_id", "section_id", "text")
    return verbatim_places(queries(spark, sf_dir).select("qid", "query"), docs)


def described_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with the columns evaluation groups by: ``type`` by length, ``source`` of the first gold document."""
    items = queries(spark, sf_dir)
    docs = text_sections(spark, sf_dir).select("doc_id", "source")
    gold = qrels(spark, sf_dir).groupBy("qid").agg(F.min("doc_id").alias("doc_id"))
    sources = docs.join(gold, "doc_id").select("qid", "source")
    return items.join(sources, "qid", "left").withColumn(
        "type", F.when(F.length("query") > 250, "extractive").otherwise("abstractive"))
