"""Readers of documents and evaluation files, and writers of results."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.schemas import CORPUS_RECORD
from plumbline.sources.json_objects import read_keyed

# Upload rules.
MAX_FILE_BYTES = 50 * 1024 * 1024
UPLOAD_EXTENSIONS = ("pdf", "csv", "txt", "md", "png", "jpg", "jpeg", "webp")
TEXT_EXTENSIONS = ("txt", "md", "csv")
PARSED_EXTENSIONS = ("pdf",) + TEXT_EXTENSIONS


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    name = file_name(path)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files with ``path, modificationTime, length, content``; content is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def accept_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted files, and refused ones as ``path, error``.  ``files``: ``path, length``."""
    kind = extension(F.col("path"))
    error = (F.when(~kind.isin(*UPLOAD_EXTENSIONS), F.concat(F.lit("Unsupported file type: ."), kind))
             .when(F.col("length") > MAX_FILE_BYTES, F.lit("File too large"))
             .when(~kind.isin(*PARSED_EXTENSIONS), F.concat(F.lit("Unsupported file type: ."), kind)))
    judged = files.withColumn("error", error)
    return judged.where(F.col("error").isNull()).drop("error"), judged.where(F.col("error").isNotNull()).select(
        "path", "error")


def text_of(files: DataFrame, org_id: str = "default") -> DataFrame:
    """Binary file rows → one section 0 per text file; bytes that are not UTF-8 are dropped."""
    texts = files.where(extension(F.col("path")).isin(*TEXT_EXTENSIONS))
    name = file_name(F.col("path"))
    # A file that is valid stays as it is.  In others invalid bytes decode to the replacement character, which is then
    # removed as a reader ignoring errors would; replacement characters the file itself holds are set aside meanwhile.
    raw = F.col("content").cast("string")
    aside = F.replace(raw, F.lit("\ufffd"), F.lit("\ufdd0"))
    mended = F.replace(F.replace(F.make_valid_utf8(aside), F.lit("\ufffd"), F.lit("")), F.lit("\ufdd0"), F.lit("\ufffd"))
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(mended)
    return texts.select(name.alias("doc_id"), F.lit(0).alias("section_id"), text.alias("text"),
                        F.lit(org_id).alias("org_id"), name.alias("file_id"))


def unread_files(files: DataFrame) -> DataFrame:
    """``path, error`` of accepted files that :func:`text_of` has no reader for; a caller's own reader takes them."""
    kind = extension(F.col("path"))
    return files.where(~kind.isin(*TEXT_EXTENSIONS)).select(
        "path", F.concat(F.lit("No reader for file type: ."), kind).alias("error"))


def read_text_files(spark: SparkSession, path: str, org_id: str = "default") -> DataFrame:
    """``.txt``, ``.md`` and ``.csv`` files, each as one whole text (a CSV file too)."""
    return text_of(read_files(spark, path), org_id)


def read_corpus(spark: SparkSession, path: str, org_id: str = "default", multi_line: bool = True) -> DataFrame:
    """Corpus JSON → one row per (document, section); the section number is the array position.

    ``multi_line`` reads a JSON array file; such a file is one task, so big corpora come as many files or as JSON lines.
    """
    records = spark.read.schema(CORPUS_RECORD).option("multiLine", multi_line).json(path)
    return (records.where(F.col("id").isNotNull())
            .select(F.col("id").alias("doc_id"), "title", F.posexplode("sections").alias("section_id", "s"))
            .select("doc_id", "title", "section_id", F.coalesce("s.text", F.lit("")).alias("text"), "s.tables",
                    "s.images", F.coalesce("s.caption", F.lit("")).alias("caption"), F.lit(org_id).alias("org_id"),
                    F.col("doc_id").alias("file_id")))


def keyed_json(df: DataFrame, text: Column, value: T.DataType) -> DataFrame:
    """JSON objects keyed by query id → ``qid, v``."""
    return df.select(F.explode(F.from_json(text, T.MapType(T.StringType(), value))).alias("qid", "v"))


QUERY_VALUE = T.StructType([T.StructField(c, T.StringType()) for c in ("query", "type", "source")])
QREL_VALUE = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("section_id", T.IntegerType())])


def query_rows(keyed: DataFrame) -> DataFrame:
    return keyed.select("qid", "v.query", F.coalesce("v.type", F.lit("abstractive")).alias("type"),
                        F.coalesce("v.source", F.lit("text")).alias("source"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return query_rows(read_keyed(spark, path, QUERY_VALUE))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return read_keyed(spark, path, QREL_VALUE).select("qid", "v.doc_id", "v.section_id")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return read_keyed(spark, path, T.StringType()).select("qid", F.col("v").alias("answer"))


def write_results(summary: DataFrame, per_query: DataFrame, path: str) -> None:
    """Run summary as JSON and per-query metrics as CSV with header."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    per_query.write.mode("overwrite").option("header", True).csv(f"{path}/per_query")
