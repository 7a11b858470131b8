"""Table schemas and the fixed retrieval constants."""
from pyspark.sql import types as T

CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("doc_id", T.StringType()),
    T.StructField("section_id", T.IntegerType()),
    T.StructField("modality", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("org_id", T.StringType()),
    T.StructField("file_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
CHUNK_COLUMNS = ["chunk_id", "doc_id", "section_id", "modality", "content", "metadata", "org_id", "file_id"]

EMBEDDING = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

FILE = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("org_id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("chunk_count", T.IntegerType()),
    T.StructField("error", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

ORG = T.StructType([
    T.StructField("org_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("config", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

CHAT_SESSION = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("org_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

SOURCE_CARD = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("modality", T.StringType()),
    T.StructField("expert_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

CHAT_MESSAGE = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("org_id", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("sources", T.ArrayType(SOURCE_CARD)),
    T.StructField("created_at", T.TimestampType()),
])

SECTION = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("tables", T.MapType(T.StringType(), T.StringType())),
    T.StructField("images", T.MapType(T.StringType(), T.StringType())),
    T.StructField("caption", T.StringType()),
])
CORPUS_RECORD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("sections", T.ArrayType(SECTION)),
])

# Retrieval constants that results depend on.
MODALITIES = ("text", "table", "image")
BASE_K = {"text": 30, "table": 30, "image": 20}
MODALITY_WEIGHT = {"text": 1.0, "image": 0.8}
RRF_K = 60
RERANK_TOP_N = 50
EVAL_KS = (1, 3, 5, 10)
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
CHUNK_CHARS, CHUNK_OVERLAP = 1800, 200
TABLE_ROWS_PER_GROUP = 5
MAX_IMAGES_PER_SECTION = 3
EMBED_DIM = 1024
