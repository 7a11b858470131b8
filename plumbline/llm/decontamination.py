"""Benchmark decontamination: Wu-Manber search for all benchmark windows in every document.

The alphabet is words.  Windows of one length form one search: a shift table over blocks of two words tells how far the
scan may jump, blocks with shift 0 select a bucket of windows, the first word filters it and a comparison confirms.
"""
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from plumbline.llm.common import pick

WINDOW = 13
#: A-Z become a-z, digits, a-z and every byte of a non-ASCII character stay, all else parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


class Search:
    """Wu-Manber tables of the windows of one length."""

    def __init__(self, length: int, windows: list[tuple[list[bytes], int, str]]):
        self.length, self.block = length, min(2, length)
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[bytes, list]] = {}
        for words, start, item in windows:
            for end in range(self.block, length + 1):
                key = tuple(words[start + end - self.block:start + end])
                self.shift[key] = min(self.shift.get(key, length), length - end)
            self.buckets.setdefault(key, {}).setdefault(words[start], []).append((words[start:start + length], item))

    def scan(self, words: list[bytes], found: list[tuple[int, int]], items: set[str]) -> None:
        at, n, length, shift = self.length - 1, len(words), self.length, self.shift
        jump, pair = length - self.block + 1, self.block == 2
        while at < n:
            key = (words[at - 1], words[at]) if pair else (words[at],)
            step = shift.get(key, jump)
            if step:
                at += step
                continue
            first = at - length + 1
            for window, item in self.buckets[key].get(words[first], ()):
                if words[first:at + 1] == window:
                    found.append((first, at + 1))
                    items.add(item)
            at += 1


def searches(benchmark: list[tuple[str, bytes]], window: int) -> list[Search]:
    """One search per window length; an item with fewer words than a window is one window."""
    by_length: dict[int, list] = {}
    for item, text in benchmark:
        words = words_of(text)
        length = min(window, len(words))
        for start in range(len(words) - length + 1 if length else 0):
            by_length.setdefault(length, []).append((words, start, item))
    return [Search(n, w) for n, w in sorted(by_length.items())]


def _merged(found: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts, ends = [], []
    for a, b in sorted(found):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _scan(docs: DataFrame, benchmark: list[tuple[str, bytes]], window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(benchmark)
    own = [f for f in docs.schema.fields if f.name not in ("doc_id", "_text_hash", "text")]
    numbers = ArrayType(IntegerType())
    schema = StructType([StructField("doc_id", LongType()), StructField("_text_hash", LongType()), StructField("n_words", LongType()),
                         StructField("starts", numbers), StructField("ends", numbers), StructField("items", ArrayType(StringType())), *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = searches(shared.value, window)
        for batch in batches:
            n_words, starts, ends, items = [], [], [], []
            for value in batch.column("text"):
                words, found, seen = words_of(value.as_py()), [], set()
                for t in tables:
                    t.scan(words, found, seen)
                s, e = _merged(found)
                n_words.append(len(words))
                starts.append(s)
                ends.append(e)
                items.append(sorted(seen))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_text_hash"), pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())),
                 pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), *(batch.column(f.name) for f in own)],
                schema.names)

    return docs.mapInArrow(run, schema)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                   group_bytes: int = 16 << 20, row: str | None = None) -> DataFrame:
    """One row per document row: doc_id, n_words, the hit word runs (``starts``, ``ends``) and the ids of the ``items``
    with an occurring window.

    Only ``group_bytes`` of benchmark text are broadcast at a time: a larger benchmark is cut into groups by item, each
    searched over all documents, and the hits are merged.  Null or empty texts have no words and no hits; items without
    words are never found; a null item id is written as an empty string; a repeated item counts once; repeated
    documents give repeated rows; texts of any length are searched whole; an empty table of either kind gives no hits.
    A column named by ``row`` is handed on; others are not read.
    """
    own = [row] if row else []
    docs = pick(docs, doc_id=doc_id, _text=text, **{c: c for c in own}).select(
        F.col("doc_id").cast("long"), F.col("_text").cast("binary").alias("text"), F.xxhash64("_text").alias("_text_hash"), *own)
    bench = pick(benchmark, item=item_id, text=item_text).select(
        F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    bench = bench.where("text is not null").distinct()
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n_groups = max(1, -(-size // group_bytes))

    def group(i: int) -> list[tuple[str, bytes]]:
        rows = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_groups)) == i)
        return [(r["item"], bytes(r["text"])) for r in rows.collect()]  # about group_bytes

    first = _scan(docs, group(0), window)
    if n_groups == 1:
        return first.drop("_text_hash")
    hits = first.where(F.size("starts") > 0)
    for i in range(1, n_groups):
        hits = hits.unionByName(_scan(docs, group(i), window).where(F.size("starts") > 0))  # one more pass over the documents
    runs = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    merged = hits.groupBy("doc_id", "_text_hash").agg(runs.alias("runs"), F.array_sort(
        F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"))
    ordered = F.aggregate(F.array_sort("runs"), F.array().cast("array<struct<starts:int,ends:int>>"), lambda acc, r: F.when(
        (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["ends"] >= r["starts"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.get(acc, F.size(acc) - 1)["starts"].alias("starts"),
            F.greatest(F.get(acc, F.size(acc) - 1)["ends"], r["ends"]).alias("ends"))))).otherwise(
        F.concat(acc, F.array(F.struct(r["starts"].alias("starts"), r["ends"].alias("ends"))))))
    merged = merged.select(F.col("doc_id").alias("_doc"), F.col("_text_hash").alias("_hash"), ordered.alias("_runs"), "_items")
    none = F.array()
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash"))
    return first.join(merged, same, "left").select(
        "doc_id", "n_words", F.coalesce("_runs.starts", none.cast("array<int>")).alias("starts"),
        F.coalesce("_runs.ends", none.cast("array<int>")).alias("ends"), F.coalesce("_items", none.cast("array<string>")).alias("items"), *own)


def summary(found: DataFrame, row: str | None = None) -> DataFrame:
    """Counts, item digest and verdict: contaminated from five words in a hundred.  A column named by ``row`` is handed on."""
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.withColumn("n_hit", n_hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *([row] if row else []))
