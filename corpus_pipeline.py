"""Corpus preparation in stages.  Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and
is written before the next one reads it."""
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontamination, near_dedup, packing, pseudonyms, quality_rules
from plumbline.llm.common import load, scratch, stage
from plumbline.llm.queries import PSEUDONYM_KEY, tokenizer_path


def whole(docs: DataFrame) -> Column:
    """The row as one value: whatever its columns are named, nothing of an operator clashes with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rule and the learned decision list.

    Every row is judged by its own text, also without doc_id or under a doc_id that comes again; repeated rows stay repeated.
    Null and empty texts fail the base rule and go; texts of any length are judged whole; an empty table stays empty.
    """
    rows = docs.select("doc_id", "text", whole(docs).alias("whole"))
    return quality_rules.judge(rows, load(spark, sf_dir, "labels"), row="whole").where("kept").select("whole.*")


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates.

    Rows under one doc_id with different texts are documents of their own; near copies among them leave one.  Of rows that
    repeat doc_id and text one is kept.  A row without doc_id is grouped with nothing else and kept, and so is a row with a
    null or empty text.  Texts of any length are compared whole; an empty table stays empty.

    Rows are told apart by 64 bits of doc_id and text while they are grouped (two of 100 million share them with probability
    3e-4), and by 128 bits more where one of a group is chosen.
    """
    text = F.coalesce(F.concat(F.lit("+"), F.col("whole.text")), F.lit("-"))
    same = F.concat(F.coalesce(F.col("whole.doc_id").cast("string"), F.lit("")), text)
    rows = docs.select(whole(docs).alias("whole")).select(F.xxhash64(same).alias("id"), F.md5(same).alias("same"), "whole")
    found = near_dedup.near_duplicates(rows.where("whole.doc_id is not null").select("id", "whole.text"), doc_id="id")
    found = found.where("n_shingles > 0").select(F.col("doc_id").alias("id"), F.col("component_id").cast("string").alias("near")).distinct()
    keys = rows.groupBy("id", "same").agg(F.min("whole.doc_id").alias("doc_id"), F.count("*").alias("n"))
    first = keys.join(found, "id", "left").groupBy(F.coalesce("near", "same")).agg(F.min(F.struct("doc_id", "same", "id", "n")).alias("first"))
    chosen = stage(first.select("first.id", "first.same", "first.n"), "chosen").hint("merge")  # grows with the documents: never broadcast
    once = rows.join(chosen.where("n = 1"), ["id", "same"], "left_semi")
    repeated = rows.join(chosen.where("n > 1"), ["id", "same"], "left_semi").dropDuplicates(["id", "same"])
    return once.unionByName(repeated).select("whole.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark passage by the contract's rule.

    Every row is judged by its own text, also without doc_id or under a doc_id that comes again; repeated rows stay repeated.
    Null and empty texts hold no passage and stay; texts of any length are searched whole; an empty table stays empty.
    """
    rows = docs.select("doc_id", "text", whole(docs).alias("whole"))
    found = decontamination.summary(decontamination.find_benchmark(rows, load(spark, sf_dir, "benchmark"), row="whole"), row="whole")
    return found.where(~F.col("contaminated")).select("whole.*")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars follows the new text.  Null texts stay null, empty ones empty, repeated rows repeated;
    texts of any length are read whole; an empty table stays empty."""
    new = pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)
    return new.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null or empty text is its end id alone, an empty table gives none.

    Chunks are held in less room than by the operator alone: workers come here with what earlier stages left in memory."""
    return packing.pack(docs, tokenizer_path(), held_bytes=48 << 20)


def tidy(step):
    """The step, before which what earlier steps staged is removed, unless ``docs`` still reads from it."""
    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch(docs):
            return step(spark, docs, sf_dir)
    return run_step


STAGES = [
    ("quality_rules", tidy(reject_low_quality)),
    ("near_dedup", tidy(keep_one_of_copies)),
    ("decontamination", tidy(drop_contaminated)),
    ("pseudonyms", tidy(replace_personal_data)),
    ("packing", tidy(pack_sequences)),
]

#: Rules are learned and signatures hashed: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
