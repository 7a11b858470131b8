"""The registered query of each operator, over whole tables."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    decontamination, html_extraction, language_id, merkle, near_dedup, packing, pseudonyms, quality_classifier, quality_rules, sql, suffix_dedup, url_filters, warc, whitening)
from plumbline.llm.common import load

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: The query's key; a corpus owner passes a secret of their own.
PSEUDONYM_KEY = "an example key"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and the text that is left; a character cut in two is U+FFFD there."""
    found = suffix_dedup.remove_repeats(load(spark, sf_dir, "documents"), with_kept=True)
    return found.withColumn("kept_text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.summary(decontamination.find_benchmark(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_path())


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filters.judge(load(spark, sf_dir, "pages"), rules)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(load(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(load(spark, sf_dir, "pages"))
    checked = found.withColumn("ok", F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.col("error")).cast("boolean")))
    return checked.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "ok")


def _of(kind: str):
    return lambda p: p["kind"] == kind


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritten text of every document and the number of pseudonyms of each kind."""
    found = pseudonyms.pseudonymise(load(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", *[F.size(F.filter("pseudonyms", _of(kind))).cast("long").alias(f"n_{kind}")
                                            for kind in pseudonyms.KINDS])


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(load(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(load(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (
    op1_suffix_dedup, op2_decontamination, op3_quality_classifier, op4_packing, op5_near_dedup, op6_quality_rules, op7_url_filters,
    op8_html_extraction, op9_warc, op10_pseudonyms, op11_merkle_manifest, op12_embedding_whitening,
    op13_language_id)}
SQL = {"op2_decontamination": sql.DECONTAMINATION, "op7_url_filters": sql.URL_FILTERS, "op9_warc": sql.WARC, "op11_merkle_manifest": sql.MANIFEST}
