"""URL filters: host-suffix and path-prefix expressions matched by short hash prefix, confirmed by full digest."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import let
from plumbline.llm.common import pick

PREFIX_HEX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def expressions(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Host suffixes at dots times path prefixes of the lengths that rules have: array of (expr, host_chars)."""
    suffixes = let(F.split(host, r"\."), lambda parts: F.transform(
        parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), ".")))
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in path_lengths]).cast("array<int>"),
                                    lambda n: F.when(F.length(path) >= n, F.substring(path, F.lit(1), n))), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(
        prefixes, lambda p: F.struct(F.concat(s, F.lit("/"), p).alias("expr"), F.length(s).alias("host_chars")))))


def digests(rules: DataFrame) -> DataFrame:
    """Rules (host, path, action) as rows keyed by digest.  Hosts are lower-cased; a rule without a host is ignored, a
    null path is empty; of equal rules with several actions ``block`` wins.  A slash, which no host holds, parts host and path
    under the digest: a path without a leading slash fits no URL."""
    known = rules.where("host is not null and action is not null").select(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    return (known.groupBy("host", "path").agg(F.max("action").alias("action"))
            .withColumn("rule", F.concat("host", "path")).withColumn("digest", F.sha2(F.concat("host", F.lit("/"), "path"), 256))
            .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX)))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
          default: str = "allow") -> DataFrame:
    """One row per page: page_id, url, host, path, the fitting rule (null if none) and the verdict.

    The longest fitting rule wins; of two as long, the one with the longer host.  Every distinct URL is judged once, so
    that copies of a URL meet the rules once; Spark broadcasts the rules only below its own size limit.  Null or
    malformed URLs have empty host and path.  Repeated pages give repeated rows; an empty rule table allows all, an empty page
    table gives no rows.  URLs of any length are judged whole; further columns, whatever their names, are not read.
    """
    pages = pick(pages, page_id=page_id, url=url)
    rules = digests(rules)
    # one row of distinct lengths, at most as many as the longest rule path has characters
    lengths = rules.agg(F.collect_set(F.length("path"))).first()[0]
    urls = pages.select(F.coalesce("url", F.lit("")).alias("url")).distinct()
    parts = urls.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    asked = (parts.select("url", F.explode(expressions(F.col("host"), F.col("path"), sorted(lengths))).alias("e"))
             .select("url", "e.host_chars", F.sha2("e.expr", 256).alias("asked"))
             .withColumn("prefix", F.substring("asked", 1, PREFIX_HEX)))
    found = (asked.join(rules.drop("host", "path"), "prefix").where(F.col("asked") == F.col("digest"))
             .groupBy("url").agg(F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), "host_chars", "rule")).alias("r")))
    return (pages.withColumn("_url", F.coalesce("url", F.lit("")))
            .join(found.withColumnRenamed("url", "_url"), "_url", "left")
            .select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
                    F.col("r.rule").alias("rule"), F.coalesce("r.action", F.lit(default)).alias("verdict")))
