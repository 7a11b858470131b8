"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A factorisation machine adds a product term for every pair of features, with weights from low-rank factors; the sum over
all pairs is taken in linear time as half of (square of sum - sum of squares) per factor.  Spark ML trains and scores it.
"""
from dataclasses import dataclass

from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import occurrences, pick, stage

SPACE = r"\x20\x09-\x0D"
HASHED = 1 << 12
STATISTICS = ("symbols", "upper", "marks", "same_next", "distinct", "word_length", "length", "short")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def features(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``features``: word counts hashed to HASHED places and scaled to length 1, and statistics between 0 and 1."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.lower(t), f"[{SPACE}]+"), lambda w: w != "")
    n = F.size("_words")
    per_word = lambda c, most=1.0: F.least(c.cast("double") / F.greatest(n, F.lit(1)) / most, F.lit(1.0))
    same = F.size(F.filter(F.transform("_words", lambda w, i: F.get("_words", i - 1) == w), lambda x: x))
    chars = F.greatest(F.length(t), F.lit(1))
    statistics = {
        "symbols": per_word(occurrences(t, r"#*$%&|<>")), "upper": occurrences(t, r"\p{Lu}") / chars,
        "marks": per_word(occurrences(t, "!?")), "same_next": per_word(same),
        "distinct": per_word(F.size(F.array_distinct("_words"))), "word_length": per_word(F.length(t), 20.0),
        "length": F.least(F.log1p(n.cast("double")) / 12, F.lit(1.0)), "short": F.exp(-n.cast("double") / 30)}
    rows = docs.withColumn("_words", words).withColumns({f"_{k}": v.cast("double") for k, v in statistics.items()})
    rows = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=HASHED).transform(rows)
    rows = Normalizer(inputCol="_tf", outputCol="_unit").transform(rows)
    rows = VectorAssembler(inputCols=["_unit", *[f"_{k}" for k in STATISTICS]], outputCol="features").transform(rows)
    return rows.drop("_words", "_tf", "_unit", *[f"_{k}" for k in STATISTICS])


@dataclass
class Classifier:
    """A trained machine, or the share of good labels where only one class (or none) was seen."""
    model: FMClassificationModel | None
    share: float

    def score(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            return rows.withColumn("score", F.lit(self.share))
        out = self.model.transform(rows)
        return out.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop(
            "rawPrediction", "probability", "prediction")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, iterations: int = 80, step: float = 0.1,
          factors: int = 4, regularisation: float = 1e-4) -> Classifier:
    """Fit on labelled rows that are not held out, about ``max_labelled`` of them: ids whose hash falls below the share that
    this bound is of all such labels.  Fewer labels are all used."""
    good = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    good = good.groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    n, mean = good.agg(F.count("*"), F.avg("label")).first()
    if not n or mean in (0.0, 1.0):
        return Classifier(None, float(mean) if n else 0.5)
    below = int(1_000_000 * min(1.0, max_labelled / n))
    chosen = lambda df: df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < below)
    rows = chosen(docs.where("doc_id is not null").where(~held_out(F.col("doc_id")))).join(chosen(good), "doc_id")
    rows = stage(features(rows, "_text").select("label", "features"), "training")
    machine = FMClassifier(factorSize=factors, maxIter=iterations, stepSize=step, regParam=regularisation, initStd=0.01, tol=1e-7, seed=11)
    return Classifier(machine.fit(rows), float(mean))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality",
             threshold: float = 0.7, **training) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Labels serve training only; language, source and doc_id are never inputs.  Null and empty texts are scored by their
    statistics alone.  Repeated rows are scored each; a document with several labels counts as bad if any is 0.  With one
    class or no label every score is the share of good labels (0.5 without labels).
    """
    docs = pick(docs, doc_id=doc_id, _text=text)
    machine = train(docs, pick(labels, doc_id=doc_id, quality=quality), **training)
    scored = machine.score(features(docs, "_text"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
