"""Vector expressions over ``array<float>`` columns, computed in double."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine similarity of one pair of vectors.  Searches over many pairs use :mod:`plumbline.operators.dense`."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    return F.transform(
        F.arrays_zip(a.alias("x"), F.array_repeat(norm(a), F.size(a)).alias("n")),
        lambda p: F.when(p["n"] > 0, p["x"].cast("double") / p["n"]).otherwise(F.lit(0.0)).cast("float"))


def fit_dims(a: Column, dim: int) -> Column:
    """Zero-pad or cut to ``dim`` numbers."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def vector_to_text(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def vector_from_text(c: Column) -> Column:
    return F.from_json(c, "array<float>")


__all__ = ["dot", "norm", "cosine_similarity", "l2_normalize", "fit_dims", "vector_to_text", "vector_from_text", "let"]
