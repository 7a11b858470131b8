"""Ordered arrays from groups of rows."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def collect_by_rank(rank: str, value: Column) -> Column:
    """Aggregate: values of a group by an integer rank.  Only the rank is compared, so values may hold maps."""
    pairs = F.collect_list(F.struct(F.col(rank).alias("r"), value.alias("v")))
    ordered = F.array_sort(pairs, lambda a, b: (a["r"] - b["r"]).cast("int"))
    return F.transform(ordered, lambda p: p["v"])
