"""Change logs over a base against a table kept in a dict, through deletes, compactions and batches that run again."""
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources import merge_table, store

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("p", T.StringType()), T.StructField("fixed", T.IntegerType()), T.StructField("v", T.IntegerType())])


def bytes_below(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def rows(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_a_history_of_changes(spark, tmp_path):
    table = merge_table.MergeTable(spark, str(tmp_path), SCHEMA, ("k",), ("v",), ("p",))
    rng, model = random.Random(2), {}
    assert rows(table) == [] and table.last() == -1
    for seq in range(9):
        keys = rng.sample(range(14), 6)
        if seq % 3 == 2:
            table.delete(spark.createDataFrame([(f"k{i}",) for i in keys + keys[:1]], "k string"), seq)
            for i in keys:
                model.pop(f"k{i}", None)
        else:
            batch = [(f"k{i}", "ab"[i % 2], 100 * seq + i, seq) for i in keys]
            for _ in range(2):  # runs again
                table.upsert(spark.createDataFrame(batch, SCHEMA), seq)
            for k, p, fixed, v in batch:
                model[k] = (*model[k][:3], v) if k in model else (k, p, fixed, v)
        if seq in (3, 6):
            table.compact()
        assert rows(table) == sorted(model.values()), seq
    with pytest.raises(ValueError, match="later"):
        table.upsert(spark.createDataFrame([], SCHEMA), 7)
    with pytest.raises(Exception, match="twice"):
        table.upsert(spark.createDataFrame([("x", "a", 1, 1), ("x", "a", 2, 2)], SCHEMA), 20)


def test_a_change_costs_what_it_changes(spark, tmp_path):
    table = merge_table.MergeTable(spark, str(tmp_path), SCHEMA, ("k",), ("v",), ("p",))
    first = spark.range(60_000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("a").alias("p"), F.col("id").cast("int").alias("fixed"), (F.col("id") * 7919 % 100_003).cast("int").alias("v"))
    table.upsert(first, 0)
    table.compact()
    before = bytes_below(tmp_path)
    change = spark.createDataFrame([("k5", "a", -1, 77), ("new", "a", 1, 2)], SCHEMA)
    table.upsert(change, 1)
    assert bytes_below(tmp_path) - before < 20_000 < before / 10
    got = table.read()
    want = store.upsert(first, change, ["k"], ["v"])
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == 60_001
    assert got.where("k = 'k5'").first() == ("k5", "a", 5, 77)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
