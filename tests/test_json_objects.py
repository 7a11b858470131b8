"""Keyed JSON of any layout, cut at any byte, equals json.load."""
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources import json_objects, readers

VALUE = T.StructType([T.StructField("query", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])


def objects():
    rng = random.Random(5)
    parts = ['"', "\\", ",", "{", "}", "[", "]", ":", " ", "\n", "é", "x", '","', '\\"', "😀".encode("utf-16", "surrogatepass").decode("utf-16")]
    text = lambda n: "".join(rng.choice(parts) for _ in range(rng.randrange(n)))
    return {f"{i}{text(4)}": {"query": text(40), "tags": [text(6) for _ in range(rng.randrange(4))]} for i in range(80)}


@pytest.mark.parametrize("split", [64, 1000, 1 << 27])
@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_any_split(spark, tmp_path, split, layout):
    data = objects()
    (tmp_path / "q.json").write_text(json.dumps(data, **layout), encoding="utf-8")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", split)
        tasks = spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions()
        found = json_objects.read_keyed(spark, str(tmp_path), VALUE).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert (tasks > 1) == (split < 1 << 27)
    assert len(found) == len(data)
    assert {r.qid: r.v.asDict() for r in found} == data


def test_edges(spark, tmp_path):
    for name, text in {"a": "{}", "b": ' {\n} ', "c": '{"k": "1,2"}', "d": '{"r": "old", "s": null, "r": "new"}', "e": ""}.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = sorted((r.qid, r.v) for r in json_objects.read_keyed(spark, str(tmp_path), T.StringType()).collect())
    assert found == [("k", "1,2"), ("r", "new"), ("s", None)]


def test_written_and_read(spark, tmp_path):
    df = spark.range(0, 200, numPartitions=3).select(F.col("id").alias("n"), F.concat(F.lit('a,"}'), F.col("id")).alias("query"))
    json_objects.write_keyed(df, "n", F.struct("query"), str(tmp_path / "q"))
    assert all(json.loads(f.read_text()) for f in (tmp_path / "q").glob("part-*"))
    assert {r.qid: r["query"] for r in readers.read_queries(spark, str(tmp_path / "q")).collect()} == {str(i): f'a,"}}{i}' for i in range(200)}
