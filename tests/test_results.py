"""Model calls counted: each distinct input once, through repeated rows, later runs and a run that fails midway."""
import numpy as np
import pytest

from plumbline.operators import models, results


def test_each_text_is_asked_once(spark, tmp_path):
    path, calls = str(tmp_path / "vectors"), spark.sparkContext.accumulator(0)

    def load():
        def embed(texts):
            calls.add(len(texts))
            return np.array([[len(t), t.count("a") + 1.0] for t in texts])
        return embed

    rows = [(i, "a" * (i % 7 + 1) if i % 10 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, content string").repartition(4)
    got = results.embed_once(df, path, "m", load, dim=2, round_rows=3)
    first = {r["id"]: r["embedding"] for r in got.collect()}
    assert calls.value == 7 and got.count() == 60 and calls.value == 7
    plain = {r["id"]: r["embedding"] for r in models.embed_job(df.where("content is not null"), load, dim=2).collect()}
    assert {i: v for i, v in first.items() if v is not None} == plain and {i for i, v in first.items() if v is None} == set(range(0, 60, 10))
    calls.value = 0
    more = df.unionByName(spark.createDataFrame([(99, "new"), (98, "new")], df.schema))
    assert results.embed_once(more, path, "m", load, dim=2).count() == 62 and calls.value == 1
    results.embed_once(df, path, "other model", load, dim=2).count()
    assert calls.value == 8


def test_a_run_that_fails_midway_keeps_its_rounds(spark, tmp_path):
    path, flag, calls = str(tmp_path / "answers"), tmp_path / "mended", spark.sparkContext.accumulator(0)
    place = str(flag)

    def load():
        import os

        def reply(texts):
            calls.add(len(texts))
            if "q13" in texts and not os.path.exists(place):
                raise RuntimeError("model died")
            return [t.upper() for t in texts]
        return reply

    df = spark.createDataFrame([(f"q{i}",) for i in range(40)], "prompt string").coalesce(2)
    with pytest.raises(Exception, match="model died"):
        results.reply_once(df, path, "m", load, round_rows=4)
    kept = results.stored_results(spark, path, spark.read.parquet(*[str(p) for p in (tmp_path / "answers").iterdir() if (p / "_SUCCESS").exists()]).schema).count()
    assert 0 < kept < 40
    flag.write_text("")
    calls.value = 0
    got = {r["prompt"]: r["answer"] for r in results.reply_once(df, path, "m", load, round_rows=4).collect()}
    assert got == {f"q{i}": f"Q{i}" for i in range(40)} and calls.value == 40 - kept
