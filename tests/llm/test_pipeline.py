"""The pipeline's stages against their operators run by hand on a small copy of the tables."""
import corpus_pipeline as cp
from plumbline.llm import decontamination, near_dedup, quality_rules
from plumbline.llm.common import load, stage

SF_DIR = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = load(spark, SF_DIR, "documents")
    columns, names = docs.columns, [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "pseudonyms", "packing"]
    for name, step in cp.STAGES[:-1]:
        after = stage(step(spark, docs, SF_DIR), name)
        assert after.columns == columns
        if name == "quality_rules":
            judged = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, load(spark, SF_DIR, "labels")).collect()}
            assert ids(after) == sorted(i for i, kept in judged.items() if kept)
            clean = load(spark, SF_DIR, "labels").where("quality = 1").join(docs.where("n_chars > 800"), "doc_id", "left_semi")
            assert set(ids(clean)) <= set(ids(after))
        if name == "near_dedup":
            assert ids(after) == ids(near_dedup.near_duplicates(docs).where("kept"))
        if name == "decontamination":
            assert ids(after) == ids(decontamination.summary(decontamination.find_benchmark(docs, load(spark, SF_DIR, "benchmark"))).where("not contaminated"))
        if name == "pseudonyms":
            assert ids(after) == ids(docs) and after.where("n_chars <> length(text)").count() == 0
        docs = after
    packed = cp.STAGES[-1][1](spark, docs, SF_DIR)
    assert sorted(set(ids(packed))) == ids(docs)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` < 2048").count() <= 1


def rows_of(df):
    return sorted((str(r["doc_id"]), str(r["text"])) for r in df.select("doc_id", "text").collect())


def odd_rows(spark, bad):
    """Clean texts and a bad one without doc_id, under one doc_id, and repeated."""
    docs = load(spark, SF_DIR, "documents")
    good = [r["text"] for r in docs.join(load(spark, SF_DIR, "labels").where("quality = 1"), "doc_id", "left_semi").where("n_chars > 800").orderBy("doc_id").collect()]
    kept = rows_of(decontaminated(spark, cp.reject_low_quality(spark, docs, SF_DIR)))
    a, b, c, d = [t for t in dict.fromkeys(good) if any(t == k for _, k in kept)][:4]
    rows = [(None, a), (7, b), (7, bad), (8, c), (8, c), (None, bad), (9, d), (None, a), (10, None), (None, None)]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema


def decontaminated(spark, docs):
    return cp.drop_contaminated(spark, docs, SF_DIR)


def test_rows_without_doc_id_and_repeated_ones_are_judged_by_their_own_text(spark):
    rows, schema = odd_rows(spark, "x")
    after = rows_of(cp.reject_low_quality(spark, spark.createDataFrame(rows, schema), SF_DIR))
    assert after == sorted((str(i), t) for i, t, *_ in rows if t not in ("x", None))
    passage = load(spark, SF_DIR, "benchmark").first()["text"]
    rows, schema = odd_rows(spark, passage)
    after = rows_of(decontaminated(spark, spark.createDataFrame(rows, schema)))
    assert after == sorted((str(i), str(t)) for i, t, *_ in rows if t != passage)


def test_one_of_repeated_rows_is_kept(spark):
    word = [f"w{i}" for i in range(200)]
    x, y, z = " ".join(word), " ".join(reversed(word)), " ".join(word[::3] * 3)
    rows = [(7, x), (7, y), (3, x + " end"), (8, z), (8, z), (None, x), (None, x), (None, y), (9, y), (5, ""), (6, None), (6, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], load(spark, SF_DIR, "documents").schema)
    after = cp.keep_one_of_copies(spark, docs, SF_DIR)
    assert after.columns == docs.columns
    assert rows_of(after) == sorted((str(i), str(t)) for i, t in [(3, x + " end"), (7, y), (8, z), (None, x), (None, y), (5, ""), (6, None), (None, None)])


def test_long_texts_and_clashing_columns(spark):
    passage, text = load(spark, SF_DIR, "benchmark").first()["text"], load(spark, SF_DIR, "documents").where("n_chars > 3000").orderBy("doc_id").first()["text"]
    other = " ".join(f"word{i}" for i in range(120_000))  # a MB
    rows = [(1, text), (2, other), (3, other + " end"), (4, passage), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own", "k", -1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, whole string, _row_key string, id long")
    for name, step in cp.STAGES[:-1]:
        after = stage(step(spark, docs, SF_DIR), name)
        assert after.columns == docs.columns and after.where("whole = 'own' and _row_key = 'k' and id = -1").count() == after.count(), name
    assert set(ids(cp.reject_low_quality(spark, docs, SF_DIR))) <= {1, 2, 3, 4}
    assert ids(cp.keep_one_of_copies(spark, docs, SF_DIR)) == [1, 2, 4, 5, 6]
    assert ids(decontaminated(spark, docs)) == [1, 2, 3, 5, 6]


def test_no_rows(spark):
    docs = load(spark, SF_DIR, "documents").limit(0)
    for name, step in cp.STAGES:
        assert step(spark, docs, SF_DIR).count() == 0, name
