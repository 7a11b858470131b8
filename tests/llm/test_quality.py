import random
import re

from pyspark.sql import functions as F

from plumbline.llm import quality_classifier as qc
from plumbline.llm import quality_rules as qr

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"
WORD = re.compile("[^\x20\x09-\x0D]+")


def corpus():
    random.seed(3)
    words = [f"w{random.randint(0, 400)}" for _ in range(3000)]
    rows, labels = [], []
    for i in range(240):
        own = random.sample(words, random.randint(60, 120))
        if i % 4 == 0:
            own = [w + random.choice(["***", "###", "%%%"]) for w in own]
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 4 != 0), 0))
    long_text = "\n".join(f"line {i % 700} of a very long text" for i in range(4000))
    odd = [(500, None), (501, ""), (502, " \n\t "), (503, "one"), (504, "a b c a b c\na b c\n\na b c"), (505, long_text), (None, rows[1][1]), (1, rows[1][1]),
           (506, "same " * 80), (507, "tab\tsep\x0bvert\x0cfeed\rret é\u00a0x \u2003y")]
    return rows + odd, labels + [(1, 1, 0), (2, None, 0), (None, 0, 0), (9999, 0, 1)]


def base_by_hand(text):
    t = text or ""
    words = WORD.findall(t)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeated = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated))


def test_counts_and_verdict(table):
    rows, labels = corpus()
    out = qr.judge(table(rows, DOCS), table(labels, LABELS)).collect()
    got = sorted((str(r["doc_id"]), *(r[c] for c in qr.BASE)) for r in out)
    assert got == sorted((str(i), *base_by_hand(t)) for i, t in rows)
    for r in out:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
        if r["doc_id"] is not None and r["doc_id"] < 240:
            assert r["kept"] == (r["doc_id"] % 4 != 0)


def test_without_labels_or_rows(table):
    rows, labels = corpus()
    kept = qr.judge(table(rows[:8], DOCS), table([], LABELS)).where("kept").count()
    assert kept == 8
    assert qr.judge(table([], DOCS), table(labels, LABELS)).count() == 0


def test_rules_are_conditions(spark):
    random.seed(1)
    stats = []
    for i in range(400):
        marks, upper = random.randint(0, 100), random.randint(0, 300)
        stats.append((100, 500, 0, 0, 0, 10, marks, upper, 0, marks >= 30 and upper >= 100, i % 3 == 0))
    schema = ", ".join(f"{c} long" for c in qr.COUNTS) + ", bad boolean, prune boolean"
    rules = qr.learn(spark.createDataFrame(stats, schema))
    assert len(rules) == 1 and {f for f, _, _ in rules[0].conditions} == {"marks_per_word", "upper_share"}
    assert "and" in str(rules[0])


def test_plan_is_native(spark, table):
    rows, labels = corpus()
    plan = qr.judge(table(rows, DOCS), table(labels, LABELS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_factorisation_machine(table):
    rows, labels = corpus()
    out = qc.classify(table(rows, DOCS), table(labels, LABELS), iterations=40)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(rows)
    assert out.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0
    assert out.where(F.col("held_out") != F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))).count() == 0
    held = [r for r in out.where("held_out and doc_id < 240").collect()]
    right = sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held)
    assert len(held) > 30 and right >= 0.95 * len(held)


def test_classifier_with_one_class(table):
    rows, _ = corpus()
    for labels, score in (([], 0.5), ([(1, 1, 0), (3, 1, 0), (5, 1, 0)], 1.0)):
        scores = {r["score"] for r in qc.classify(table(rows[:6], DOCS), table(labels, LABELS)).collect()}
        assert scores == {score}
    assert qc.classify(table([], DOCS), table([], LABELS)).count() == 0


def test_linear_time_identity(spark, table):
    """The machine's raw score is bias + linear part + all pairs."""
    rows, labels = corpus()
    machine = qc.train(table(rows, DOCS).select("doc_id", F.col("text").alias("_text")), table(labels, LABELS), iterations=5).model
    some = machine.transform(qc.features(table(rows[:3], DOCS), "text")).select("features", "rawPrediction").collect()
    v = machine.factors.toArray()
    for r in some:
        x = r["features"].toArray()
        on = x.nonzero()[0]
        pairs = sum(float(v[i] @ v[j]) * x[i] * x[j] for a, i in enumerate(on) for j in on[a + 1:])
        assert abs(machine.intercept + machine.linear.toArray() @ x + pairs - r["rawPrediction"][1]) < 1e-6
