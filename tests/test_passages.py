"""Passages word for word against plain containment: short and long, in blocks, with odd rows."""
import random

from plumbline.operators.passages import verbatim_places

DOCS = "doc_id string, section_id int, text string"


def test_every_passage_in_every_text(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abé中", k=rng.randrange(1, 7))) for _ in range(6000)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 60))) for _ in range(150)] + ["", "x" * 200_000 + " tail of it"]
    items = [(f"s{i}", w) for i, w in enumerate(dict.fromkeys(words))][:5000]
    for i in range(150):
        text = rng.choice(texts[:150])
        at = rng.randrange(0, max(1, len(text)))
        items.append((f"l{i}", text[at:at + rng.randrange(1, 300)]))
    items += [("none", "not to be found anywhere at all, surely"), ("empty", ""), ("tail", "x" * 150 + " tail"), ("s0", items[0][1])]
    docs = spark.createDataFrame([(str(i), i % 2, t) for i, t in enumerate(texts)] + [("null", 0, None)], DOCS).repartition(4)
    asked = spark.createDataFrame(items, "qid string, query string")
    want = {(q, str(i), i % 2) for q, p in items if p for i, t in enumerate(texts) if p in t}
    for block_bytes in (8 << 20, 300_000):
        found = verbatim_places(asked, docs, block_bytes)
        got = [tuple(r) for r in found.collect()]
        assert set(got) == want and len(got) == len(want) > 5000
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert verbatim_places(asked.limit(0), docs).count() == 0 and verbatim_places(asked, docs.limit(0)).count() == 0
