"""The byte network: derivatives, lookup against plain convolution, windows over whole texts, held-out accuracy, odd rows."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language_id as lid
from plumbline.llm.common import load
from plumbline.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string"


def test_derivatives():
    random = np.random.default_rng(4)
    net = lid.Network.random(["a", "b", "c"], 1)
    for name in ("embedding", "weights", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.banks, net.biases = [b.astype(np.float64) for b in net.banks], [b.astype(np.float64) for b in net.biases]
    x, y = random.integers(0, lid.CLASSES, (6, 40)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 1])
    _, found = net.gradients(x, y)
    for p, g in zip(net.parameters(), found):
        for _ in range(6):
            at = tuple(random.integers(0, s) for s in p.shape)
            old, h = p[at], 1e-6
            p[at] = old + h
            up = net.gradients(x, y)[0]
            p[at] = old - h
            down = net.gradients(x, y)[0]
            p[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * h), abs=1e-5)


def test_lookup_is_convolution_and_windows_cover_texts():
    random = np.random.default_rng(9)
    texts = [bytes(random.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 3, 255, 256, 257, 509, 510, 5000)]
    x, count = lid.windows(texts)
    assert count.tolist() == [0, 1, 1, 1, 1, 2, 2, 3, 20] and len(x) == count.sum()
    at = 0
    for t, n in zip(texts, count):
        own = lid.BYTE_CLASSES[np.frombuffer(t, np.uint8)]
        covered = {bytes(own[i:i + 4]) for i in range(len(own) - 3)}
        held = {bytes(w[i:i + 4]) for w in x[at:at + n] for i in range(lid.LENGTH - 3)}
        assert covered <= held
        at += n
    net = lid.Network.random(["a", "b"], 3)
    assert np.abs(net.pooled(x)[0] - lid.Scorer(net).pooled(x)).max() < 1e-5
    p = lid.Scorer(net).scores(texts)
    assert p.shape == (9, 2) and np.allclose(p.sum(1), 1)


def test_held_out_accuracy(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    out = lid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id")
    rows = out.where("held_out and length(text) > 100").collect()
    assert len(rows) > 120 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in out.select("doc_id", "held_out", "score").collect())
    mixed = docs.withColumn("lang", F.when(lid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lid.identify(mixed).collect()}
    assert again == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lid.identify(docs).collect()}  # held-out labels are not read


def test_odd_rows(table):
    english, other = "the house and the garden of the king ", "der garten und das haus des königs "
    texts = [english * 8, other * 8] * 20
    rows = [(i, t, "en" if t == texts[0] else "de") for i, t in enumerate(texts)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 34 !!  ", "en"), (None, english, None), (103, english * 3000, None), (103, english * 3000, None), (104, "a", None)]
    docs = table(rows, DOCS).withColumns({c: F.lit("clash") for c in ("content", "held_out", "score", "mark", "wanted", "share")})
    out = [tuple(r) for r in lid.identify(docs, max_windows=200).collect()]
    got = {r[0]: r for r in out}
    assert len(out) == len(rows) and [got[i][2:] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[0][2] == got[None][2] == got[103][2] == "en" and got[1][2] == "de" and sum(r[0] == 103 for r in out) == 2 and got[None][1] is False
    assert lid.identify(table([], DOCS)).count() == 0
    unlabelled = lid.identify(table([(1, "words", None)], DOCS)).first()
    assert (unlabelled["lang_pred"], unlabelled["score"]) == ("und", 0.0)
    one = lid.identify(table([(1, "words here", "x"), (2, "more words", "x"), (3, "12", "x")], DOCS)).collect()
    assert sorted((r["lang_pred"], r["score"]) for r in one) == [("und", 0.0), ("x", 1.0), ("x", 1.0)]


def test_query(spark):
    assert QUERIES["op13_language_id"](spark, "/root/testdata/sf0.001").columns == ["doc_id", "held_out", "lang_pred", "score"]
