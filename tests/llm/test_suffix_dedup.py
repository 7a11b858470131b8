import hashlib
import random

import numpy as np
import pytest

from plumbline.llm.suffix_array import doubled, permuted_prefixes, suffix_array
from plumbline.llm.suffix_dedup import remove_repeats

DOCS = "doc_id long, text string"


def by_hand(texts, window):
    where = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - window + 1):
            where.setdefault(t[p:p + window], []).append((i, p))
    covered = [np.zeros(len(t), bool) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for i, p in places:
                covered[i][p:p + window] = True
    out = []
    for t, c in zip(texts, covered):
        spans = np.count_nonzero(np.diff(c.astype(int), prepend=0) == 1)
        out.append((len(t), int(c.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~c])).hexdigest()))
    return out


def assert_same(df, window, **options):
    rows = df.select("doc_id", "text").collect()
    got = sorted((str(r[0]), *r[1:]) for r in remove_repeats(df, window=window, **options).collect())
    expected = by_hand([(r["text"] or "").encode() for r in rows], window)
    assert got == sorted((str(r["doc_id"]), *e) for r, e in zip(rows, expected))


def rows():
    random.seed(4)
    shared = "".join(random.choice("abc") for _ in range(30))
    out = [(i, "".join(random.choice("abcd") for _ in range(random.randint(0, 60))) + shared[:random.randint(8, 30)]
            + "".join(random.choice("aé") for _ in range(random.randint(0, 40)))) for i in range(50)]
    return out + [(100, None), (101, ""), (102, "x" * 90), (103, "x" * 19), (None, "abc" * 20), (None, "abc" * 20),
                  (104, out[3][1]), (3, out[3][1])]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])  # 300: every frequent anchor is taken up again
def test_against_all_windows(table, shard_bytes):
    assert_same(table(rows(), DOCS), 20, anchors=(6, 16, 19, 20), shard_bytes=shard_bytes)


def test_empty_table(table):
    assert remove_repeats(table([], DOCS)).count() == 0


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(5)
    for k, n in ((3, 50), (4, 300), (257, 500), (2, 30)):
        for _ in range(5):
            t = np.append(rng.integers(1, k, n) if k > 2 else np.ones(n, int), 0).astype(np.uint16)
            t[:n // 3] = t[n // 3:2 * (n // 3)]
            listed = t.tolist()
            expected = sorted(range(n + 1), key=lambda i: listed[i:])
            order = suffix_array(t, max(k, 3))
            assert order.tolist() == expected == doubled(t).tolist()
            borders = 1 if k > 3 else 0
            prefixes = permuted_prefixes(t, order, borders)
            for a, b in zip(expected, expected[1:]):
                same = 0
                while max(a, b) + same <= n and t[a + same] == t[b + same] and t[a + same] > borders:
                    same += 1
                assert prefixes[b] == same
