import random

import numpy as np
import pytest

from plumbline.llm import near_dedup as nd
from plumbline.llm.common import components

DOCS = "doc_id long, text string"


def groups_by_hand(rows):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        own = {tuple(words[j:j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
        if i is not None:
            sets.setdefault(i, []).append(own)
    ids = sorted(sets)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                linked = any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b])
                if linked and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def family(size, edits, start, words=120):
    """Copies of one text with a growing number of edits."""
    base = [random.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(random.randint(0, 50)) for _ in range(words)]
    out = []
    for k in range(size):
        own = list(base)
        for _ in range(k * edits // size):
            own[random.randrange(words)] = f"edit{random.randint(0, 10 ** 6)}"
        out.append((start + k, " ".join(own)))
    return out


@pytest.mark.parametrize("block_docs", [512, 8])  # 8: the family is compared block by block
def test_against_all_pairs(table, block_docs):
    random.seed(block_docs)
    rows = family(60, 12, 10) + family(5, 2, 200) + [(300, None), (301, ""), (302, " \n"), (303, "One two"), (304, "one\tTWO "), (305, "one two three")]
    rows += [(306, rows[4][1]), (4, rows[4][1]), (306, rows[4][1])]
    random.shuffle(rows)
    expected = groups_by_hand(rows)
    out = nd.near_duplicates(table(rows + [(None, "one two")], DOCS), block_docs=block_docs).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        assert (r["component_id"], r["kept"]) == ((None, True) if r["doc_id"] is None else (expected[r["doc_id"]], expected[r["doc_id"]] == r["doc_id"]))
    assert {r["doc_id"]: r["n_shingles"] for r in out}[303] == 1 and {r["doc_id"]: r["n_shingles"] for r in out}[300] == 0


def test_empty_table(table):
    assert nd.near_duplicates(table([], DOCS)).count() == 0


def test_signature_is_the_sequential_one():
    """Slot by slot as in the published algorithm, one element after the other."""
    rng = np.random.default_rng(1)
    m = 64
    for n in (1, 3, 40):
        own = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.int64).astype(nd.U))
        best = [(1 << 64) - 1] * m
        for e in own:
            p = list(range(m))
            for j in range(m):
                z = nd.mix(np.array([e], nd.U) + np.array([j + 1], nd.U) * nd.GOLDEN)
                k = j + int((int(nd.mix(z ^ nd.GOLDEN)[0]) >> 32) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                best[p[j]] = min(best[p[j]], j << 52 | int(z[0]) >> 12)
        assert (np.array(best, nd.U) == nd.signatures([own, own[:1]], m)[0]).all()


def test_lower_variance_than_independent_hashes():
    rng = np.random.default_rng(2)
    off = []
    for _ in range(200):
        u = rng.integers(0, 2 ** 63, 300, dtype=np.int64).astype(nd.U)
        sig = nd.signatures([np.unique(u[:170]), np.unique(u[130:])], 128)
        off.append((sig[0] == sig[1]).mean() - 40 / 300)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < np.sqrt(40 / 300 * 260 / 300 / 128)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
