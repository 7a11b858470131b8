"""The manifest against a plain tree, for groups of every size, with odd rows."""
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle
from plumbline.llm.common import stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    cells = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    return digest("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells)


def tree(nodes, arity=2):
    """Root, and per node its siblings and how a changed digest folds."""
    paths = [([], []) for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + arity] for i in range(0, len(nodes), arity)]
        for p, i in zip(paths, at):
            run, slot = runs[i // arity], i % arity
            p[0].extend(run[:slot] + run[slot + 1:])
            p[1].append((run, slot))
        nodes, at = [digest(r) for r in runs], [i // arity for i in at]
    return nodes[0], paths


def fold(steps, changed):
    for run, slot in steps:
        changed = digest([*run[:slot], changed, *run[slot + 1:]])
    return changed


def expected(rows, arity=2):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    out, sub, own = [], [], []
    for lang in langs:
        mine = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        root, paths = tree([leaf(r) for r in mine], arity)
        sub.append(root)
        own.append((mine, paths))
    root, over = tree(sub, arity)
    for (mine, paths), subroot, above in zip(own, sub, over):
        for r, p in zip(mine, paths):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            new = leaf({**r, "n_chars": r["n_chars"] + 1} if tampered else r)
            folded = fold(p[1] + above[1], new)
            out.append((r["doc_id"], leaf(r), subroot, root, digest(p[0] + above[0]), folded, folded == root))
    return sorted(out, key=str)


def rows_of(sizes):
    rows, random = [], np.random.default_rng(3)
    for lang, n in sizes.items():
        for i in random.permutation(n).tolist():
            rows.append({"doc_id": i, "text": f"text {i} é", "lang": lang, "source": f"s{i % 3}", "n_chars": i})
    odd = {"doc_id": 7, "text": None, "lang": "en", "source": None, "n_chars": None}
    rows += [odd, odd, {**odd, "text": ""}, {**odd, "doc_id": None}, {**odd, "doc_id": None, "n_chars": 3}, {**odd, "text": "x" * 300_000, "n_chars": 1},
             {**odd, "lang": "", "doc_id": -5, "n_chars": (1 << 63) - 1}]
    return rows


@pytest.mark.parametrize("sizes,arity,levels", [({"en": 5, None: 1, "é": 64, "z": 2, "Z": 33}, 2, 2), ({"en": 70, "de": 3}, 3, 1), ({"en": 40}, 2, 10)])
def test_manifest_equals_a_plain_tree(table, sizes, arity, levels):
    rows = rows_of(sizes)
    docs = table([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCS).withColumns(
        {c: F.lit("clash") for c in ("group", "place", "leaf", "row", "changed", "block")}).repartition(3)
    got = sorted((tuple(r) for r in merkle.verify(docs, shape=merkle.Shape(arity, levels)).collect()), key=str)
    assert got == expected(rows, arity)


def test_no_rows_and_one(table):
    assert merkle.verify(table([], DOCS)).count() == 0
    [row] = merkle.verify(table([(1, "a", None, None, 1)], DOCS)).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == digest([]) and row["verified"]


def test_states_are_resumed_from_before_the_slot(table):
    """A stored state is that of the siblings left of the slot: resuming it never reads them."""
    rows = stage(table([(i, f"t{i}", "en", "s", i) for i in range(11)], DOCS).select(
        F.col("doc_id").alias("row"), "doc_id", F.lit("g").alias("group"), merkle.leaf_of([F.col("text")]).alias("leaf")), "digests")
    shape = merkle.Shape(4, 3)
    [block] = merkle.build(rows, "doc_id", shape).passes[0].collect()
    level, before = merkle._unpack(block.asDict(), shape)
    for nodes, states in zip(level, before):
        for up in range(states.shape[2]):
            state = merkle.initial()
            for slot in range(min(4, nodes.shape[1] - 4 * up)):
                assert (states[slot, :, up:up + 1] == state).all()
                state = merkle.resume(state, merkle.as_text(nodes[:, 4 * up + slot:4 * up + slot + 1]))


def test_a_hot_group_is_many_blocks(table):
    docs = table([(i, "same text", "en", "s", 1) for i in range(3000)] + [(7, "copy", "en", "s", 1)] * 500, DOCS)
    out = merkle.verify(docs, shape=merkle.Shape(2, 5))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert out.count() == 3500 and out.select("root").distinct().count() == 1
    assert out.where("verified = (crc32(cast(doc_id as string)) % 7 = 0)").count() == 0
