"""Merkle manifest of a table, as a tree of SHA-256 states that can be resumed.

A digest is the lowercase hex of SHA-256; a parent is the digest of its children's digests, taken as hex text, one after
the other.  A child's 64 hex digits are one block of SHA-256, so that the hash stands between blocks before every child:
a parent retains a copy of the eight-word state before each child slot.  To fold a changed child into its parent the state
before its slot is resumed with the replacement and the siblings right of it; what lies left of it is not hashed again.

The table's rows are the leaves.  Rows of a group make a tree of their own, the groups' roots one more.  Trees are raised
in blocks of ``width`` neighbouring nodes: a task hashes all levels of a block at once in NumPy, writes the block's
digests and retained states as one row, and hands on the block's root alone.  A group of any size is many blocks.
"""
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import pick, running_total, stage

WORD = np.uint32
BLOCKS = "group string, block long, n long, digest binary, digests binary, states binary"
PATH = "array<struct<slot:int,state:binary,siblings:binary>>"


# --- SHA-256 over many messages at once ------------------------------------------------------------------------------

def _primes(n: int) -> list[int]:
    found: list[int] = []
    at = 2
    while len(found) < n:
        if all(at % p for p in found):
            found.append(at)
        at += 1
    return found


def _root_fraction(value: int, degree: int) -> int:
    """The first 32 bits behind the point of a root."""
    low, high = 0, value << 32
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle ** degree <= value << 32 * degree else (low, middle - 1)
    return low & 0xFFFFFFFF


@cache
def _constants() -> tuple[list[int], np.ndarray]:
    return [_root_fraction(p, 3) for p in _primes(64)], np.array([[_root_fraction(p, 2)] for p in _primes(8)], WORD)


def initial() -> np.ndarray:
    """State before the first block, as a column of eight words."""
    return _constants()[1]


def _turn(x, by: int):
    return x >> by | x << 32 - by


def _schedule(words: list, wrap) -> list:
    w = list(words)
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        w.append(wrap(w[i - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ a >> 3) + w[i - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ b >> 10)))
    return w


def _rounds(state: np.ndarray, added: list) -> np.ndarray:
    """``state`` after 64 rounds; ``added`` is schedule plus constant of each round."""
    a, b, c, d, e, f, g, h = state
    for k in added:
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ e & (f ^ g)) + k
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b | c & (a | b))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return np.stack([a, b, c, d, e, f, g, h]) + state


def resume(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """States (8 x n) after one more block of 16 words each (16 x n)."""
    added = [w + WORD(k) for w, k in zip(_schedule(list(words), lambda x: x), _constants()[0])]
    return _rounds(np.broadcast_to(state, (8, words.shape[1])), added)


@cache
def _padding(blocks: int) -> list:
    """What a message of whole ``blocks`` ends with, scheduled ahead."""
    cut = lambda x: x & 0xFFFFFFFF
    words = [0x80000000, *[0] * 13, 512 * blocks >> 32, cut(512 * blocks)]
    for i in range(16, 64):  # plain integers, cut to words
        a, b = words[i - 15], words[i - 2]
        turn = lambda x, by: cut(x >> by | x << 32 - by)
        words.append(cut(words[i - 16] + (turn(a, 7) ^ turn(a, 18) ^ a >> 3) + words[i - 7] + (turn(b, 17) ^ turn(b, 19) ^ b >> 10)))
    return [WORD(cut(w + k)) for w, k in zip(words, _constants()[0])]


def finish(state: np.ndarray, blocks: int) -> np.ndarray:
    """Digests of messages of so many blocks, as eight words each."""
    return _rounds(state, _padding(blocks))


@cache
def _hex_words() -> np.ndarray:
    """Four hex digits of every 16-bit number, as one word."""
    digit = np.frombuffer(b"0123456789abcdef", np.uint8).astype(WORD)
    n = np.arange(1 << 16)
    return digit[n >> 12] << 24 | digit[n >> 8 & 15] << 16 | digit[n >> 4 & 15] << 8 | digit[n & 15]


def as_text(digests: np.ndarray) -> np.ndarray:
    """The block of hex digits of each digest: 8 x n to 16 x n words."""
    out = np.empty((16, digests.shape[1]), WORD)
    out[0::2], out[1::2] = _hex_words()[digests >> 16], _hex_words()[digests & WORD(0xFFFF)]
    return out


def to_words(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, ">u4").reshape(-1, 8).T.astype(WORD)


def to_bytes(words: np.ndarray) -> bytes:
    return words.T.astype(">u4").tobytes()


# --- one block of a tree -------------------------------------------------------------------------------------------------

def parents(nodes: np.ndarray, arity: int) -> tuple[np.ndarray, np.ndarray]:
    """Parents of every ``arity`` nodes (the last of what is left), and the state before each slot: arity x 8 x parents."""
    n = nodes.shape[1]
    count = -(-n // arity)
    text, before = as_text(nodes), np.zeros((arity, 8, count), WORD)
    state, left = np.broadcast_to(initial(), (8, count)).copy(), n - arity * (count - 1)
    for slot in range(arity):
        before[slot] = state
        has = count if slot < left else count - 1
        if has:
            state[:, :has] = resume(state[:, :has], text[:, slot::arity])
    out = np.empty((8, count), WORD)
    out[:, :-1] = finish(state[:, :-1], arity)
    out[:, -1:] = finish(state[:, -1:], left)
    return out, before


def block_sizes(count: int, levels: int | None, arity: int) -> list[int]:
    """Number of nodes on each level of a block: ``levels`` above the lowest, or up to a single node."""
    sizes = [count]
    while len(sizes) <= levels if levels is not None else sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // arity))
    return sizes


def fold(level: list[np.ndarray], before: list[np.ndarray], at: np.ndarray, changed: np.ndarray, arity: int) -> np.ndarray:
    """The block's root for each place ``at`` with its digest replaced by ``changed`` (8 x len(at)), one at a time."""
    for nodes, states in zip(level, before):
        n, up, slot = nodes.shape[1], at // arity, at % arity
        state = resume(states[slot, :, up].T, as_text(changed))
        children = np.minimum(n - up * arity, arity)
        for s in range(1, arity):
            has = np.flatnonzero((slot < s) & (s < children))
            if len(has):
                state[:, has] = resume(state[:, has], as_text(nodes[:, up[has] * arity + s]))
        changed = np.empty_like(state)
        for m in np.unique(children).tolist():
            chosen = children == m
            changed[:, chosen] = finish(state[:, chosen], m)
        at = up
    return changed


def fold_path(path: list[dict], changed: np.ndarray) -> np.ndarray:
    """``changed`` folded along the path that all of them share: states, slots and siblings level by level."""
    for step in path:
        siblings = to_words(step["siblings"])
        state = resume(to_words(step["state"]), as_text(changed))
        for right in range(step["slot"], siblings.shape[1]):
            state = resume(state, np.broadcast_to(as_text(siblings[:, right:right + 1]), (16, state.shape[1])))
        changed = finish(state, siblings.shape[1] + 1)
    return changed


# --- trees of any size -----------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Shape:
    arity: int = 2
    levels: int = 10

    @property
    def width(self) -> int:
        return self.arity ** self.levels


def _unpack(row: dict, shape: Shape) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests and retained states of a block, level by level."""
    digests, states = to_words(row["digests"]), to_words(row["states"])
    count = min(shape.width, row["n"] - row["block"] * shape.width)
    sizes = block_sizes(count, shape.levels if row["n"] > shape.width else None, shape.arity)
    level, before, at, held = [], [], 0, 0
    for size, above in zip(sizes[:-1], sizes[1:]):
        level.append(digests[:, at:at + size])
        kept = states[:, held:held + (shape.arity - 1) * above].reshape(8, shape.arity - 1, above).transpose(1, 0, 2)
        first = np.broadcast_to(initial(), (8, above))[None]
        before.append(np.concatenate([first, kept]))
        at, held = at + size, held + (shape.arity - 1) * above
    return level, before


def _raise(nodes: DataFrame, shape: Shape) -> DataFrame:
    """Blocks (see BLOCKS) over nodes (group, place, n, digest); n is the group's number of nodes on this level."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        n, block = table.column("n")[0].as_py(), table.column("place")[0].as_py() // shape.width
        level = to_words(b"".join(table.column("digest").to_pylist()))
        digests, states = [level], []
        for _ in block_sizes(level.shape[1], shape.levels if n > shape.width else None, shape.arity)[1:]:
            level, before = parents(level, shape.arity)
            digests.append(level)
            states.append(before[1:].transpose(1, 0, 2).reshape(8, -1))  # the state before the first slot is the same for all
        return pa.table({"group": [table.column("group")[0].as_py()], "block": [block], "n": [n], "digest": [to_bytes(level)],
                         "digests": [to_bytes(np.concatenate(digests, axis=1))],
                         "states": [to_bytes(np.concatenate(states, axis=1)) if states else b""]},
                        pa.schema([("group", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()),
                                   ("digests", pa.binary()), ("states", pa.binary())]))

    blocked = nodes.withColumn("block", F.floor(F.col("place") / shape.width)).groupBy("group", "block")
    return blocked.applyInArrow(run, BLOCKS)


def _tree(nodes: DataFrame, most: int, shape: Shape) -> list[DataFrame]:
    """Blocks of all nodes, blocks of these blocks' roots, and so on; the last holds one block of each group."""
    passes = []
    while True:
        passes.append(stage(_raise(nodes, shape), "blocks"))
        if most <= shape.width:
            return passes
        most = -(-most // shape.width)
        nodes = passes[-1].select("group", F.col("block").alias("place"), F.ceil(F.col("n") / shape.width).alias("n"), "digest")


def _descend(blocks: DataFrame, above: DataFrame, shape: Shape) -> DataFrame:
    """(group, block, path, ...): the path to the root of every node below ``blocks``, which are the blocks of one pass less."""
    joined = blocks.join(above, ["group", "block"])
    more = [f.name for f in above.schema.fields if f.name not in ("group", "block", "path")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                level, before = _unpack(row, shape)
                count = min(shape.width, row["n"] - row["block"] * shape.width)
                out = []
                for at in range(count):
                    path = []
                    for nodes, states in zip(level, before):
                        up, slot = divmod(at, shape.arity)
                        run_of = [i for i in range(up * shape.arity, min((up + 1) * shape.arity, nodes.shape[1])) if i != at]
                        path.append({"slot": slot, "state": to_bytes(states[slot, :, up:up + 1]), "siblings": to_bytes(nodes[:, run_of])})
                        at = up
                    out.append(path + row["path"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["group"]] * count), pa.array(range(row["block"] * shape.width, row["block"] * shape.width + count), pa.int64()),
                     pa.array(out, batch.schema.field("path").type), *(pa.array([row[c]] * count, batch.schema.field(c).type) for c in more)],
                    ["group", "block", "path", *more])

    schema = f"group string, block long, path {PATH}" + "".join(f", {c} {above.schema[c].dataType.simpleString()}" for c in more)
    return joined.mapInArrow(run, schema)


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the rows with their group, place and group size; ``passes``: stored blocks of the groups' trees, lowest first;
    ``paths``: of each group's root to the root of all (group, block 0, path, subroot, root)."""
    leaves: DataFrame
    passes: list[DataFrame]
    paths: DataFrame
    shape: Shape


def build(leaves: DataFrame, order: str, shape: Shape = Shape()) -> Manifest:
    """Manifest of ``leaves``: written rows with ``group`` (string, no null), ``leaf`` (32 bytes), ``row`` (unique) and ``order``.

    Leaves of a group ascend by ``order`` (null first), equal ones by leaf; groups ascend by name, bytewise.
    """
    placed = running_total(leaves, [order, "leaf", "row"], "place", group="group")
    sizes = stage(leaves.groupBy("group").agg(F.count("*").alias("n")), "groups")
    placed = stage(placed.join(sizes, "group"), "leaves")
    passes = _tree(placed.select("group", "place", "n", F.col("leaf").alias("digest")), sizes.agg(F.max("n")).first()[0] or 0, shape)
    subroots = passes[-1].select(F.col("group").alias("name"), F.col("digest").alias("subroot"))
    n_groups = sizes.count()
    named = stage(running_total(subroots, ["name"], "place").withColumn("group", F.lit("")).withColumn("n", F.lit(n_groups).cast("long")), "roots")
    over = _tree(named.select("group", "place", "n", F.col("subroot").alias("digest")), n_groups, shape)
    paths = over[-1].select("group", "block", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    for blocks in reversed(over):
        paths = _descend(blocks, paths, shape)
    paths = paths.select(F.col("block").alias("place"), "path", "root").join(named.select("name", "place", "subroot"), "place")
    paths = paths.select(F.col("name").alias("group"), F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
    return Manifest(placed, passes, stage(paths, "paths"), shape)


def fold_leaves(manifest: Manifest, keep: str, changed: str | None = None) -> DataFrame:
    """For each leaf: the column ``keep``, leaf, subroot, root, proof_sha256 and folded_root as hex.

    proof_sha256 is the digest of all siblings from leaf to root, left to right; folded_root is what the root becomes if
    the leaf alone is replaced by ``changed`` (32 bytes; null: the leaf itself).
    """
    shape, paths = manifest.shape, manifest.paths
    for blocks in reversed(manifest.passes[1:]):
        paths = _descend(blocks, paths, shape)
    new = F.coalesce(F.col(changed), F.col("leaf")) if changed else F.col("leaf")
    leaves = manifest.leaves.select(F.col(keep).alias("kept"), "group", F.floor(F.col("place") / shape.width).alias("block"),
                                    (F.col("place") % shape.width).alias("at"), "leaf", new.alias("new"))
    blocks = manifest.passes[0].select("group", "block", "n", "digests", "states").join(paths, ["group", "block"])
    kept_type = manifest.leaves.schema[keep].dataType.simpleString()
    schema = f"{keep} {kept_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"

    def run(rows: pa.Table, block: pa.Table) -> pa.Table:
        [own] = block.to_pylist()
        level, before = _unpack(own, shape)
        at = rows.column("at").to_numpy().astype(np.int64)
        folded = fold(level, before, at, to_words(b"".join(rows.column("new").to_pylist())), shape.arity)
        roots = to_bytes(fold_path(own["path"], folded)).hex()
        siblings = []  # of every node of a level, as text
        for nodes in level:
            text = to_bytes(nodes).hex()
            text = [text[i:i + 64] for i in range(0, len(text), 64)]
            siblings.append(["".join(text[i - i % shape.arity:i] + text[i + 1:i - i % shape.arity + shape.arity]) for i in range(len(text))])
        above = b"".join(s["siblings"] for s in own["path"]).hex()
        proofs = [hashlib.sha256(("".join([s[i // shape.arity ** k] for k, s in enumerate(siblings)]) + above).encode()).hexdigest() for i in at.tolist()]
        n = len(at)
        return pa.table([rows.column("kept"), pa.array([d.hex() for d in rows.column("leaf").to_pylist()]), pa.array([own["subroot"].hex()] * n),
                         pa.array([own["root"].hex()] * n), pa.array(proofs), pa.array([roots[64 * i:64 * i + 64] for i in range(n)])],
                        [keep, "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    return leaves.groupBy("group", "block").cogroup(blocks.groupBy("group", "block")).applyInArrow(run, schema)


def leaf_of(values: list[Column]) -> Column:
    """Digest (32 bytes) of a row's values: each ``-`` if null, else number of UTF-8 bytes, ``:``, value as text."""
    text = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256))


def group_name(value: Column) -> Column:
    """Group names that sort as their values do, null first."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), value))


def verify(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text",
           every: int = 7, shape: Shape = Shape()) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    Leaves are digests of (doc_id, source, lang, n_chars, text); a tree per lang, one over the langs.  To show what a manifest
    finds, rows whose crc32(doc_id) is divisible by ``every`` are tampered with (n_chars plus 1) and folded; the others are folded as
    they are.  A null is a value of its own: a null lang is the first group, a null n_chars stays under tampering, a null doc_id comes
    first in its group and is not tampered with.  Rows of one doc_id ascend by leaf, fully repeated ones each have a place of
    their own.  Texts of any length are hashed whole in the JVM; an empty table gives no rows; further columns are not read.
    """
    docs = pick(docs, doc_id=doc_id, source=source, lang=lang, n_chars=n_chars, text=text)
    cells = lambda n: [F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")]
    tampered = (F.crc32(F.col("doc_id").cast("string")) % every == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", group_name(F.col("lang")).alias("group"), leaf_of(cells(F.col("n_chars"))).alias("leaf"),
                         F.when(tampered, leaf_of(cells(F.col("n_chars").cast("decimal(38,0)") + 1))).alias("changed"))
    found = fold_leaves(build(stage(leaves, "digests"), "doc_id", shape), "doc_id", "changed")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
