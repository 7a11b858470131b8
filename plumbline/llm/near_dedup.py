"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, connected groups."""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import components, pick, stage

SHINGLE = 5
#: 36 bands of 7 slots: two sets with similarity 0.85 miss each other with probability 1e-6, sets with 0.3 meet with 0.8 %.
BANDS, ROWS = 36, 7
U = np.uint64
GOLDEN, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
WEIGHTS = np.random.default_rng(7).integers(0, 1 << 63, max(SHINGLE, ROWS), dtype=np.int64).astype(U) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than a shingle are one."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words))
    n = max(1, len(h) - size + 1)
    total = np.full(n, U(min(size, len(h))))
    for i in range(min(size, len(h))):
        total += h[i:i + n] * WEIGHTS[i]
    return np.unique(mix(total))


def signatures(sets: list[np.ndarray], m: int, lazy_steps: int = 6) -> np.ndarray:
    """SuperMinHash (Ertl, 2017) of many sets at once, one row of ``m`` values per set.

    Step j gives every element the j-th slot of its own random permutation of the slots, with a value in [j, j+1): slots of
    one element never share a rank.  A slot keeps its least value.  A set stops as soon as all its slots hold a value
    of an earlier step, which takes about m ln(m) / n steps.  A value is rank and fraction in one integer.
    """
    out = np.full((len(sets), m), U(0xFFFFFFFFFFFFFFFF))
    element = np.concatenate(sets) if len(sets) else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
    swaps: list[np.ndarray] = []
    for j in range(min(lazy_steps, m)):
        value, to = _draw(element, j, m)
        slot = to.copy()  # the permutation after few swaps, followed backwards
        for i in range(j - 1, -1, -1):
            slot[swaps[i] == slot] = i
        swaps.append(to)
        keep = _lower(out, owner, slot, value, j)
        element, owner, swaps = element[keep], owner[keep], [s[keep] for s in swaps]
        if not len(element):
            return out
    # the rest are short sets; whole permutations of their elements are held for a part of them at a time
    cuts = np.flatnonzero(np.diff(owner)) + 1
    begin = 0
    while begin < len(element):
        end = cuts[np.searchsorted(cuts, begin + TABLE_ROWS, "right") - 1] if len(element) - begin > TABLE_ROWS and len(cuts) else len(element)
        end = end if end > begin else (cuts[cuts > begin][0] if (cuts > begin).any() else len(element))
        _follow(out, element[begin:end], owner[begin:end], [s[begin:end] for s in swaps], m)
        begin = end
    return out


#: Rows of the table of whole permutations, 2 bytes a slot.
TABLE_ROWS = 40_000


def _draw(element: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Value of each element's step j, and the place it swaps with place j."""
    z = mix(element + np.array([j + 1], U) * GOLDEN)
    return U(j) << U(52) | z >> U(12), j + ((mix(z ^ GOLDEN) >> U(32)) * U(m - j) >> U(32)).astype(np.int32)


def _lower(out: np.ndarray, owner: np.ndarray, slot: np.ndarray, value: np.ndarray, j: int) -> np.ndarray:
    """Lower the slots; which elements go on: those of sets with a slot that no step up to j has reached."""
    np.minimum.at(out.reshape(-1), owner * out.shape[1] + slot, value)
    own = np.unique(owner)
    live = np.zeros(len(out), bool)
    live[own] = (out[own].max(axis=1) >> U(52)) > U(j)
    return live[owner]


def _follow(out: np.ndarray, element: np.ndarray, owner: np.ndarray, swaps: list[np.ndarray], m: int) -> None:
    table = np.tile(np.arange(m, dtype=np.int16), (len(element), 1))
    rows = np.arange(len(element))
    for i, s in enumerate(swaps):
        held = table[rows, s]
        table[rows, s] = table[:, i]
        table[:, i] = held
    for j in range(len(swaps), m):
        value, to = _draw(element, j, m)
        rows = np.arange(len(element))
        slot = table[rows, to]
        table[rows, to] = table[:, j]
        keep = _lower(out, owner, slot, value, j)
        if not keep.all():
            element, owner, table = element[keep], owner[keep], table[keep]
            if not len(element):
                return


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key per set and band."""
    sig = signatures(sets, BANDS * ROWS).reshape(len(sets), BANDS, ROWS)
    key = np.zeros((len(sets), BANDS), U) + np.arange(BANDS, dtype=U)
    for i in range(ROWS):
        key = mix(key + sig[:, :, i] * WEIGHTS[i])
    return key


def _chunks(texts: list[bytes | None], elements: int = 200_000) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sets of consecutive texts, a few at a time: (first index, sets)."""
    at, held, count = 0, [], 0
    for i, text in enumerate(texts):
        held.append(shingles(text))
        count += len(held[-1])
        if count >= elements:
            yield at, held
            at, held, count = i + 1, [], 0
    if held:
        yield at, held


def _digest(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, band keys) of each row; an empty set has no digest and no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for at, sets in _chunks(batch.column("text").to_pylist()):
                keys = band_keys(sets)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()),
                     pa.array([k.tobytes() if len(s) else None for k, s in zip(keys, sets)], pa.binary())],
                    ["doc_id", "n_shingles", "digest", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys binary")


def _with_sets(members: DataFrame) -> DataFrame:
    """Adds the set to rows (group, block, node, digest, keys, text).  Rows of a doc_id with another text drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in _chunks(batch.column("text").to_pylist()):
                part = batch.slice(at, len(sets))
                same = pa.array([_digest(s) == d for s, d in zip(sets, part.column("digest").to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [part.column("places"), part.column("node"), part.column("keys"), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["places", "node", "keys", "members"]).filter(same)

    return members.mapInArrow(run, "places array<struct<group:string,block:long>>, node long, keys binary, members binary")


def spanning_links(node: np.ndarray, block: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between sets that share a band key and reach the similarity, as a forest: a pair already connected is not
    looked at.  Of two blocks only pairs across are looked at; each block has a group of its own."""
    n, links = len(node), []
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    flag = np.zeros(int(local.max()) + 1, bool)
    tree = np.arange(n)
    across = len(np.unique(block)) > 1
    for x in range(n - 1):
        near = (keys[x + 1:] == keys[x]).any(axis=1) & (tree[x + 1:] != tree[x])
        if across:
            near &= block[x + 1:] != block[x]
        found = np.flatnonzero(near) + x + 1
        if not len(found):
            continue
        own = local[ends[x] - sizes[x]:ends[x]]
        flag[own] = True
        if len(found) > 200:
            run = np.concatenate([[0], np.cumsum(flag[local])])
            shared = run[ends[found]] - run[ends[found] - sizes[found]]
        else:
            shared = np.array([np.count_nonzero(flag[local[ends[y] - sizes[y]:ends[y]]]) for y in found])
        flag[own] = False
        for y in found[100 * shared >= percent * (sizes[x] + sizes[found] - shared)]:
            if tree[y] != tree[x]:
                links.append((int(node[x]), int(node[y])))
                tree[tree == tree[y]] = tree[x]
    return links


def _places(clusters: DataFrame, percent: int, block_docs: int, block_shingles: int) -> DataFrame:
    """Where each member of a cluster is compared: array of (group, block).

    A cluster that fits one block is one group.  Larger ones are split by size class (sets that differ by more than one
    class cannot reach the similarity) and hash into blocks of bounded size; every two blocks of a class or of
    neighbouring classes form a group.  So no task holds more than two blocks, however large the cluster is.
    """
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / float(-np.log(percent / 100 - 1e-6))).cast("int")
    rows = clusters.withColumn("size_class", size_class)
    need = F.ceil(F.greatest(F.count("*") / block_docs, F.sum("n_shingles") / block_shingles)).cast("int")
    classes = rows.groupBy("cluster", "size_class").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("n"), need.alias("blocks"))
    whole = classes.groupBy("cluster").agg(
        ((F.sum("docs") <= block_docs) & (F.sum("n") <= block_shingles)).alias("one"),
        F.map_from_entries(F.collect_list(F.struct("size_class", "blocks"))).alias("blocks"))  # one entry per size class
    rows = rows.join(whole, "cluster")
    count = lambda c: F.coalesce(F.try_element_at("blocks", c), F.lit(0))
    own = F.pmod(F.xxhash64("node"), count(F.col("size_class"))).cast("int")
    c = F.col("size_class")
    name = lambda c1, b1, c2, b2: F.concat_ws("/", F.col("cluster"), c1, b1, c2, b2)
    block = (c.cast("long") * (1 << 32) + own).alias("block")

    same = F.transform(F.sequence(F.lit(0), count(c) - 1), lambda j: F.struct(name(c, F.least(own, j), c, F.greatest(own, j)).alias("group"), block))
    empty = F.array().cast("array<struct<group:string,block:bigint>>")
    above = F.when(count(c + 1) > 0, F.transform(F.sequence(F.lit(0), F.greatest(count(c + 1), F.lit(1)) - 1),
                                                 lambda j: F.struct(name(c, own, c + 1, j).alias("group"), block))).otherwise(empty)
    below = F.when(count(c - 1) > 0, F.transform(F.sequence(F.lit(0), F.greatest(count(c - 1), F.lit(1)) - 1),
                                                 lambda j: F.struct(name(c - 1, j, c, own).alias("group"), block))).otherwise(empty)
    one = F.array(F.struct(F.col("cluster").cast("string").alias("group"), F.lit(0).cast("long").alias("block")))
    return rows.withColumn("places", F.when(F.col("one"), one).otherwise(F.concat(same, above, below)))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85,
                    block_docs: int = 512, block_shingles: int = 400_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable) and kept.

    Documents with equal sets are one node.  Nodes sharing a band key are clustered over a star per key (no pairs of a
    bucket are written); within a cluster the nodes that share a key are verified on their full sets and only a spanning
    forest of the links leaves the task; the links' connected components are the groups.

    Null and empty texts have an empty set, are linked with nothing and kept.  Rows of one doc_id are one document: they
    share a component.  Rows without doc_id are linked with nothing: component null, kept.
    """
    docs = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    sketched = stage(sketch(docs), "sketch")
    usable = sketched.where("digest is not null and doc_id is not null")
    nodes = stage(usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"),
                                               F.first("keys").alias("keys")), "nodes")
    parts = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.substring(F.col("keys"), b * 8 + 1, F.lit(8)))
    banded = nodes.select("node", F.explode(parts).alias("key"))
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").drop("last")
    star = banded.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    clusters = nodes.join(components(star).withColumnRenamed("component", "cluster"), "node")
    places = _places(clusters, percent, block_docs, block_shingles).select("node", "digest", "keys", "places")
    # as many places as clustered documents: merged at every size, never broadcast
    members = docs.join(places.hint("merge"), docs["doc_id"] == places["node"]).select("places", "node", "digest", "keys", "text")
    members = _with_sets(members).select(F.explode("places").alias("p"), "node", "keys", "members").select("p.*", "node", "keys", "members")

    def verify(table: pa.Table) -> pa.Table:
        keys = np.stack([np.frombuffer(k, U) for k in table.column("keys").to_pylist()])
        sets = [np.frombuffer(s, U) for s in table.column("members").to_pylist()]
        found = spanning_links(table.column("node").to_numpy(), table.column("block").to_numpy(), keys, sets, percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    links = members.groupBy("group").applyInArrow(verify, "a long, b long")
    groups = components(stage(links, "links"))
    named = nodes.select("digest", "node").join(groups, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component"))
    # texts under one doc_id share the smallest component
    out = sketched.join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.least("component", "doc_id"), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
