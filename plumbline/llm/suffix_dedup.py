"""Exact removal of repeated strings: suffix arrays of shards in which equal strings are sure to meet.

Equal windows of ``window`` bytes have equal anchors: the least hash among their short strings (a minimizer).  Windows
in a row with one anchor form a segment; segments with an anchor found once in the corpus hold no repeat and stay
where they are.  The others are sharded by anchor, equal segments once with their number of copies, and each shard
gets its suffix array and permuted common prefixes.  Windows next to each other in order with a common prefix of a whole
window are equal.

An anchor with more segments than a shard may hold (a short passage found in very many contexts) is taken up again with
longer anchors, at last the windows themselves, so that no task holds more than a shard whatever the text is.
"""
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import pick, stage
from plumbline.llm.suffix_array import permuted_prefixes, suffix_array

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BYTE_HASH = np.random.default_rng(31).integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
BLOCK = 1 << 18
#: Windows of one segment at most; a segment is so many bytes longer than its windows as a window has, less one.
SEGMENT_WINDOWS = 1024
SEGMENT = "unit binary, start long, copies long, anchor long, segment binary, content binary"
SPANS = "segment binary, hot boolean, spans array<struct<a:long,b:long>>"


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(BLOCK, U), np.ones(BLOCK, U)
    np.cumprod(np.full(BLOCK - 1, BASE, U), out=up[1:])
    np.cumprod(np.full(BLOCK - 1, pow(BASE, -1, 1 << 64), U), out=down[1:])
    return up, down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def string_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """Hash of every string of ``size`` bytes: a polynomial modulo 2^64 from one running sum."""
    up, down = _powers()
    total = np.zeros(len(b) + 1, U)
    np.cumsum(BYTE_HASH[b] * up[:len(b)], out=total[1:])
    return _mix((total[size:] - total[:-size]) * down[:len(b) - size + 1])


def least_in_window(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` values in a row, from running minima of blocks to both sides."""
    n = len(h) - width + 1
    blocks = np.concatenate([h, np.full(-len(h) % width, U(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def segments(text: bytes, window: int, size: int) -> Iterator[tuple[int, int, int, bool]]:
    """(first window, windows, anchor, may repeat itself) for runs of windows with one anchor; long texts go in blocks.
    A run that holds the anchor's string twice may hold a window twice."""
    room = window - size + 1
    all_bytes = np.frombuffer(text, np.uint8)
    for at in range(0, len(text) - window + 1, BLOCK - window + 1):
        b = all_bytes[at:at + BLOCK]
        if len(b) < window:
            break
        hashes = string_hashes(b, size)
        anchor = least_in_window(hashes, room).view(np.int64)
        hashes = hashes.view(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(first, append=len(anchor))
        for f, n, a in zip(first.tolist(), count.tolist(), anchor[first].tolist()):
            twice = n > 1 and np.count_nonzero(hashes[f:f + n + room - 1] == a) > 1
            for part in range(0, n, SEGMENT_WINDOWS):
                yield at + f + part, min(SEGMENT_WINDOWS, n - part), a, twice


def repeated_windows(contents: list[bytes], copies: list[int], window: int) -> list[list[tuple[int, int]]]:
    """Runs (from, to) of window starts that occur twice or more, for each content of a shard."""
    sizes = np.array([len(c) for c in contents])
    first = np.cumsum(sizes + 1) - sizes - 1
    t = np.zeros(int((sizes + 1).sum()) + 1, np.uint16)
    for f, c in zip(first, contents):
        t[f:f + len(c)] = np.frombuffer(c, np.uint8)
        t[f:f + len(c)] += 2
        t[f + len(c)] = 1
    order = suffix_array(t, 258)
    same = permuted_prefixes(t, order, borders=1)[order] >= window
    group = np.cumsum(~same)
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    weight = np.append(np.array(copies)[owner], 0)[order]
    repeated = np.zeros(len(t), bool)
    repeated[order] = np.bincount(group, weights=weight)[group] >= 2
    out = []
    for f, n in zip(first, sizes):
        flags = repeated[f:f + n - window + 1].astype(np.int8)
        edges = np.flatnonzero(np.diff(flags, prepend=0, append=0))
        out.append(list(zip(edges[::2].tolist(), edges[1::2].tolist())))
    return out


def _repeats(units: DataFrame, window: int, anchors: tuple[int, ...], shard_bytes: int) -> DataFrame:
    """(unit, spans): runs of repeated window starts of ``units`` (unit, content, copies; units may be repeated rows)."""
    size = anchors[0]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for unit, content, copies in zip(*(batch.column(c).to_pylist() for c in ("unit", "content", "copies"))):
                out += [(unit, start, n, a, copies + itself) for start, n, a, itself in segments(content or b"", window, size)]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                                             ["unit", "start", "n", "anchor", "found"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("unit", pa.binary()), ("start", pa.int64()), ("copies", pa.int64()), ("anchor", pa.int64()),
                            ("segment", pa.binary()), ("content", pa.binary())])
        for batch in batches:
            out, held = [], 0
            for unit, content, copies, runs in zip(*(batch.column(c).to_pylist() for c in ("unit", "content", "copies", "runs"))):
                for r in runs:
                    piece = content[r["start"]:r["start"] + r["n"] + window - 1]
                    out.append((unit, r["start"], copies, r["anchor"], xxhash.xxh3_128_digest(piece), piece))
                    held += len(piece)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    marked = stage(units.mapInArrow(mark, "unit binary, start long, n long, anchor long, found long"), "anchors")
    often = marked.groupBy("anchor").agg(F.sum("found").alias("found")).where("found > 1").select("anchor")
    runs = marked.join(often, "anchor").groupBy("unit").agg(F.collect_set(F.struct("start", "n", "anchor")).alias("runs"))
    cuts = stage(units.join(runs, "unit").select("unit", "content", "copies", "runs").mapInArrow(cut, SEGMENT), "segments")
    shards = (cuts.groupBy("segment", "anchor").agg(F.sum("copies").alias("copies"), F.first("content").alias("content"))
              .repartition(F.col("anchor")).sortWithinPartitions("anchor"))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[tuple] = []  # full groups waiting for a shard
        group: list[tuple] = []
        sizes = [0, 0]
        schema = pa.schema([("segment", pa.binary()), ("hot", pa.bool_()),
                            ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        def shard() -> list[tuple]:
            found = repeated_windows([c for _, c, _ in whole], [n for _, _, n in whole], window) if whole else []
            rows = [(s, False, [{"a": a, "b": b} for a, b in f]) for (s, _, _), f in zip(whole, found) if f]
            whole.clear()
            sizes[0] = 0
            return rows

        last, hot = None, False
        for batch in batches:
            out = []
            for segment, anchor, copies, content in zip(*(batch.column(c).to_pylist() for c in ("segment", "anchor", "copies", "content"))):
                if anchor != last:
                    if sizes[0] + sizes[1] > shard_bytes:
                        out += shard()
                    whole += group
                    sizes[0] += sizes[1]
                    group, sizes[1], last, hot = [], 0, anchor, False
                if not hot:
                    group.append((segment, content, copies))
                    sizes[1] += len(content)
                    if sizes[1] > shard_bytes and len(anchors) > 1:
                        hot = True
                        out += [(s, True, None) for s, _, _ in group]
                        group, sizes[1] = [], 0
                else:
                    out.append((segment, True, None))
            if out:
                yield table(out)
        out = []
        if sizes[0] + sizes[1] > shard_bytes:
            out += shard()
        whole += group
        sizes[0] += sizes[1]
        out += shard()
        if out:
            yield table(out)

    found = stage(shards.select("segment", "anchor", "copies", "content").mapInArrow(sort, SPANS), "repeats")
    spans = found.where("not hot").select("segment", "spans")
    if len(anchors) > 1 and not found.where("hot").isEmpty():
        hot = cuts.join(found.where("hot").select("segment"), "segment").groupBy("segment").agg(
            F.sum("copies").alias("copies"), F.first("content").alias("content"))
        again = hot.select(F.col("segment").alias("unit"), "content", "copies")
        spans = spans.unionByName(_repeats(stage(again, "hot"), window, anchors[1:], shard_bytes).withColumnRenamed("unit", "segment"))
    placed = cuts.select("unit", "start", "segment").join(spans, "segment").select("unit", F.explode(F.transform(
        "spans", lambda s: F.struct((F.col("start") + s["a"]).alias("a"), (F.col("start") + s["b"]).alias("b")))).alias("s"))
    return placed.groupBy("unit").agg(F.collect_set("s").alias("spans"))


def row_key(doc_id: Column, text: Column) -> Column:
    """Key of equal rows: they share one result."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), text)))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 400,
                   anchors: tuple[int, ...] = (64, 320, 392, 400), shard_bytes: int = 2 << 20, with_kept: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_kept`` the kept bytes.

    Each byte covered by a string of ``window`` bytes that also starts anywhere else in the table, the same text
    included, is removed; overlaps count.  Null is an empty text; texts shorter than a window keep all.  Repeated rows
    repeat each other's strings.  ``anchors`` are the lengths of the strings that shard the windows, tried in turn for
    anchors with more than ``shard_bytes`` of different segments; the last is the window itself.
    """
    if anchors[-1] != window:
        anchors = tuple(a for a in anchors if a < window) + (window,)
    content = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), content.alias("content"))
    docs = docs.withColumn("unit", row_key(F.col("doc_id"), F.col("content")))
    units = docs.where(F.octet_length("content") >= window).select("unit", "content", F.lit(1).cast("long").alias("copies"))
    spans = _repeats(units, window, anchors, shard_bytes)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for data, runs in zip(batch.column("content").to_pylist(), batch.column("spans").to_pylist()):
                kept, at, removed, n_spans, end = [], 0, 0, 0, -1
                for a, b in sorted((r["a"], r["b"] + window - 1) for r in runs or ()):
                    if a > end:
                        kept.append(data[at:a])
                        n_spans += 1
                    removed += max(0, b - max(a, end))
                    end = at = max(end, b)
                kept.append(data[at:])
                rest = b"".join(kept)
                for c, v in zip(columns, (len(data), removed, n_spans, hashlib.sha256(rest).hexdigest(), rest)):
                    c.append(v)
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_kept:
                arrays.append(pa.array(columns[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    out = docs.join(spans, "unit", "left").select("doc_id", "content", "spans")
    return out.mapInArrow(drop, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else ""))
