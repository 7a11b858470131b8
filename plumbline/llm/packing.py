"""Packing along a space-filling curve: hashed document vectors are projected to a few dimensions, documents are
range-sorted by Hilbert key, and neighbours on the curve fill sequences of tokens without gaps."""
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import pick, running_total, stage

DIMS, BITS, BUCKETS = 4, 12, 1024
END_ID = 1
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


@cache
def _projection() -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def point_of(text: bytes) -> np.ndarray:
    """Counts of hashed 4-byte strings, square-rooted, scaled to length 1 and projected; the origin for short texts."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(DIMS, np.float32)
    grams = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
    counts = np.sqrt(np.bincount(grams * np.uint32(2654435761) >> np.uint32(22), minlength=BUCKETS).astype(np.float32))
    return counts @ _projection() / np.linalg.norm(counts)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys of points in [-4, 4) per dimension (others are clipped) along the Hilbert curve (Skilling, 2004)."""
    dims = points.shape[1]
    x = np.clip((points + 4) / 8 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64).T.copy()
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(up, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> b & 1
    return key


SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)
TAIL = re.compile(b"(?<=[a-z])([" + re.escape(SYMBOLS) + rb"]+)(?=\s|$)")
#: a letter between U+00C0 and U+00FF, as UTF-8
LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
TAILED = re.compile(b"((?:[A-Za-z]|" + LATIN + b")+)([" + re.escape(SYMBOLS) + b"]*)")
#: Kinds of bytes: s symbol or control, c first byte of U+00C0 to U+00FF, x second byte of the two signs there, o first byte of others.
KINDS = bytes(
    ord("l" if chr(b).isalnum() else " " if chr(b).isspace() and b < 28 or b == 32 else "s") if b < 128
    else ord("x" if b in (0x97, 0xb7) else "l" if b < 0xc0 else "c" if b == 0xc3 else "o") for b in range(256))


def _chunked(text: bytes) -> list[bytes]:
    """Text between spaces.  The tokenizer lower-cases and parts letters from symbols: doing the first ahead, and the second
    where symbols are frequent or no two stand together, leaves fewer different chunks.  Texts that may hold special tokens stay
    as they are, and so do those with marks that the tokenizer joins to an ASCII letter before it lower-cases (U+0300 to U+0338:
    byte CC)."""
    if b"<|" not in text and b"\xcc" not in text:
        text = text.lower()
        kinds = text.translate(KINDS)
        if b"ss" not in kinds and b"o" not in kinds and b"cx" not in kinds:
            text = text.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n")
        elif 30 * (len(text) - len(text.translate(None, SYMBOLS))) > len(text):
            text = TAIL.sub(rb" \1", text)
    return text.split()


class _Chunks(dict):
    """Number of each chunk seen; new ones are numbered on the way and noted in ``new``."""

    def __init__(self, known: list[bytes]):
        super().__init__(zip(known, range(len(known))))
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number


@cache
def _tokenizer(path: str):
    """One per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


HELD_BYTES = 160 << 20


class Encoder:
    """Token ids of texts.  The tokenizer drops white space, so that what stands between spaces is encoded by itself, each
    such chunk once as long as it is held.  Chunks are held up to about ``held_bytes``: beyond it those seen more than
    once stay, the most frequent first, in half of the room."""

    #: of a chunk besides its letters: object, table entry, number, place of its ids
    ENTRY = 170

    def __init__(self, path: str, held_bytes: int = HELD_BYTES):
        self.tokenizer, self.held_bytes = _tokenizer(path), held_bytes
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        #: ids that end a word; where the vocabulary marks them, many plain words can be encoded as one text
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.chunks = _Chunks([b""])  # stands for the end of a document
        self.pool = np.array([END_ID], self.dtype)
        self.first, self.count, self.uses = np.zeros(1, np.int32), np.ones(1, np.int32), np.full(1, 2, np.int32)
        self.size = 0

    def _shrink(self) -> None:
        names = list(self.chunks)
        self.chunks.clear()  # before the smaller one is made
        cost = np.fromiter(map(len, names), np.int64, len(names)) + self.ENTRY + self.count * self.dtype.itemsize
        again = np.flatnonzero(self.uses[1:] > 1) + 1
        again = again[np.argsort(-self.uses[again], kind="stable")]
        kept = np.sort(np.append(again[np.cumsum(cost[again]) <= self.held_bytes // 2], 0))
        self.chunks, self.size = _Chunks([names[i] for i in kept.tolist()]), int(cost[kept].sum())
        count = self.count[kept]
        first = np.cumsum(count) - count
        self.pool = self.pool[np.repeat(self.first[kept] - first, count) + np.arange(count.sum())]
        self.first, self.count, self.uses = first.astype(np.int32), count, np.maximum(self.uses[kept] // 2, 1)

    def _words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of letters: encoded as one text where the vocabulary marks ends of words."""
        if words and self.ends.any():
            joined = np.array(self._ids([b" ".join(words)])[0], self.dtype)
            after = (np.flatnonzero(self.ends[joined]) + 1).tolist()
            if len(after) == len(words):
                return [joined[a:b] for a, b in zip([0, *after], after)]
        return [np.array(i, self.dtype) for i in self._ids(words)]

    def _learn(self, new: list[bytes]) -> None:
        """Chunks of letters, or of letters and symbols after them, take the ids of their letters and those of their symbols."""
        learned = len(self.count)
        parts, words, others = [], {}, {}
        for chunk in new:
            tailed = None if chunk.isalpha() else TAILED.fullmatch(chunk)  # isalpha of bytes: ASCII letters only
            letters = tailed[1] if tailed else chunk if chunk.isalpha() else None
            rest = tailed[2] or None if tailed else chunk if letters is None else None
            if letters is not None and self.chunks.get(letters, learned) >= learned:
                words[letters] = None
            if rest is not None:
                others[rest] = None
            parts.append((letters, rest))
        words = dict(zip(words, self._words(list(words))))
        others = dict(zip(others, (np.array(i, self.dtype) for i in self._ids(list(others)))))
        count, found = np.zeros(len(new), np.int32), []
        for i, (letters, rest) in enumerate(parts):
            if letters is not None:
                ids = words.get(letters)
                if ids is None:
                    n = self.chunks[letters]
                    ids = self.pool[self.first[n]:self.first[n] + self.count[n]]
                found.append(ids)
                count[i] += len(ids)
            if rest is not None:
                found.append(others[rest])
                count[i] += len(others[rest])
        self.first = np.concatenate([self.first, (len(self.pool) + np.cumsum(count) - count).astype(np.int32)])
        self.count = np.concatenate([self.count, count])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        self.pool = np.concatenate([self.pool, *found])
        self.size += sum(map(len, new)) + self.ENTRY * len(new) + self.dtype.itemsize * int(count.sum())

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, followed by END_ID."""
        if self.size > self.held_bytes:
            self._shrink()
        words = [_chunked(t) for t in texts]
        for w in words:
            w.append(b"")
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(words)), np.int32, int(sizes.sum()))
        if self.chunks.new:
            self._learn(self.chunks.new)
            self.chunks.new = []
        self.uses += np.bincount(at, minlength=len(self.uses)).astype(np.int32)
        count = self.count[at]
        ends = np.cumsum(count, dtype=np.int64)
        steps = np.repeat((self.first[at] - (ends - count)).astype(np.int32), count)
        ids = self.pool[steps + np.arange(len(steps), dtype=np.int32)]
        return np.split(ids, ends[np.cumsum(sizes)[:-1] - 1]) if texts else []


@cache
def encoder(path: str, held_bytes: int) -> Encoder:
    """One per worker process: tasks that follow each other keep the chunks learned, within the bound."""
    return Encoder(path, held_bytes)


def _keys(texts: list[bytes]) -> np.ndarray:
    return hilbert_keys(np.stack([point_of(t) for t in texts])) if texts else np.zeros(0, np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").to_pylist()]


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", sequence: int = 2048,
         with_ids: bool = False, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids``).

    Documents lie one after the other along the curve (ties by doc_id, then ids) and are cut at every multiple of
    ``sequence`` ids: every sequence but the last is full.  A null or empty text is the end id alone, a text of any length
    is cut like others, repeated rows are packed each, and an empty table gives no piece.  Further columns are not read.
    Texts are tokenised once and written; (key, doc_id, size) alone are range-sorted along the curve, running sizes give
    each document its place in the whole, and the place is joined back to the ids.  ``held_bytes`` bounds the learned chunks
    of a worker; with less room more is encoded again, to the same ids.
    """
    docs = pick(docs, doc_id=doc_id, text=text).select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, held_bytes)
        for whole in batches:
            for batch in _slices(whole):
                texts = _texts(batch)
                raw = [i.tobytes() for i in coder.encode(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(_keys(texts)), batch.column("doc_id"),
                     pa.array([len(i) // coder.dtype.itemsize for i in raw], pa.int64()), pa.array([zlib.crc32(i) for i in raw], pa.int64()),
                     pa.array([coder.dtype.itemsize] * len(raw), pa.int32()), pa.array(raw, pa.binary())],
                    ["row", "key", "doc_id", "n", "mark", "width", "ids"])
                del texts, raw

    rows = stage(docs.mapInArrow(tokenised, "row long, key long, doc_id long, n long, mark long, width int, ids binary"), "tokens")
    places = running_total(rows.select("row", "key", "doc_id", "mark", "n"), ["key", "doc_id", "mark", "row"], "begin", weight="n")
    placed = rows.select("row", "doc_id", "n", "width", "ids").join(places.select("row", "begin"), "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "ids"):
                out: list[tuple] = []
                pieces = []
                for doc, n, width, raw, begin in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "width", "ids", "begin"))):
                    ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                    start = 0
                    while start < n:
                        offset = (begin + start) % sequence
                        length = min(n - start, sequence - offset)
                        piece = ids[start:start + length]
                        out.append((doc, start, length, zlib.crc32(piece.tobytes()), n, (begin + start) // sequence, offset))
                        if with_ids:
                            pieces.append(piece.astype(np.int32))
                        start += length
                columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    columns.append(pa.array(pieces, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return placed.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def _slices(batch: pa.RecordBatch, column: str = "text", slice_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about two MB, so that values of few documents are held at once."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + slice_bytes, "right")))
        yield batch.slice(at, end - at)
        at = end
