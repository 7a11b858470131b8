"""Language identification by a convolutional network over bytes.

A text is cut into windows of fixed length that overlap by less than the widest filter, so that each of its byte strings lies
in a window.  Byte classes are embedded, filters of several widths run over the window, the maximum of each filter is taken
and a softmax layer gives the languages.  The network is trained in NumPy on windows of labelled texts.  A text's scores are
the windows' probabilities, weighted by their letters.

Applying a filter to embedded bytes is a sum of one table entry per byte, so scoring looks the entries of byte pairs up
instead of multiplying.
"""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import pick, stage

WIDTHS, FILTERS, EMBEDDED, LENGTH = (2, 3, 4), 16, 8, 256
STRIDE = LENGTH - max(WIDTHS) + 1
#: Classes of bytes: padding, white space, digits, other ASCII, small letters (capitals count as these), 128 of other bytes.
PAD, SPACE, DIGIT, OTHER, LETTER = 0, 1, 2, 3, 4
CLASSES = LETTER + 26 + 128
UNKNOWN = "und"


def _byte_classes() -> np.ndarray:
    classes = np.full(256, OTHER, np.uint8)
    classes[[9, 10, 11, 12, 13, 32]], classes[ord("0"):ord("9") + 1] = SPACE, DIGIT
    classes[ord("a"):ord("z") + 1] = classes[ord("A"):ord("Z") + 1] = np.arange(LETTER, LETTER + 26)
    classes[128:] = np.arange(LETTER + 26, CLASSES)
    return classes


BYTE_CLASSES = _byte_classes()


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n x LENGTH byte classes) of all texts, and how many each text has; an empty text has none."""
    sizes = np.array([len(t) for t in texts], np.int64)
    count = np.where(sizes > 0, np.maximum(1, -(-(sizes - LENGTH) // STRIDE) + 1), 0)
    room = np.where(count > 0, (count - 1) * STRIDE + LENGTH, 0)
    ends = np.cumsum(room)
    laid = np.full(int(room.sum()), PAD, np.uint8)
    for text, end, size in zip(texts, (ends - room).tolist(), sizes.tolist()):
        laid[end:end + size] = BYTE_CLASSES[np.frombuffer(text, np.uint8)]
    first = np.repeat(ends - room - STRIDE * (np.cumsum(count) - count), count) + STRIDE * np.arange(int(count.sum()))
    if not len(first):
        return np.zeros((0, LENGTH), np.uint8), count
    return np.lib.stride_tricks.sliding_window_view(laid, LENGTH)[first], count


@dataclass
class Network:
    """``embedding``: CLASSES x EMBEDDED; a filter bank (width x EMBEDDED x FILTERS) and bias per width; output weights and bias."""
    languages: list[str]
    embedding: np.ndarray
    banks: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def random(cls, languages: list[str], seed: int) -> "Network":
        r = np.random.default_rng(seed)
        normal = lambda *shape: r.standard_normal(shape).astype(np.float32)
        return cls(languages, normal(CLASSES, EMBEDDED) / 2, [normal(w, EMBEDDED, FILTERS) / np.sqrt(w * EMBEDDED) for w in WIDTHS],
                   [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(len(WIDTHS) * FILTERS, len(languages)) / 10,
                   np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.banks, *self.biases, self.weights, self.bias]

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter in every window, and where it is, by plain convolution."""
        n, e = len(x), self.embedding[x]
        most, place = [], []
        for width, bank, bias in zip(WIDTHS, self.banks, self.biases):
            patches = np.lib.stride_tricks.sliding_window_view(e, width, axis=1).transpose(0, 1, 3, 2).reshape(-1, width * EMBEDDED)
            out = (patches @ bank.reshape(-1, FILTERS) + bias).reshape(n, -1, FILTERS)
            place.append(out.argmax(1))
            most.append(np.take_along_axis(out, place[-1][:, None], 1)[:, 0])
        return np.concatenate(most, 1), np.concatenate(place, 1)

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        logits = np.maximum(pooled, 0) @ self.weights + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy and its derivatives, in the order of ``parameters``."""
        pooled, place = self.pooled(x)
        p = self.probabilities(pooled)
        rows = np.arange(len(x))
        loss = float(-np.log(p[rows, y] + 1e-12).mean())
        p[rows, y] -= 1
        p /= len(x)
        back = (p @ self.weights.T) * (pooled > 0)
        embedding, banks, biases = np.zeros_like(self.embedding), [], []
        for k, (width, bank) in enumerate(zip(WIDTHS, self.banks)):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            g = back[:, own]  # only the place of the maximum has a derivative
            seen = x[rows[:, None, None], place[:, own, None] + np.arange(width)]  # n x FILTERS x width
            banks.append(np.einsum("nf,nfwe->wef", g, self.embedding[seen], optimize=True))
            biases.append(g.sum(0))
            np.add.at(embedding, seen, g[:, :, None, None] * bank.transpose(2, 0, 1)[None])
        return loss, [embedding, *banks, *biases, np.maximum(pooled, 0).T @ p, p.sum(0)]


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 128, step: float = 0.01, seed: int = 17) -> Network:
    """Adam on shuffled batches; the step falls to a tenth."""
    net, random = Network.random(languages, seed), np.random.default_rng(seed)
    held = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    total, t = epochs * -(-len(x) // batch), 0
    for _ in range(epochs):
        order = random.permutation(len(x))
        for at in range(0, len(x), batch):
            chosen, t = order[at:at + batch], t + 1
            _, found = net.gradients(x[chosen], y[chosen])
            rate = step * (1 - 0.9 * t / total)
            for p, g, (m, v) in zip(net.parameters(), found, held):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """The network with filters applied by lookup: a table of responses per byte class, or per pair of them."""

    def __init__(self, net: Network):
        self.net = net
        self.tables = []  # per width: (place in the window, table of pairs or of single classes)
        for bank, bias in zip(net.banks, net.biases):
            single = [(net.embedding @ part).astype(np.float32) for part in bank]
            single[0] = single[0] + bias
            own = []
            for at in range(0, len(single) - 1, 2):
                own.append((at, True, (single[at][:, None] + single[at + 1][None]).reshape(-1, FILTERS)))
            if len(single) % 2:
                own.append((len(single) - 1, False, single[-1]))
            self.tables.append(own)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
        for at in range(0, len(x), 64):  # so many windows stay in the processor's cache
            part = x[at:at + 64]
            pairs = part[:, :-1].astype(np.int32) * CLASSES + part[:, 1:]
            for k, (width, own) in enumerate(zip(WIDTHS, self.tables)):
                steps, total = LENGTH - width + 1, None
                for place, is_pair, table in own:
                    found = table[(pairs if is_pair else part)[:, place:place + steps]]
                    total = found if total is None else np.add(total, found, out=total)
                out[at:at + 64, k * FILTERS:(k + 1) * FILTERS] = total.max(1)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of each language for each text: the mean over its windows, weighted by letters; evenly spread without any."""
        out = np.full((len(texts), len(self.net.languages)), 1 / max(1, len(self.net.languages)))
        x, count = windows(texts)
        if not len(x):
            return out
        letters = (x >= LETTER).sum(1)
        owner = np.repeat(np.arange(len(texts)), count)
        p = self.net.probabilities(self.pooled(x)).astype(np.float64) * letters[:, None]
        total = np.zeros_like(out)
        np.add.at(total, owner, p)
        weight = np.bincount(owner, letters, minlength=len(texts))
        some = weight > 0
        out[some] = total[some] / weight[some, None]
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, max_windows: int, per_text: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows with their language: of rows with text, lang and doc_id that are not held out, about ``max_windows`` in all and the same
    for each language.  Texts are chosen by a hash of doc_id and text, and up to ``per_text`` windows spread over each."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    wanted = F.least(F.lit(per_text), F.ceil(F.octet_length("text") / STRIDE))
    usable = usable.select("lang", "text", wanted.alias("wanted"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("mark"))
    sizes = usable.groupBy("lang").agg(F.sum("wanted").alias("n"))
    n_languages = sizes.count()
    if not n_languages:
        return np.zeros((0, LENGTH), np.uint8), np.zeros(0, np.int64), []
    share = sizes.select("lang", (F.lit(float(max_windows)) / n_languages / F.col("n")).alias("share"))
    chosen = usable.join(F.broadcast(share) if n_languages <= 1000 else share, "lang").where(F.col("mark") < F.col("share") * (1 << 30))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, mark, taken = [], [], []
            for row in batch.to_pylist():
                x, _ = windows([row["text"].encode()])
                x = x[(x >= LETTER).sum(1) > 0]
                for i in sorted({i * len(x) // per_text for i in range(per_text)} if len(x) else ()):
                    lang.append(row["lang"])
                    mark.append(row["mark"])
                    taken.append(x[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(mark, pa.int64()), pa.array(taken, pa.binary())], ["lang", "mark", "x"])

    cut_out = stage(chosen.select("lang", "mark", "text").mapInArrow(cut, "lang string, mark long, x binary"), "training")
    rows = sorted(tuple(r) for r in cut_out.select("lang", "mark", "x").collect())  # about max_windows rows of LENGTH bytes
    languages = sorted({r[0] for r in rows})
    number = {name: i for i, name in enumerate(languages)}
    return (np.frombuffer(b"".join(bytes(r[2]) for r in rows), np.uint8).reshape(-1, LENGTH), np.array([number[r[0]] for r in rows], np.int64), languages)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_windows: int = 8000, per_text: int = 2,
             **training) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred and score (the probability of lang_pred).

    The network learns from text and lang of a sample of rows that are not held out, about ``max_windows`` windows with as many
    for each language (documented bound; every text is scored, in all its windows).  A null or empty text and one without any letter
    is ``und`` with score 0, and so is every text if nothing could be learned.  With one language all others have it.  Rows without
    doc_id or lang are scored and not learned from; repeated rows are scored each; texts of any length are read whole, a MB of
    texts at a time; an empty table gives no rows.  lang, source and doc_id are never inputs of a score.
    """
    docs = pick(docs, doc_id=doc_id, text=text, lang=lang)
    x, y, languages = sample(docs, max_windows, per_text)
    net = train(x, y, languages, **training) if languages else None
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(letters, F.col("text").cast("binary")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for whole in batches:
            for batch in _slices(whole):
                best, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
                texts = batch.column("content").to_pylist()
                some = [i for i, t in enumerate(texts) if t]
                if scorer and some:
                    p = scorer.scores([texts[i] for i in some])
                    for i, at, s in zip(some, p.argmax(1).tolist(), p.max(1).tolist()):
                        best[i], score[i] = languages[at], min(s, 1.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best), pa.array(score)],
                                                 ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def _slices(batch: pa.RecordBatch, slice_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    at, total = 0, 0
    for i, value in enumerate(batch.column("content")):
        total += len(value.as_buffer() or b"") if value.is_valid else 0
        if total >= slice_bytes:
            yield batch.slice(at, i + 1 - at)
            at, total = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)
