"""Language identification by a small convolutional network over bytes.

Text is lower-cased, encoded as UTF-8 and cut into windows of fixed length that
overlap by the widest filter less one, so every byte sequence is seen whole.
Filters of several widths slide over byte embeddings, each keeps its maximum
over the window, and a softmax over those maxima gives the window's language.
A text's probabilities are the mean over its windows, weighed by their bytes.

Training is plain numpy on all windows of a bounded sample of labelled rows
(``TRAIN_DOCS``). A filter over embeddings is a sum of one term
per byte, so a trained network is applied through tables of byte pairs.

Cases: null text, and text without a letter, is ``und`` with score 0; short
texts are padded with spaces to one window; very long texts are windowed whole;
repeated rows get equal answers; of languages with equal means the first in
code point order is taken; with no labelled row at all everything is
``und``; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import documents, fold, only
from ridgeline.llm.registry import query
from ridgeline.llm.sampling import training_sample

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
STRIDE = WINDOW - max(WIDTHS) + 1
PAD = 0x20
TRAIN_DOCS = 1600
EPOCHS = 2
BATCH = 64
RATE = 0.01
BLOCK = 2048


def has_letter(text: str) -> bool:
    """Fractions, superscripts and numerals in letters' clothes are no letters."""
    return any(map(str.isalpha, text))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes of each); a text without bytes has one window."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE))
    room = counts * STRIDE + WINDOW - STRIDE
    data = np.frombuffer(b"".join(t.ljust(n, bytes([PAD])) for t, n in zip(texts, room.tolist(), strict=True)), dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(np.cumsum(room) - room, counts) + inside * STRIDE
    fill = np.clip(sizes[owner] - inside * STRIDE, 1, WINDOW)
    return np.lib.stride_tricks.sliding_window_view(data, WINDOW)[starts], owner, fill


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class ByteNetwork:
    languages: list[str]
    embedding: np.ndarray           # 256 x EMBEDDING
    filters: list[np.ndarray]       # one array (width, EMBEDDING, FILTERS) for each width
    bias: np.ndarray                # of the pooled maxima
    dense: np.ndarray               # pooled x languages
    dense_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> ByteNetwork:
        f = lambda *s: (rng.normal(size=s) * 0.3).astype(np.float32)
        pooled = FILTERS * len(WIDTHS)
        return cls(languages, f(256, EMBEDDING), [f(w, EMBEDDING, FILTERS) for w in WIDTHS],
                   np.zeros(pooled, np.float32), f(pooled, len(languages)), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.dense, self.dense_bias]

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        """For each width, what byte pairs (and a last odd byte) add to its filters."""
        out = []
        for f in self.filters:
            part = np.einsum("be,wef->wbf", self.embedding, f)
            pairs = [(part[i][:, None] + part[i + 1][None]).reshape(65536, -1) for i in range(0, len(f) - 1, 2)]
            out.append(tuple(np.ascontiguousarray(x) for x in pairs + ([part[-1]] if len(f) % 2 else [])))
        return out

    def probabilities(self, data: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        out = np.empty((len(data), len(self.languages)), np.float32)
        for at in range(0, len(data), BLOCK):
            x = data[at:at + BLOCK]
            pairs = (x[:, :-1].astype(np.intp) << 8) | x[:, 1:]
            pooled = []
            for width, parts in zip(WIDTHS, tables, strict=True):
                n = WINDOW - width + 1
                total = parts[0].take(pairs[:, :n], axis=0)
                for i, t in enumerate(parts[1:], 1):
                    total += t.take(pairs[:, 2 * i:2 * i + n] if len(t) == 65536 else x[:, 2 * i:2 * i + n], axis=0)
                pooled.append(total.max(axis=1))
            h = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
            out[at:at + BLOCK] = softmax(h @ self.dense + self.dense_bias)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over one batch."""
        e = self.embedding[x]
        rows = np.arange(len(x))[:, None]
        best, pooled, seen = [], [], []
        for f in self.filters:
            w = len(f)
            v = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * EMBEDDING)
            a = v @ f.reshape(w * EMBEDDING, FILTERS)
            at = a.argmax(axis=1)
            best.append(at)
            pooled.append(np.take_along_axis(a, at[:, None], axis=1)[:, 0])
            seen.append(v[rows, at])                       # batch x filters x (w * embedding)
        h = np.concatenate(pooled, axis=1) + self.bias
        p = softmax(np.maximum(h, 0) @ self.dense + self.dense_bias)
        d = p.copy()
        d[np.arange(len(x)), y] -= 1
        d /= len(x)
        dense, dense_bias = np.maximum(h, 0).T @ d, d.sum(axis=0)
        back = (d @ self.dense.T) * (h > 0)
        embedding, filters = np.zeros_like(self.embedding), []
        for i, f in enumerate(self.filters):
            w, g = len(f), back[:, i * FILTERS:(i + 1) * FILTERS]
            filters.append(np.einsum("bf,bfk->kf", g, seen[i]).reshape(f.shape))
            into = g[:, :, None, None] * f.transpose(2, 0, 1)[None]          # batch x filters x w x embedding
            where = x[rows[:, :, None], best[i][:, :, None] + np.arange(w)]
            np.add.at(embedding, where, into)
        return [embedding, *filters, back.sum(axis=0), dense, dense_bias]


def train(texts: list[str], labels: list[str], seed: int = 1) -> ByteNetwork | None:
    """Adam over all windows of the texts, shuffled; None without a single labelled text."""
    pairs = [(t.lower().encode(), y) for t, y in zip(texts, labels, strict=True) if t and y is not None and has_letter(t)]
    if not pairs:
        return None
    languages = sorted({y for _, y in pairs})
    data, owner, _ = windows([t for t, _ in pairs])
    rng = np.random.default_rng(seed)
    order = np.arange(len(data))
    target = np.array([languages.index(y) for _, y in pairs])[owner]
    net = ByteNetwork.fresh(languages, rng)
    mean, square, step = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            own, step = order[at:at + BATCH], step + 1
            for p, g, m, s in zip(net.parameters(), net.gradients(data[own], target[own]), mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def identify(docs: DataFrame, net: ByteNetwork | None) -> DataFrame:
    """(doc_id, text, …) with ``lang_pred`` and ``score``; the text itself is dropped."""
    kept = [c for c in docs.columns if c != "text"]
    if net is None:
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if t and has_letter(t)]
            for at in range(0, len(some), 256):
                own = some[at:at + 256]
                data, owner, fill = windows([texts[i].lower().encode() for i in own])
                p = net.probabilities(data, tables) * fill[:, None]
                total = np.zeros((len(own), len(net.languages)))
                np.add.at(total, owner, p)
                total /= np.bincount(owner, fill)[:, None]
                best[own], score[own] = total.argmax(axis=1), np.minimum(1.0, total.max(axis=1))
            names = pa.array([net.languages[k] if k >= 0 else "und" for k in best], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(b.schema.get_field_index(c)) for c in kept], names, pa.array(score, pa.float64())],
                [*kept, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


HELD_OUT = 2


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned outside the held-out quarter."""
    docs = only(documents(spark, sf_dir), doc_id="doc_id", text="text", lang="lang")
    out = fold(F.col("doc_id"), 4) == HELD_OUT
    seen = training_sample(docs, ~out & F.col("lang").isNotNull() & F.col("text").isNotNull(), TRAIN_DOCS, "lang").collect()
    net = train([r["text"] for r in seen], [r["lang"] for r in seen])
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), net)
