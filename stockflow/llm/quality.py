"""Quality classifier (operator 9): a byte-level convolutional network.

A document is read as UTF-8 bytes. Each byte has a learned vector; learned
filters of 8 bytes slide over the whole text in steps of 4; their responses
are max-pooled in overlapping chunks of 1,024 bytes (each shares 64 with the
next); a small dense layer turns a chunk into a logit, and the mean logit of
all chunks becomes the document's probability of label 1.

Training runs in numpy on the whole texts of a bounded sample of labelled rows
(``TRAIN_DOCS`` of each class, never fold 0): all their chunks come to the driver,
and a gradient reads them in blocks, so beside those texts its memory does not
depend on their length. The sample is balanced; the output is then shifted to the
classes' shares among all labelled rows. Scoring reads every
byte of every text, in blocks, so a text of any length needs bounded memory.

Null and empty texts are scored as eight zero bytes. Repeated rows get equal
scores. Without labels of both classes nothing can be learned: then every
document scores 0.5 and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType, StructField, IntegerType, BinaryType, LongType

from stockflow.llm.common import class_sizes, fold, labelled_sample

STRIDE, WIDTH, DIM, FILTERS, HIDDEN = 4, 8, 4, 64, 32
CHUNK, OVERLAP = 1024, 64
POOL, STEP = CHUNK // STRIDE, (CHUNK - OVERLAP) // STRIDE
TRAIN_DOCS, EPOCHS, BATCH = 2000, 8, 64
#: A small sample is gone through more often, until this many steps are made.
LEAST_STEPS = 500
KEEP = 0.3
#: Chunks whose filter responses are held at once while scoring and fitting.
BLOCK = 64


def _padded(raw: bytes) -> np.ndarray:
    """Bytes as an array, zero-filled to whole steps and to one filter width at least."""
    n = max(WIDTH, -(-len(raw) // STRIDE) * STRIDE)
    return np.frombuffer(raw.ljust(n, b"\0"), np.uint8)


class ByteConvNet:
    """The network's parameters, its gradient steps and its scores."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        g = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {"emb": g(256, DIM, k=0.5), "conv": g(WIDTH * DIM, FILTERS, k=(WIDTH * DIM) ** -0.5),
                  "bias": np.zeros(FILTERS, np.float32), "w1": g(FILTERS, HIDDEN, k=FILTERS ** -0.5),
                  "b1": np.zeros(HIDDEN, np.float32), "w2": g(HIDDEN, k=HIDDEN ** -0.5),
                  "b2": np.zeros(1, np.float32)}

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Filter responses at each step of ``data``."""
        half = STRIDE * DIM
        x = self.p["emb"][data].reshape(-1, half)
        return x[:-1] @ self.p["conv"][:half] + x[1:] @ self.p["conv"][half:]

    def dense(self, pooled: np.ndarray) -> np.ndarray:
        """A logit for each chunk's pooled responses."""
        a = np.maximum(pooled + self.p["bias"], 0)
        return np.maximum(a @ self.p["w1"] + self.p["b1"], 0) @ self.p["w2"] + self.p["b2"][0]

    def score(self, text: str | None) -> float:
        """Probability of label 1 for one whole text."""
        data = _padded((text or "").encode("utf-8", "replace"))
        steps = data.size // STRIDE - 1
        starts = np.arange(0, max(steps - (POOL - STEP), 1), STEP)
        total = 0.0
        for k in range(0, starts.size, BLOCK):
            own = starts[k:k + BLOCK]
            first, last = own[0], min(own[-1] + POOL, steps)
            h = self.responses(data[first * STRIDE:(last + 1) * STRIDE])
            pooled = np.stack([h[s - first:s - first + POOL].max(0) for s in own])
            total += float(self.dense(pooled).sum())
        return float(1 / (1 + np.exp(-np.clip(total / starts.size, -30, 30))))

    def fit(self, chunks: np.ndarray, doc: np.ndarray, y: np.ndarray, epochs: int = EPOCHS,
            rate: float = 4e-3, seed: int = 5) -> None:
        """Adam steps on documents given as chunks.

        ``chunks``: (n, CHUNK + STRIDE) bytes, ``doc``: each chunk's document
        (0.., ascending), ``y``: each document's label. The gradient of the
        max passes only through the winning window of each filter.
        """
        r, n = np.random.default_rng(seed), y.size
        first, last = np.searchsorted(doc, np.arange(n)), np.searchsorted(doc, np.arange(n), "right")
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2, t = {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        epochs = max(epochs, -(-LEAST_STEPS // -(-n // BATCH)))
        total = epochs * -(-n // BATCH)
        for _ in range(epochs):
            order = r.permutation(n)
            for at in range(0, n, BATCH):
                own = order[at:at + BATCH]
                rows = np.concatenate([np.arange(first[i], last[i]) for i in own])
                size = last[own] - first[own]
                g = self._gradient(chunks[rows], np.repeat(np.arange(own.size), size), size, y[own])
                t += 1
                lr = rate * (1 - t / (total + 1))
                for k, d in g.items():
                    m[k] += 0.1 * (d - m[k])
                    v2[k] += 0.001 * (d * d - v2[k])
                    self.p[k] -= lr * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v2[k] / (1 - 0.999 ** t)) + 1e-8)

    def _winners(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk and filter the step of the largest response, and that response."""
        half = STRIDE * DIM
        x = self.p["emb"][data].reshape(len(data), -1, half)
        h = x[:, :-1] @ self.p["conv"][:half] + x[:, 1:] @ self.p["conv"][half:]
        win = h.argmax(1)
        return win, np.take_along_axis(h, win[:, None], 1)[:, 0]

    def _gradient(self, data: np.ndarray, doc: np.ndarray, size: np.ndarray, y: np.ndarray) -> dict:
        p, blocks = self.p, [slice(at, at + BLOCK) for at in range(0, len(data), BLOCK)]
        won = [self._winners(data[k]) for k in blocks]
        z = np.concatenate([h for _, h in won]) + p["bias"]
        a = np.maximum(z, 0)
        u = a @ p["w1"] + p["b1"]
        b = np.maximum(u, 0)
        logit = np.bincount(doc, b @ p["w2"] + p["b2"][0], size.size) / size
        d_logit = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / size.size / size)[doc].astype(np.float32)
        d_b = d_logit[:, None] * p["w2"] * (u > 0)
        d_a = (d_b @ p["w1"].T) * (z > 0)
        g = {"w2": b.T @ d_logit, "b2": d_logit.sum(keepdims=True), "w1": a.T @ d_b, "b1": d_b.sum(0),
             "bias": d_a.sum(0), "conv": np.zeros_like(p["conv"]), "emb": np.zeros_like(p["emb"])}
        for k, (win, _) in zip(blocks, won):
            rows = np.arange(len(win))[:, None, None]
            at = data[k][rows, (win * STRIDE)[:, :, None] + np.arange(WIDTH)]
            xw = p["emb"][at].reshape(*win.shape, WIDTH * DIM)
            g["conv"] += np.einsum("nfk,nf->kf", xw, d_a[k])
            back = (d_a[k][:, :, None] * p["conv"].T[None]).reshape(-1, DIM)
            for c in range(DIM):
                g["emb"][:, c] += np.bincount(at.ravel(), back[:, c], 256)
        return g


def _chunks(raw: bytes) -> list[bytes]:
    """All chunks of a document, zero-filled."""
    steps = _padded(raw).size // STRIDE - 1
    starts = range(0, max(steps - (POOL - STEP), 1) * STRIDE, STEP * STRIDE)
    return [raw[s:s + CHUNK + STRIDE].ljust(CHUNK + STRIDE, b"\0") for s in starts]


_CHUNK_SCHEMA = StructType([StructField("id", LongType()), StructField("y", IntegerType()),
                            StructField("part", BinaryType())])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, y, c) for i, t, y in zip(b["__id"], b["text"], b["y"])
                for c in _chunks(t.encode("utf-8", "replace"))]
        yield pd.DataFrame(rows, columns=["id", "y", "part"])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> ByteConvNet | None:
    """Fit the network on ``labels.quality`` outside fold 0; None if a class has no row."""
    sample = labelled_sample(docs, labels, "quality", limit).mapInPandas(_cut, _CHUNK_SCHEMA).toPandas()
    if sample["y"].nunique() < 2:
        return None
    sample = sample.sort_values(["id", "part"], kind="stable")
    doc, ids = pd.factorize(sample["id"])
    y = sample.groupby(doc)["y"].first().to_numpy(np.float32)
    chunks = np.frombuffer(b"".join(sample["part"]), np.uint8).reshape(-1, CHUNK + STRIDE)
    net = ByteConvNet()
    net.fit(chunks, doc, y)
    share = class_sizes(labels, "quality")
    net.p["b2"] += np.float32(np.log(share[1] / share[0] * (y == 0).sum() / (y == 1).sum()))
    return net


def score_column(net: ByteConvNet | None, text: Column) -> Column:
    """The score of each text, 0 to 1; 0.5 without a network."""
    if net is None:
        return F.lit(0.5)

    @F.pandas_udf(DoubleType())
    def quality_score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([net.score(t) for t in s], dtype="float64")

    return quality_score(text)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    net = train(docs, labels)
    return (docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"),
                        score_column(net, F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= KEEP).cast("int")))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts as 1, all columns as they were."""
    net = train(docs, labels)
    return docs.filter(score_column(net, F.col("text")) >= KEEP)
