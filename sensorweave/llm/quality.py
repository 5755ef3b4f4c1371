"""Quality classifier: random-indexing vectors pooled by document, then a two-layer network.

Each token gives two features: its word (hashed to ``WORD_BUCKETS``) and its shape (character classes,
length, whether it repeats one of the two tokens before it).  A feature's vector is learned by random
indexing: every feature has a sparse ternary index vector, and its word vector is its own index vector
plus the sum of those of the words around it, scaled to length 1.  A document is the mean of its
tokens' vectors, with its length and share of repeated tokens; a network of two layers in numpy maps
this to a logit, and a temperature fitted on rows set aside turns logits into probabilities.

Defined results: a null, empty or blank text has the zero vector and gets a score like any other; a
text of any length is pooled whole.  Other columns are left out of the result, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorweave.llm._flat import byte_buffer, chunks, token_hashes, token_spans
from sensorweave.llm._labels import held_out, labelled_sample
from sensorweave.llm._shared import small_batches

#: Labelled rows that the classifier (vectors, network, temperature) is fitted on, at most.
MAX_FIT_ROWS = 20_000
WORD_BUCKETS = 1 << 13
SHAPES = 1 << 12
DIM = 32
SPREAD = 4  # non-zero places of an index vector
HIDDEN = 32
WINDOW = 2


def _classes() -> np.ndarray:
    """Bits of each byte: 1 lower case, 2 upper case, 4 digit, 8 sentence mark, 16 exclamation, 32 bar, 64 other sign, 128 not ASCII."""
    out = np.full(256, 64, np.uint8)
    out[ord("a") : ord("z") + 1] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 4
    for c in ".,;:'\"-()":
        out[ord(c)] = 8
    for c in "!?":
        out[ord(c)] = 16
    out[ord("|")] = 32
    out[128:] = 128
    out[[*range(33)]] = 0
    return out


_CLASS = _classes()


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket and shape of every token, and the token counts of the texts."""
    buf, offsets = byte_buffer(texts)
    bits = _CLASS[buf]
    starts, ends, counts = token_spans(bits > 0, offsets)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), counts
    lower = buf.copy()
    lower[bits == 2] += 32
    hashes = token_hashes(lower, starts, ends)
    shape = np.bitwise_or.reduceat(bits, starts).astype(np.int32)
    length = np.digitize(ends - starts, [3, 6, 11]).astype(np.int32)
    first_upper = (bits[starts] == 2) & (np.add.reduceat((bits == 2).astype(np.int32), starts) == 1)
    repeated = np.zeros(len(starts), np.int32)
    for k in (1, 2):
        repeated[k:] |= hashes[k:] == hashes[:-k]
    shape = shape | length << 8 | repeated << 10 | first_upper.astype(np.int32) << 11
    return (hashes >> np.uint64(64 - 13)).astype(np.int32), shape, counts


def _index_vectors(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.float32)
    places = rng.random((n, DIM)).argsort(axis=1)[:, :SPREAD]
    out[np.arange(n)[:, None], places] = rng.choice([-1, 1], (n, SPREAD))
    return out


def _sum_by(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows summed by key."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    order = np.argsort(keys, kind="stable")
    found, starts = np.unique(keys[order], return_index=True)
    if len(found):
        out[found] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def context_sums(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the neighbours' index vectors by word bucket and by shape."""
    index = _index_vectors(WORD_BUCKETS, 1)
    words, shapes, counts = features(texts)
    doc = np.repeat(np.arange(len(counts)), counts)
    around = np.zeros((len(words), DIM), np.float32)
    for k in range(1, WINDOW + 1):
        if len(words) > k:
            same = (doc[k:] == doc[:-k]).astype(np.float32)[:, None]
            around[k:] += index[words[:-k]] * same
            around[:-k] += index[words[k:]] * same
    return _sum_by(words, around, WORD_BUCKETS), _sum_by(shapes, around, SHAPES)


@dataclass
class QualityModel:
    """Vectors, network and temperature."""

    words: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """One row of features by text."""
        return pool(texts, self.words, self.shapes)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        out = [np.zeros(0)]
        for a, b in chunks(texts):
            out.append(1 / (1 + np.exp(-np.clip(self.logits(self.pooled(texts[a:b])) / self.temperature, -40, 40))))
        return np.concatenate(out)


def pool(texts: list[str | None], words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    w, s, counts = features(texts)
    out = np.zeros((len(texts), 2 * DIM + 2), np.float32)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        n = counts[full][:, None]
        out[full, :DIM] = np.add.reduceat(words[w], starts, axis=0) / n
        out[full, DIM : 2 * DIM] = np.add.reduceat(shapes[s], starts, axis=0) / n
        out[full, -1] = np.add.reduceat((s >> 10 & 1).astype(np.float32), starts) / n[:, 0]
    out[:, -2] = np.log1p(counts)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _vectors(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Random-indexing vectors from the texts of the sample; one partial table by task of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes = np.zeros((WORD_BUCKETS, DIM), np.float32), np.zeros((SHAPES, DIM), np.float32)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                w, s = context_sums(texts[a:b])
                words += w
                shapes += s
        yield pa.RecordBatch.from_arrays([pa.array([words.tobytes()], pa.binary()), pa.array([shapes.tobytes()], pa.binary())], names=["w", "s"])

    words, shapes = np.zeros((WORD_BUCKETS, DIM), np.float32), np.zeros((SHAPES, DIM), np.float32)
    for row in sample.select("text").mapInArrow(run, "w binary, s binary").toLocalIterator():
        words += np.frombuffer(bytes(row["w"]), np.float32).reshape(words.shape)
        shapes += np.frombuffer(bytes(row["s"]), np.float32).reshape(shapes.shape)
    return _unit(_unit(words) + 0.5 * _unit(_index_vectors(WORD_BUCKETS, 1))), _unit(0.3 * _unit(shapes) + _unit(_index_vectors(SHAPES, 2)))


def _train(x: np.ndarray, y: np.ndarray, steps: int = 1500, rate: float = 0.01, decay: float = 1e-3) -> list[np.ndarray]:
    """Adam on the log loss with weight decay; the seed is fixed, so equal data give an equal network."""
    rng = np.random.default_rng(0)
    layers = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(())]
    first, second = [np.zeros_like(v) for v in layers], [np.zeros_like(v) for v in layers]
    for step in range(1, steps + 1):
        at = rng.integers(0, len(x), min(512, len(x)))
        w1, b1, w2, b2 = layers
        a = x[at] @ w1 + b1
        h = np.maximum(a, 0)
        g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - y[at]) / len(at)
        gh = np.outer(g, w2) * (a > 0)
        grads = [x[at].T @ gh + decay * w1, gh.sum(0), h.T @ g + decay * w2, g.sum()]
        lr = rate * (1 - step / (steps + 1))
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad**2
            layers[i] = layers[i] - lr * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, among a geometric grid."""
    grid = np.geomspace(0.3, 6, 60)
    loss = [np.logaddexp(0, -np.where(y > 0, 1, -1) * logits / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))]) if len(y) else 1.0


def fit_quality(documents: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_FIT_ROWS) -> QualityModel:
    """Fits vectors, network and temperature on at most ``max_rows`` labelled rows outside the held-out fold.

    Without labelled rows of both kinds every score is the share of label 1, or 1 without any label.
    """
    small_batches(documents.sparkSession)
    sample = labelled_sample(documents, labels, label, max_rows)
    try:
        words, shapes = _vectors(sample)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                rows = np.concatenate([pool(texts[a:b], words, shapes) for a, b in chunks(texts)]) if texts else np.zeros((0, 2 * DIM + 2), np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(label), pa.array([r.tobytes() for r in rows], pa.binary()), batch.column("place")], names=["y", "x", "place"])

        rows = sample.select("text", label, F.xxhash64("doc_id").alias("place")).mapInArrow(run, "y int, x binary, place long").collect()
    finally:
        sample.unpersist()
    rows.sort(key=lambda r: r["place"])
    y = np.array([r["y"] for r in rows], np.float64)
    x = np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in rows]).reshape(len(rows), 2 * DIM + 2)
    if not len(y) or y.min() == y.max():
        bias = np.array(20.0 if not len(y) or y[0] else -20.0)
        return QualityModel(words, shapes, np.zeros(x.shape[1]), np.ones(x.shape[1]), [np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), bias])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    apart = np.arange(len(y)) % 10 == 0
    z = (x - mean) / scale
    model = QualityModel(words, shapes, mean, scale, _train(z[~apart], y[~apart]))
    model.temperature = _temperature(model.logits(x[apart]), y[apart])
    return model


def score(documents: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Key, held_out, score and predicted of every document; one pass, no shuffle."""
    small_batches(documents.sparkSession)
    df = documents.select(F.col(key), F.col(text), held_out(key, 5, 0).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.probabilities(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    return df.mapInArrow(run, f"{key} {documents.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.probabilities(batch.column(text).to_pylist()) >= threshold))

    return documents.mapInArrow(run, documents.schema)
