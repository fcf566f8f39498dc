"""Quality classifier: a factorisation machine over hashed words, structure statistics and
metadata.

A document is a sparse vector: its different words, hashed and weighted by one over the
root of their number; statistics of its structure (symbols, capitals, line and word shapes,
repetition), each as one of 16 bins; and the binned metadata columns. The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so all pairs of features interact by way of ``rank`` factors at a cost that is linear in the
number of features. Fitting takes about ``fit_rows`` labelled documents at most; their sparse
vectors come to the driver, which runs Adam on minibatches. The model is broadcast, its size
fixed by ``bits`` and ``rank``.

Defined cases: a NULL text is scored as an empty one (structure and metadata only), NULL
metadata is a bin of its own, a NULL id is never learned from; a document with several labels
is learned as each of them; without labels every score is 0.5; repeated rows count as often
as they occur; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm import frames

BINS = 16
_SYMBOLS = b"#*$%&|<>!=~^_{}[]\\"
_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def structure(text: bytes, words: list[bytes], different: int) -> list[int]:
    """Bins of the statistics."""

    def share(part: float, whole: float) -> int:
        return min(BINS - 1, int(BINS * math.sqrt(part / whole))) if whole else 0

    def log(x: float) -> int:
        return min(BINS - 1, int(2 * math.log2(1 + x)))

    size, n = len(text), len(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return [
        share(size - len(text.translate(None, _SYMBOLS)), size),
        share(size - len(text.translate(None, _CAPITALS)), size),
        share(size - len(text.translate(None, _DIGITS)), size),
        share(text.count(b"|"), n),
        share(text.count(b"!"), n),
        share(different, n),
        share(len(lines) - len(set(lines)), len(lines)),
        log(size / n if n else 0),
        log(n / len(lines) if lines else 0),
        log(math.log2(1 + n)),
        share(text.count(b".") + text.count(b","), n),
        log(max(map(len, words), default=0) / 4),
    ]


N_STATISTICS = 12


@dataclass(frozen=True)
class Shape:
    """Where features lie: words first, then statistics, then metadata."""

    bits: int = 15
    metadata: int = 1

    @property
    def size(self) -> int:
        return (1 << self.bits) + BINS * (N_STATISTICS + self.metadata)

    def features(self, text: bytes | None, metadata: tuple) -> tuple[np.ndarray, np.ndarray]:
        text = text or b""
        words = text.lower().split()
        different = set(words)
        mask = (1 << self.bits) - 1
        hashed = [zlib.crc32(w) & mask for w in different]
        base = 1 << self.bits
        bins = structure(text, words, len(different))
        for value in metadata:
            bins.append(BINS - 1 if value is None else min(BINS - 2, int(math.log2(1 + max(0, value)))))
        index = np.array(hashed + [base + BINS * i + b for i, b in enumerate(bins)], dtype=np.int32)
        value = np.ones(len(index), dtype=np.float32)
        if hashed:
            value[:len(hashed)] = 1 / math.sqrt(len(hashed))
        value[len(hashed):] = 1 / math.sqrt(len(bins))
        return index, value


@dataclass(frozen=True)
class Model:
    shape: Shape
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def forward(model: Model, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores before the sigmoid, sums by factor, and the terms of each feature."""
    terms = model.factors[index] * value[:, None]
    sums = np.add.reduceat(terms, starts)
    squares = np.add.reduceat(terms * terms, starts)
    linear = np.add.reduceat(model.linear[index] * value, starts)
    return model.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums, terms


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def together(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(i) for i, _ in rows]
    return (np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum([0] + sizes[:-1]))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, shape: Shape, rank: int = 8, epochs: int = 8,
          batch: int = 128, rate: float = 0.02, decay: float = 1e-5, seed: int = 7, least_steps: int = 600) -> Model:
    """Adam on the logistic loss; few rows are gone through more often, for ``least_steps``."""
    rng = np.random.default_rng(seed)
    n = shape.size
    if not len(rows):
        return Model(shape, 0.0, np.zeros(n, dtype=np.float32), np.zeros((n, rank), dtype=np.float32))
    params = [np.zeros(1), np.zeros(n, dtype=np.float32), rng.normal(0, 0.05, (n, rank)).astype(np.float32)]
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    params[0][0] = math.log(share / (1 - share))
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    epochs = max(epochs, -(-least_steps * batch // len(rows)))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at:at + batch]
            index, value, starts = together([rows[i] for i in own])
            model = Model(shape, float(params[0][0]), params[1], params[2])
            score, sums, terms = forward(model, index, value, starts)
            error = (sigmoid(score) - labels[own]) / len(own)
            owner = np.repeat(np.arange(len(own)), np.diff([*starts, len(index)]))
            weight = (error[owner] * value).astype(np.float32)
            slope = weight[:, None] * (sums[owner] - terms)
            grads = [
                np.array([error.sum()]),
                np.bincount(index, weight, n) + decay * params[1],
                np.stack([np.bincount(index, slope[:, f], n) for f in range(rank)], axis=1) + decay * params[2],
            ]
            step += 1
            for p, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return Model(shape, float(params[0][0]), params[1].astype(np.float32), params[2].astype(np.float32))


def fit(labelled: DataFrame, metadata: tuple[str, ...] = ("n_chars",), text: str = "text", key: str = "doc_id",
        label: str = "quality", fit_rows: int = 8_000, bits: int = 15, rank: int = 8) -> Model:
    """Learn from about ``fit_rows`` of the labelled rows at most, chosen by a hash of ``key``."""
    shape = Shape(bits, len(metadata))
    rows = frames.sampled(labelled.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, text, label, *metadata), key, fit_rows)

    def work():
        def step(texts, targets, *columns):
            found = [shape.features(t, m) for t, m in zip(frames.utf8(texts), zip(*(c.to_pylist() for c in columns)) if columns else [()] * len(texts))]
            return {"index": [i.tolist() for i, _ in found], "value": [v.tolist() for _, v in found], "label": targets}
        return step

    vectors = frames.per_document(rows, [text, label, *metadata], "index array<int>, value array<float>, label double", work)
    got = vectors.withColumn("print", F.xxhash64("index")).toArrow()
    found = [(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(got.column("index"), got.column("value"))]
    labels = got.column("label").to_numpy()
    # the same order whatever the tasks
    order = np.lexsort((labels, got.column("print").to_numpy()))
    return train([found[i] for i in order], labels[order], shape, rank)


def scores(docs: DataFrame, model: Model, metadata: tuple[str, ...] = ("n_chars",), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``score`` (0 to 1, higher: good likelier) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        model = shared.value

        def step(ids, texts, *columns):
            extra = list(zip(*(c.to_pylist() for c in columns))) if columns else [()] * len(ids)
            out: list[float] = []
            bodies = frames.utf8(texts)
            for at in range(0, len(bodies), 256):
                rows = [model.shape.features(t, m) for t, m in zip(bodies[at:at + 256], extra[at:at + 256])]
                out += sigmoid(forward(model, *together(rows))[0]).tolist()
            return {key: ids, "score": out}
        return step

    kind = docs.schema[key].dataType.simpleString()
    return frames.per_document(docs, [key, text, *metadata], f"{key} {kind}, score double", work)
