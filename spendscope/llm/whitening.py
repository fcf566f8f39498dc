"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries c become whole numbers x = floor(``SCALE`` * c) + ``SHIFT``. The distinct x vectors, the
fit list, are stored in blocks of rows; their number and sums are exact. X is the matrix of
centred fit rows. One step of the bidiagonalisation multiplies X by a vector and the
transposed X by the result, both block by block in one pass over the stored rows; tasks
return sums of as many numbers as the vectors have entries, added up in two levels.

The left vectors u are as long as the fit list and never leave the tasks: each is X p for a
short vector p, and since u_i . X q = (transposed X u_i) . q, full reorthogonalisation of the
left vectors needs the short vectors p and transposed X u alone, as that of the right
vectors v does. After k steps X V = U B with a bidiagonal B; its singular values are the
deviations (times the square root of the number of rows) and V times its right vectors the
components. Steps end when the wanted components have residuals of ``EXACT`` times the
greatest singular value after half as many steps as there are dimensions or fewer; the rest
of the space is then searched for equal values that a single sequence can't see. Otherwise
there are as many steps as dimensions. Where the space is exhausted before, a random
direction goes on.

Defined cases: vectors that are NULL or hold NULL, NaN or infinite entries, empty ones, those of
another than the commonest length, and entries of 1e15 or more (x would not be exact) take
no part; zero vectors do. NULL and repeated keys give rows like others; repeated vectors
count once in the fit. There are as many components as the centred rows have dimensions,
at most; fewer than two distinct vectors have none and give no rows. Equal eigenvalues have
any orthonormal components of their space. A deviation beyond 64 bits is NULL. Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm import frames, vectors

SCALE = 64
SHIFT = 1_000_000
LARGEST = 1e15
BLOCK = 4096
EXACT = 1e-14
#: singular values below this part of the greatest count as zero
ZERO = 1e-8


class Whitening(NamedTuple):
    """The fit: number of fit rows and their sums (exact), components as rows, eigenvalues,
    the trace of the covariance and the greatest error of the whitened covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def numbers(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key`` and ``x`` of the rows that take part."""
    return vectors.usable(rows, vector, key, LARGEST).select(
        "key", F.expr(f"transform(vec, c -> floor({SCALE} * c) + {SHIFT}L)").alias("x"))


def fit_blocks(rows: DataFrame) -> DataFrame:
    """The distinct ``x`` in rows of up to ``BLOCK`` vectors (``block``, 64-bit little-endian),
    stored. Equal vectors are merged before they are exchanged."""
    made = frames.arrow("block binary")

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[dict[str, list]]:
            for batch in incoming:
                x = vectors.matrix(batch.column(0), np.dtype("<i8"))
                for at in range(0, len(x), BLOCK):
                    yield {"block": [x[at:at + BLOCK].tobytes()]}
        yield from frames.batches(blocks(), made)

    return frames.stored(rows.select("x").distinct().mapInArrow(run, "block binary"))


def summed(blocks: DataFrame, dim: int, work: Callable[[np.ndarray], np.ndarray], dtype=np.float64) -> np.ndarray:
    """The sum of ``work(block)`` over all blocks (matrices of long): each task returns one sum,
    a square root of their number of tasks adds these, the driver adds the rest."""
    made = frames.arrow("part binary")

    def total(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = None
        for part in parts:
            out = part if out is None else out + part
        if out is not None:
            yield from frames.batches([{"part": [out.tobytes()]}], made)

    def first(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total(work(np.frombuffer(block.as_buffer(), dtype="<i8").reshape(-1, dim))
                     for batch in incoming for block in batch.column(0))

    def second(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total(np.frombuffer(part.as_buffer(), dtype=dtype) for batch in incoming for part in batch.column(0))

    parts = blocks.mapInArrow(first, "part binary")
    fewer = max(1, math.isqrt(blocks.rdd.getNumPartitions()))
    rows = parts.repartition(fewer).mapInArrow(second, "part binary").collect()
    return np.sum([np.frombuffer(r["part"], dtype=dtype) for r in rows], axis=0, dtype=dtype)


class Centre(NamedTuple):
    """Subtracts the mean: its whole part exactly, the rest as double."""

    whole: np.ndarray
    rest: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest


def centre(n: int, sums: list[int]) -> Centre:
    return Centre(np.array([s // n for s in sums], dtype=np.int64), np.array([s % n / n for s in sums]))


def _orthogonal(vector: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Without its parts along the rows of ``against``, taken off twice."""
    for _ in range(2):
        vector = vector - against.T @ (against @ vector)
    return vector


def bidiagonalised(product: Callable[[np.ndarray], tuple[np.ndarray, float]], dim: int, wanted: int, apart: np.ndarray,
                   seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` greatest singular values of X and their right vectors as rows, among the
    vectors orthogonal to the rows of ``apart`` (right vectors found before); the steps taken.

    ``product`` gives transposed X times X q, and the square of the length of X q. V has the
    right vectors, P and G the short vectors of the left ones: u = X p, g = transposed X u.
    """
    rng, room = np.random.default_rng(seed), dim - len(apart)
    wanted = min(wanted, room)
    V, P, G = np.empty((0, dim)), np.empty((0, dim)), np.empty((0, dim))
    diagonal, above = [], []
    v, beta, largest = None, 0.0, 0.0
    while len(V) < room:
        if v is None:
            v = _orthogonal(rng.standard_normal(dim), np.vstack([apart, V]))
            v, beta = v / np.linalg.norm(v), 0.0
        if len(V):
            above.append(beta)
        V = np.vstack([V, v])
        q = v - beta * P[-1] if len(P) else v
        z, square = product(q)
        along = P @ z
        alpha = math.sqrt(max(0.0, square - float(along @ along)))
        q, z = q - P.T @ along, z - G.T @ along
        largest = max(largest, alpha, beta)
        if alpha <= 1e-12 * largest * max(1.0, float(np.linalg.norm(q))):
            alpha, p, g = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            p, g = q / alpha, z / alpha
        diagonal.append(alpha)
        P, G = np.vstack([P, p]), np.vstack([G, g])
        w = _orthogonal(g - alpha * v, np.vstack([apart, V]))
        beta = float(np.linalg.norm(w))
        v = w / beta if beta > 1e-13 * largest else None
        if v is not None and wanted <= len(V) <= room // 2:
            left = np.linalg.svd(np.diag(diagonal) + np.diag(above, 1))[0]
            if (beta * np.abs(left[-1, :wanted]) <= EXACT * largest).all():
                break
    _, values, right = np.linalg.svd(np.diag(diagonal) + np.diag(above, 1))
    return values[:wanted], right[:wanted] @ V, len(V)


def principal(product: Callable[[np.ndarray], tuple[np.ndarray, float]], dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest singular values of X, falling, and their right vectors as rows."""
    values, right, steps = bidiagonalised(product, dim, wanted, np.empty((0, dim)))
    seed = 0
    while steps < dim and len(right) < dim:
        # a sequence from one vector sees equal values once: look into the rest of the space
        seed += 1
        more, other, _ = bidiagonalised(product, dim, 1, right, seed)
        if more[0] <= values[min(wanted, len(values)) - 1] * (1 + 1e-9):
            break
        values, right = np.append(values, more), np.vstack([right, other])
        order = np.argsort(-values, kind="stable")
        values, right = values[order], right[order]
    return values[:wanted], right[:wanted]


def fit(rows: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of the ``x`` of the rows; None without two distinct vectors."""
    blocks = fit_blocks(rows)
    some = rows.select(F.size("x").alias("dim")).first()
    if some is None:
        return None
    dim = some["dim"]
    counted = summed(blocks, dim, lambda x: np.append(x.sum(axis=0, dtype=np.int64), len(x)), np.int64).tolist()
    sums, n = counted[:-1], counted[-1]
    if n < 2:
        return None
    mean = centre(n, sums)

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        def work(x: np.ndarray) -> np.ndarray:
            y = mean(x)
            left = y @ q
            return np.append(left @ y, left @ left)

        found = summed(blocks, dim, work)
        return found[:-1], float(found[-1])

    values, right = principal(product, dim, components)
    alive = values > ZERO * values[0]
    values, right = values[alive], right[alive]
    right = right / np.linalg.norm(right, axis=1, keepdims=True)
    eigenvalues = values ** 2 / n
    wide = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        y = mean(x)
        t = (y @ right.T) / np.sqrt(eigenvalues)
        return np.concatenate([(t.T @ t).ravel(), [(y * y).sum()]])

    found = summed(blocks, dim, moments)
    error = float(np.abs(found[:-1].reshape(wide, wide) / n - np.eye(wide)).max())
    return Whitening(n, sums, right, eigenvalues, float(found[-1]) / n, error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n * x - sum) ** 2, exact; None beyond 64 bits."""
    apart = x - np.array([s // n for s in sums], dtype=np.int64)
    rests = [s % n for s in sums]
    if n * (float(np.abs(apart).max(initial=0)) + 1) < math.sqrt(2.0 ** 62 / max(1, x.shape[1])):
        return ((n * apart - np.array(rests, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(a) - r) ** 2 for a, r in zip(row, rests)) for row in apart.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def whitened(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 16) -> DataFrame:
    """Per row that takes part and component: ``key``, ``component`` (from 1 by falling
    eigenvalue), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    taking = numbers(rows, vector, key)
    model = fit(taking, components)
    kind = taking.schema["key"].dataType.simpleString()
    schema = (f"key {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    made = frames.arrow(schema)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def steps() -> Iterator[dict[str, object]]:
            if model is None:
                return
            wide, mean = len(model.eigenvalues), centre(model.n, model.sums)
            explained = model.eigenvalues / model.trace
            for batch in incoming:
                x = vectors.matrix(batch.column("x"), np.int64)
                t = (mean(x) @ model.components.T) / np.sqrt(model.eigenvalues)
                each = pa.array(np.repeat(np.arange(len(x)), wide))
                yield {
                    "key": batch.column("key").take(each), "component": np.tile(np.arange(1, wide + 1, dtype=np.int32), len(x)),
                    "n": np.full(len(each), model.n), "deviation": pa.array(_deviations(x, model.n, model.sums), pa.int64()).take(each),
                    "whitened": t.ravel(), "explained": np.tile(explained, len(x)),
                    "identity_error": np.full(len(each), model.identity_error)}
        yield from frames.batches(steps(), made)

    return taking.mapInArrow(run, schema).withColumnRenamed("key", key)
