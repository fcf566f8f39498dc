"""Periodic runs of words, found by block convolution, and their collapse.

A run is a stretch of words with smallest period q that is at least ``LEAST`` words and
``TIMES`` periods long and that no neighbouring word extends. Words are numbers here, and
texts are searched many at a time, divided by numbers that occur once, which no run spans.

Scale B (1, 2, 4, ...) looks for the periods p of [B, 2B). The first of the aligned blocks of
B words inside a run that begins with s has ``s + B + 2p`` words of the run behind its start,
so the block occurs again at distance p. Distances of all its occurrences come from one
number-theoretic transform of length 2B: the sum of squared differences between the block
and the words at each distance is the sum of both squares less twice their correlation,
and is zero at occurrences only. It is taken modulo primes whose product exceeds the
greatest possible sum, the second only for blocks with a zero modulo the first, so the
zeros are exact. A run repeats the block and the one behind it, so blocks are not transformed
where a word of either has no equal at less than 2B words behind it.

Distances seed extensions. Three or more occurrences of a block overlap and are an
arithmetic progression whose difference r is a period of the block; a run can only have the
one distance that takes the end of the stretch of period r around the block to the end of
the next such stretch. So a block has two seeds at most, and work is n log n for any text.

Defined cases: a NULL or empty text has no words and no runs; nothing is planted with a NULL
id; texts of any length are searched whole, one record at a time; repeated rows each give a
row; an empty table gives none; other columns are ignored; ties of the best run go to the
smallest start, then period.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm import frames

TIMES = 4
LEAST = 6
#: primes of the form c * 2**k + 1 below 2**31, each with a primitive root
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
#: words searched together, and numbers transformed together
TOGETHER = 1 << 19
FAR = np.iinfo(np.int64).max


class Run(NamedTuple):
    start: int
    length: int
    period: int


@lru_cache(maxsize=128)
def _powers(root: int, n: int, prime: int) -> np.ndarray:
    """The first ``n`` powers of ``root``."""
    out = np.ones(n, dtype=np.uint64)
    size = 1
    while size < n:
        more = min(size, n - size)
        out[size:size + more] = out[:more] * np.uint64(pow(root, size, prime)) % np.uint64(prime)
        size += more
    return out


def transformed(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The transform of each row modulo ``prime``, in bit-reversed order."""
    a, p = rows.astype(np.uint64), np.uint64(prime)
    count, size = a.shape
    half = size // 2
    while half:
        pair = a.reshape(count, -1, 2, half)
        high, low = pair[:, :, 0], pair[:, :, 1]
        factors = _powers(pow(generator, (prime - 1) // (2 * half), prime), half, prime)
        a = np.stack([(high + low) % p, (high + (p - low)) % p * factors % p], axis=2).reshape(count, size)
        half //= 2
    return a


def restored(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The inverse of ``transformed``."""
    a, p = rows, np.uint64(prime)
    count, size = a.shape
    half = 1
    while half < size:
        pair = a.reshape(count, -1, 2, half)
        factors = _powers(pow(generator, prime - 1 - (prime - 1) // (2 * half), prime), half, prime)
        high, low = pair[:, :, 0], pair[:, :, 1] * factors % p
        a = np.stack([(high + low) % p, (high + (p - low)) % p], axis=2).reshape(count, size)
        half *= 2
    return a * np.uint64(pow(size, prime - 2, prime)) % p


def differences(blocks: np.ndarray, windows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """For blocks of B numbers and windows of 2B: the sums of squared differences between the
    block and the window's words from 0, 1, ..., B - 1 on, modulo ``prime``."""
    p, size = np.uint64(prime), blocks.shape[1]
    blocks, windows = blocks.astype(np.uint64) % p, windows.astype(np.uint64) % p
    backward = np.zeros_like(windows)
    backward[:, 0] = blocks[:, 0]
    backward[:, size + 1:] = blocks[:, :0:-1]
    product = transformed(backward, prime, generator) * transformed(windows, prime, generator) % p
    correlation = restored(product, prime, generator)[:, :size]
    squares = np.cumsum(windows * windows % p, axis=1, dtype=np.uint64)
    squares[:, size:] -= squares[:, :size].copy()
    behind = np.concatenate([squares[:, size - 1:size], squares[:, size:2 * size - 1]], axis=1) % p
    own = (blocks * blocks % p).sum(axis=1, dtype=np.uint64)[:, None] % p
    return (own + behind + np.uint64(2) * (p - correlation)) % p


def occurrences(codes: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of ``size`` words with the distances of [size, 2 * size) at which they occur again.
    ``3 * size`` words follow each start (one less is enough). Of one or two distances, those
    that the block before has too are left out, for it begins their runs."""
    bound = size * int(codes.max()) ** 2
    for at in range(0, len(starts), max(1, TOGETHER // (2 * size))):
        part = starts[at:at + max(1, TOGETHER // (2 * size))]
        alive, zero, product = np.arange(len(part)), None, 1
        for prime, generator in PRIMES:
            base = part[alive, None]
            zeros = differences(codes[base + np.arange(size)],
                                codes[np.minimum(base + np.arange(size, 3 * size), len(codes) - 1)], prime, generator) == 0
            zero = zeros if zero is None else zero & zeros
            some = zero.any(axis=1)
            alive, zero, product = alive[some], zero[some], product * prime
            if product > bound or not len(alive):
                break
        after = np.flatnonzero(part[alive[1:]] == part[alive[:-1]] + size) + 1
        after = after[zero[after].sum(axis=1) <= 2]
        zero[after] &= ~zero[after - 1].copy()
        rows, columns = np.nonzero(zero)
        ends = np.flatnonzero(np.diff(rows, append=-1)) + 1
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            yield int(part[alive[rows[a]]]), size + columns[a:b]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two arrays."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        same = a[at:min(n, at + step)] == b[at:min(n, at + step)]
        if not same.all():
            return at + int(same.argmin())
        at += step
        step *= 2
    return n


def _seeds(codes: np.ndarray, s: int, size: int, distances: np.ndarray) -> list[int]:
    """The distances a run with this block may have."""
    if len(distances) <= 2:
        return distances.tolist()
    r = int(distances[1] - distances[0])
    first = s + r + _agree(codes[s:s + 3 * size], codes[s + r:s + r + 3 * size])
    there = s + int(distances[0])
    second = there + r + _agree(codes[there:there + 4 * size], codes[there + r:there + r + 4 * size])
    return [second - first] if second - first in distances else []


def periodic_runs(codes: np.ndarray) -> list[Run]:
    """All runs of an array of numbers from 0 on, by start, then period."""
    n = len(codes)
    found: dict[tuple[int, int], int] = {}
    if n < LEAST:
        return []
    order = np.argsort(codes, kind="stable")
    again = np.full(n, FAR, dtype=np.int64)
    same = codes[order[1:]] == codes[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    size, farthest = 1, again
    while TIMES * size <= n:
        near = farthest < 2 * size
        starts = np.flatnonzero(near[:-1] & near[1:]) * size
        starts = starts[starts + 3 * size <= n]
        seen: dict[int, int] = {}
        for s, distances in occurrences(codes, starts, size):
            for p in _seeds(codes, s, size, distances):
                if s + size + p <= seen.get(p, 0):
                    continue
                right = s + _agree(codes[s:n - p], codes[s + p:])
                if right < s + size + p:
                    continue
                start = s - _agree(codes[:s][::-1], codes[p:s + p][::-1])
                end = seen[p] = right + p
                if end - start >= max(LEAST, TIMES * p):
                    found.setdefault((start, end), p)
        farthest = farthest[:len(farthest) // 2 * 2].reshape(-1, 2).max(axis=1)
        size *= 2
    return sorted((Run(start, end - start, p) for (start, end), p in found.items()), key=lambda run: (run.start, run.period))


def planted(n: int, key: object) -> np.ndarray | None:
    """The places from which ``n`` words are taken where the key's hash plants a repetition."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def collapsed(n: int, found: list[Run]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    stay = np.ones(n, dtype=bool)
    for run in found:
        stay[run.start + run.period:run.start + run.length] = False
    return stay


def _searched(texts: list[list[bytes]], places: list[np.ndarray | None]) -> list[list[Run]]:
    """The runs of each text, found together."""
    known: dict[bytes, int] = {}
    parts, at = [], 0
    for words, place in zip(texts, places):
        own = np.fromiter(map(known.setdefault, words, range(at, at + len(words))), dtype=np.int64, count=len(words))
        parts += [own if place is None else own[place], np.array([at + len(words)])]
        at += len(words) + 1
    ends = np.cumsum([len(words) + 1 for words in texts])
    out: list[list[Run]] = [[] for _ in texts]
    for run in periodic_runs(np.concatenate(parts)):
        i = int(np.searchsorted(ends, run.start, side="right"))
        out[i].append(run._replace(start=run.start - int(ends[i - 1] if i else 0)))
    return out


def runs(docs: DataFrame, text: str = "text", key: str = "doc_id", plant: bool = False) -> DataFrame:
    """Per row: ``key``, ``n_words``, ``runs`` (start, length and period of each, by start, then
    period) and ``collapsed`` (the words that stay, joined by a space). With ``plant``, the
    words are first replaced where the hash of the key says so (see ``planted``)."""
    frame = docs.select(F.col(frames.quoted(key)).alias("key"), F.col(frames.quoted(text)).cast("binary").alias("text"))
    kind = frame.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    made = frames.arrow(schema)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def step(keys: list, texts: list[list[bytes]]) -> dict[str, list]:
            places = [planted(len(words), k) if plant else None for k, words in zip(keys, texts)]
            found = _searched(texts, places)
            joined = []
            for words, place, own in zip(texts, places, found):
                if place is not None or own:
                    place = np.arange(len(words)) if place is None else place
                    words = [words[i] for i in place[collapsed(len(words), own)].tolist()]
                joined.append(b" ".join(words))
            return {"key": keys, "n_words": [len(words) for words in texts],
                    "runs": [[r._asdict() for r in own] for own in found], "collapsed": joined}

        def steps() -> Iterator[dict[str, list]]:
            keys, texts, size = [], [], 0
            for batch in incoming:
                for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    words = value.as_py().split() if value.is_valid else []
                    if keys and size + len(words) > TOGETHER:
                        yield step(keys, texts)
                        keys, texts, size = [], [], 0
                    keys.append(k)
                    texts.append(words)
                    size += len(words)
            if keys:
                yield step(keys, texts)

        yield from frames.batches(steps(), made)

    found = frame.mapInArrow(run, schema)
    return found.select(F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of ``runs``: its number of runs, the one of the greatest exponent, and digests of
    all runs and of the collapsed text. Exponents are compared exactly, as products of a
    length and a period, each below the size of a text."""
    better = F.expr(
        "aggregate(runs, CAST(NULL AS STRUCT<start:BIGINT,length:BIGINT,period:BIGINT>), (best, r) -> CASE"
        " WHEN best IS NULL THEN r"
        " WHEN r.length * best.period > best.length * r.period THEN r ELSE best END)")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    kept = found.withColumn("best", better)
    return kept.select(
        frames.quoted(key), F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
