"""Approximate nearest neighbours by an adaptive scan of dimensions inside of probed lists.

Index: k-means on a bounded sample gives ``lists`` centroids; every distinct vector goes to
the list of its nearest centroid and carries the smallest keys of its copies, one more than
neighbours are asked for, which is all that copies can add to any answer. Copies are cut to
these before they are exchanged. How many lists a query probes is fitted on the sample:
the fewest that hold a share ``recall`` of the true neighbours of some of its vectors.

Search: lists are dealt to cells of ``CELL`` vectors and ``QUERIES`` distinct queries at most,
so that no list, however large, is one task's. In a cell vectors and queries are turned by
a random rotation and compared a block of columns at a time. After t of d columns with
squared distance s, a candidate is abandoned if sqrt(s * d / t) > (1 + ``DOUBT`` / sqrt(t)) * r:
were it nearer than r, its distance in t random directions would hardly look that large. The
bound r is the distance of the query's last wanted neighbour among ``POOL`` broadcast vectors
of the sample; these neighbours are the first found, so that no query ends with fewer than
it wants. What survives all blocks is measured on the original vectors, in double precision.

Each cell gives a query's best keys only; the best of all are joined to the queries.
Queries with one vector are one query until then.

Defined cases: vectors that are NULL, empty, zero, of another than the commonest length, or
hold NULL, NaN or infinite entries (or such as 1e150, whose squares overflow) take no part,
nor do NULL keys. Repeated rows are one; a key with two vectors has both as candidates, each
found by itself (once where they are equally far), asks for both, and is never its own neighbour. Ties go to smaller keys. A query with fewer
candidates has them all; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendscope.llm import frames, vectors

FIT_ROWS = 16_384
RECALL = 0.98
DOUBT = 2.1
STEP = 16
CELL = 8192
QUERIES = 2048
LARGEST = 1e150
#: sample vectors that bound a query's distances
POOL = 512


class Index(NamedTuple):
    """Rotation, centroids as rows, lists that a query probes, some indexed vectors with their
    keys; and the table: ``list``, ``vec``, ``keys`` (of the vector, smallest first)."""

    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    pool: np.ndarray
    pool_keys: list[list]
    rows: DataFrame
    most: int


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two matrices."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def kmeans(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Centroids of Lloyd's rounds from distinct rows of the sample; empty ones stay where they are."""
    centroids = sample[np.random.default_rng(seed).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        own = np.concatenate([_squares(sample[at:at + 2048], centroids).argmin(axis=1) for at in range(0, len(sample), 2048)])
        sizes = np.bincount(own, minlength=len(centroids))
        sums = np.stack([np.bincount(own, weights=column, minlength=len(centroids)) for column in sample.T], axis=1)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, most: int, recall: float, tested: int = 512) -> int:
    """The fewest lists to probe that hold the share ``recall`` of the ``most`` nearest of some sample rows."""
    asked = np.arange(min(tested, len(sample)))
    away = _squares(sample[asked], sample)
    away[asked, asked] = np.inf
    near = np.argsort(away, axis=1)[:, :min(most, len(sample) - 1)]
    own = np.concatenate([_squares(sample[at:at + 2048], centroids).argmin(axis=1) for at in range(0, len(sample), 2048)])
    rank = np.argsort(np.argsort(_squares(sample[asked], centroids), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1 if len(needed) else 1


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def _vec_hash() -> tuple[Column, Column]:
    """128 bits that stand for a vector."""
    return F.xxhash64(F.lit(1), "vec").alias("h1"), F.xxhash64(F.lit(2), "vec").alias("h2")


def _taking(rows: DataFrame, vector: str, key: str) -> DataFrame:
    return vectors.usable(rows, vector, key, LARGEST).where("key IS NOT NULL AND exists(vec, c -> c != 0)")


def indexed(rows: DataFrame, most: int = 10, vector: str = "embedding", key: str = "vec_id", lists: int | None = None,
            fit_rows: int = FIT_ROWS, recall: float = RECALL) -> Index | None:
    """The index of all rows for answers of up to ``most`` neighbours; None without rows.
    ``lists`` is the square root of the number of distinct vectors unless it is given, and at
    most a sixteenth of the sample."""
    first = Window.partitionBy("h1", "h2", "vec").orderBy("key")
    copies = _taking(rows, vector, key).select("key", "vec", *_vec_hash())
    distinct = (
        copies.withColumn("place", F.dense_rank().over(first)).where(F.col("place") <= most + 1)
        .groupBy("h1", "h2", "vec").agg(F.array_sort(F.collect_set("key")).alias("keys")))
    distinct = frames.stored(distinct)
    total = distinct.count()
    if not total:
        return None
    parts = 1 << 30
    chosen = distinct if total <= fit_rows else distinct.where(F.pmod("h1", F.lit(parts)) < int(parts * fit_rows / total))
    rows_of_sample = chosen.orderBy("h1", "h2").select("vec", "keys").collect() or [distinct.first()]
    sample = np.array([r["vec"] for r in rows_of_sample])
    count = max(1, min(lists or math.isqrt(total), max(1, len(sample) // 16)))
    centroids = kmeans(sample, count)
    probes = probes_for(sample, centroids, most, recall)
    kind = distinct.schema["keys"].dataType.simpleString()
    schema = f"list int, vec array<double>, keys {kind}"
    made = frames.arrow(schema)
    shared = distinct.sparkSession.sparkContext.broadcast(centroids)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from frames.batches((
            {"list": _squares(vectors.matrix(batch.column("vec")), shared.value).argmin(axis=1),
             "vec": batch.column("vec"), "keys": batch.column("keys")} for batch in incoming if batch.num_rows), made)

    placed = frames.stored(distinct.select("vec", "keys").mapInArrow(run, schema))
    return Index(rotation(sample.shape[1]), centroids, min(probes, count), sample[:POOL],
                 [r["keys"] for r in rows_of_sample[:POOL]], placed, most)


def survivors(queries: np.ndarray, candidates: np.ndarray, bounds: np.ndarray, step: int = STEP,
              doubt: float = DOUBT) -> tuple[np.ndarray, np.ndarray]:
    """Places of query and candidate of all pairs that no test abandons; both are rotated.
    ``bounds`` are the queries' distances r."""
    dim = queries.shape[1]
    t = min(step, dim)

    def limit(t: int) -> np.ndarray:
        slack = 1 + doubt / math.sqrt(t) if t < dim else 1
        return (bounds * slack) ** 2 * (t / dim) * (1 + 1e-9) + 1e-12 * sizes

    sizes = (queries * queries).sum(axis=1) + (candidates * candidates).sum(axis=1).max(initial=0)
    partial = _squares(queries[:, :t], candidates[:, :t])
    i, j = np.nonzero(partial <= limit(t)[:, None])
    partial = partial[i, j]
    while t < dim:
        more = min(dim, t + step)
        partial = partial + ((queries[i, t:more] - candidates[j, t:more]) ** 2).sum(axis=1)
        t = more
        alive = partial <= limit(t)[i]
        i, j, partial = i[alive], j[alive], partial[alive]
    return i, j


def best(queries: np.ndarray, candidates: np.ndarray, keys: list[list], bounds: np.ndarray, turn: np.ndarray, most: int,
         together: int = 128) -> Iterator[tuple[int, list[tuple[float, object]]]]:
    """For each query with survivors its place and up to ``most`` pairs of distance and key."""
    turned = candidates @ turn
    for at in range(0, len(queries), together):
        part = slice(at, at + together)
        i, j = survivors(queries[part] @ turn, turned, bounds[part])
        score = np.sqrt(((queries[part][i] - candidates[j]) ** 2).sum(axis=1))
        order = np.lexsort((score, i))
        i, j, score = i[order], j[order], score[order]
        ends = np.flatnonzero(np.diff(i, append=-1)) + 1
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            # ties with the last place stay until their keys are seen
            last = score[min(b, a + most) - 1]
            b = a + int(np.searchsorted(score[a:b], last, side="right"))
            yield at + int(i[a]), _pairs(score[a:b], j[a:b], keys, most)


def _pairs(score: np.ndarray, places: np.ndarray, keys: list[list], most: int) -> list[tuple[float, object]]:
    """The best pairs of distance and key."""
    return sorted((s, k) for s, c in zip(score.tolist(), places.tolist()) for k in keys[c])[:most]


def _probing(asked: DataFrame, index: Index) -> DataFrame:
    """For each distinct query vector one row for each list it probes, with its bound; the first
    has the best of the pool as ``near``."""
    shared = asked.sparkSession.sparkContext.broadcast((index.centroids, index.pool, index.pool_keys))
    probes, most = index.probes, index.most + 1
    kind = index.rows.schema["keys"].dataType.elementType.simpleString()
    schema = f"h1 long, h2 long, vec array<double>, bound double, list int, near array<struct<score:double,key:{kind}>>"
    made = frames.arrow(schema)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, pool, keys = shared.value

        def steps() -> Iterator[dict[str, object]]:
            for whole in incoming:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    q = vectors.matrix(batch.column("vec"))
                    wanted = min(most, len(pool))
                    near = np.argpartition(_squares(q, pool), wanted - 1, axis=1)[:, :wanted]
                    score = np.stack([np.sqrt(((pool[places] - own) ** 2).sum(axis=1)) for own, places in zip(q, near)])
                    bounds = score.max(axis=1) if wanted == most else np.full(len(q), np.inf)
                    lists = np.argsort(_squares(q, centroids), axis=1, kind="stable")[:, :probes]
                    each = np.repeat(np.arange(len(q)), lists.shape[1])
                    first: list = [None] * len(each)
                    first[::lists.shape[1]] = [[{"score": s, "key": k} for s, k in _pairs(a, b, keys, most)]
                                               for a, b in zip(score, near)]
                    taken = pa.array(each)
                    yield {"h1": batch.column("h1").take(taken), "h2": batch.column("h2").take(taken),
                           "vec": batch.column("vec").take(taken), "bound": bounds[each], "list": lists.ravel(), "near": first}
        yield from frames.batches(steps(), made)

    return asked.mapInArrow(run, schema)


def search(index: Index, rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``query_id``, ``rank`` (from 1), the neighbour's ``key`` and ``score`` (its distance) for
    the rows asked for, which may or may not be indexed."""
    most, dim = index.most, index.centroids.shape[1]
    asked = _taking(rows, vector, key).where(F.size("vec") == dim).select("key", "vec", *_vec_hash())
    known = frames.checkpointed(asked.select("key", "h1", "h2").distinct())
    probing = frames.stored(_probing(asked.groupBy("h1", "h2").agg(F.min("vec").alias("vec")), index))
    # both have a row for each list at most
    sizes = index.rows.groupBy("list").agg(F.expr(f"CAST(ceil(count(*) / {CELL}) AS INT)").alias("blocks"))
    loads = probing.groupBy("list").agg(F.expr(f"CAST(ceil(count(*) / {QUERIES}) AS INT)").alias("loads"))
    cells = F.broadcast(frames.checkpointed(sizes.join(loads, "list")))
    block, load = F.pmod(F.xxhash64("vec"), "blocks").cast("int"), F.pmod("h1", "loads").cast("int")
    left = index.rows.join(cells, "list").select(
        "list", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("loads") - 1)).alias("load"), "vec", "keys")
    right = probing.join(cells, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), load.alias("load"), "h1", "h2", "vec", "bound")
    kind = index.rows.schema["keys"].dataType.elementType.simpleString()
    schema = f"h1 long, h2 long, score double, key {kind}"
    made = frames.arrow(schema)
    turn = rows.sparkSession.sparkContext.broadcast(index.rotation)

    def compare(vecs: pa.Table, queries: pa.Table) -> pa.Table:
        vecs, queries = vecs.combine_chunks(), queries.combine_chunks()
        out: dict[str, list] = {"h1": [], "h2": [], "score": [], "key": []}
        if len(vecs) and len(queries):
            c, q = (vectors.matrix(t.column("vec").combine_chunks()) for t in (vecs, queries))
            h1, h2 = queries.column("h1").to_pylist(), queries.column("h2").to_pylist()
            for i, pairs in best(q, c, vecs.column("keys").to_pylist(), queries.column("bound").to_numpy(), turn.value, most + 1):
                out["h1"] += [h1[i]] * len(pairs)
                out["h2"] += [h2[i]] * len(pairs)
                out["score"] += [s for s, _ in pairs]
                out["key"] += [k for _, k in pairs]
        return pa.table(out, schema=made)

    found = left.groupBy("list", "block", "load").cogroup(right.groupBy("list", "block", "load")).applyInArrow(compare, schema)
    found = found.unionByName(probing.where("near IS NOT NULL").select("h1", "h2", F.inline("near")))
    # a vector is found in the pool and in a cell at most, at one distance
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("score", "key"))
    merged = found.withColumn("place", place).where(F.col("place") <= 2 * (most + 1)).groupBy("h1", "h2").agg(
        F.array_sort(F.collect_list(F.struct("score", "key"))).alias("near"))
    once = merged.withColumn("near", F.expr("filter(near, (x, i) -> NOT exists(slice(near, 1, i), y -> y.key = x.key AND x.score - y.score <= 1e-12 * x.score))"))
    own = F.expr(f"slice(filter(near, x -> x.key != key), 1, {most})")
    return (
        known.join(once, ["h1", "h2"]).select("key", F.posexplode(own).alias("at", "x"))
        .select(F.col("key").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("x.key").alias(key), F.col("x.score").alias("score")))
