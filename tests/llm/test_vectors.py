"""Whitening against numpy's eigenvectors, neighbours against brute force."""

import math

import numpy as np
import pytest

from spendscope.llm import frames, nearest, queries, whitening

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def table(spark, rows, key="vec_id", vector="embedding"):
    """With further columns whose names the operators use."""
    return spark.createDataFrame([(k, v, "x", 1, 2.0, 3) for k, v in rows],
                                 f"`{key}` long, `{vector}` array<float>, list string, n int, score double, component int")


ODD = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0]), (903, [NAN, 0.0, 0.0, 1.0]), (904, [INF, 0.0, 0.0, 1.0]),
       (905, [1.0, 2.0]), (906, [1.0] * 5)]


def plain_whitening(x):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    e, w = np.linalg.eigh(cov)
    return n, sums, e[::-1], w[:, ::-1], np.trace(cov)


def check(found, keys, x, components=16):
    n, sums, e, w, trace = plain_whitening(x)
    got = np.full((len(keys), components), np.nan)
    place = {k: i for i, k in enumerate(keys)}
    for r in found:
        own = x[place[r["vec_id"]]]
        got[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(own, sums))
        assert abs(r["explained"] - e[r["component"] - 1] / trace) <= 1e-10 and 0 <= r["identity_error"] <= 1e-8
    plain = (x - sums / n) @ w[:, :components] / np.sqrt(e[:components])
    for c in range(components):
        assert min(np.abs(got[:, c] - plain[:, c]).max(), np.abs(got[:, c] + plain[:, c]).max()) < 1e-7


def test_whitening_query_as_numpy(spark):
    rows = frames.read(spark, SF, "embeddings").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in rows], dtype=np.float64)).astype(np.int64) + 1_000_000
    found = queries.op13_whitening(spark, SF).collect()
    assert len(found) == 16 * len(rows)
    check(found, [r["vec_id"] for r in rows], x)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(rng.standard_normal((40, 4)) * [9, 4, 2, 1])]
    good += [(50, [0.0] * 4)] + [(60 + i, good[0][1]) for i in range(200)]
    found = whitening.whitened(table(spark, good + ODD)).collect()
    x = np.floor(64 * np.array([v for _, v in good])).astype(np.int64) + 1_000_000
    assert len(found) == 4 * len(good)
    check(found, [k for k, _ in good], x, 4)
    twice = whitening.whitened(table(spark, [*good, (None, good[1][1]), good[0]])).collect()
    assert len(twice) == 4 * (len(good) + 2)
    renamed = whitening.whitened(table(spark, good, "a.id", "a.vec"), "a.vec", "a.id")
    assert renamed.columns[0] == "a.id" and renamed.count() == 4 * len(good)


def test_whitening_without_a_spread(spark):
    for rows in ([], ODD[:2], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        assert whitening.whitened(table(spark, rows)).collect() == []
    flat = whitening.whitened(table(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 5 and abs(flat[0]["explained"] - 1) < 1e-12


def products(x):
    x = x - x.mean(axis=0)
    steps = []

    def product(q):
        steps.append(1)
        y = x @ q
        return x.T @ y, float(y @ y)
    return product, np.linalg.svd(x), steps


@pytest.mark.parametrize("make, most_steps", [
    (lambda r: r.standard_normal((3000, 24)), 24),
    (lambda r: r.standard_normal((3000, 200)) * np.exp(-np.arange(200) / 6), 100),
    (lambda r: r.standard_normal((9, 40)), 40),
    (lambda r: r.standard_normal((300, 3)) @ r.standard_normal((3, 30)), 30),
    (lambda r: np.vstack([np.eye(20), -np.eye(20)]), 20),
    (lambda r: np.linalg.qr(r.standard_normal((900, 100)))[0] * np.r_[5, 3, 3, 3, 1, 1, np.full(94, 0.01)], 200),
    (lambda r: np.zeros((5, 20)), 20),
], ids=["flat", "falling", "few rows", "low rank", "all equal", "equal values", "nothing"])
def test_bidiagonalisation(make, most_steps):
    product, (_, values, right), steps = products(make(np.random.default_rng(5)))
    found, rows = whitening.principal(product, right.shape[1], 5)
    assert np.allclose(found, np.append(values, np.zeros(5))[:5], atol=1e-11 * max(1, values[0])) and len(steps) <= most_steps
    assert np.allclose(rows @ rows.T, np.eye(5), atol=1e-12)


def test_deviations_beyond_64_bits():
    small, large = np.array([[1, 2], [3, 5]]), np.array([[1 << 40, 0], [0, 1 << 40], [5, 5]])
    assert whitening._deviations(small, 2, [4, 7]) == [13, 13]
    assert whitening._deviations(large, 3, large.sum(axis=0).tolist()) == [
        d if (d := sum((3 * int(a) - int(s)) ** 2 for a, s in zip(row, large.sum(axis=0)))) < 1 << 63 else None for row in large]


# ---------------------------------------------------------------- neighbours


def plain_nearest(rows, most=10):
    keys, x = [k for k, _ in rows], np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for key, own in rows:
        if key % 100 == 0:
            away = np.sqrt(((x - np.array(own, dtype=np.float64)) ** 2).sum(axis=1)).tolist()
            out[key] = sorted({(d, k) for d, k in zip(away, keys) if k != key})[:most]
    return out


def answers(found, key="vec_id"):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        own = out.setdefault(r["query_id"], [])
        own.append((r["score"], r[key]))
        assert r["rank"] == len(own)
    return out


def recall(found, plain):
    return sum(len({k for _, k in found[q]} & {k for _, k in near}) for q, near in plain.items()) / sum(map(len, plain.values()))


def test_neighbours_query_against_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.1"):
        rows = [(r["vec_id"], r["embedding"]) for r in frames.read(spark, sf, "embeddings").collect()]
        found, plain, away = answers(queries.op11_nearest(spark, sf)), plain_nearest(rows), dict(rows)
        assert found.keys() == plain.keys() and all(len(found[q]) == 10 for q in found)
        assert all(math.isclose(s, math.dist(away[q], away[k]), rel_tol=1e-12) and k != q for q in found for s, k in found[q])
        assert recall(found, plain) >= 0.95


def clusters(n, seed=2, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, dim)) * 4
    x = (centres[rng.integers(0, 30, n)] + rng.standard_normal((n, dim))).astype(np.float32)
    return [(i, row) for i, row in enumerate(x.tolist())]


def test_neighbours_in_lists_dealt_to_cells(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL", 100)
    monkeypatch.setattr(nearest, "QUERIES", 3)
    rows = clusters(4000)
    frame = table(spark, rows)
    index = nearest.indexed(frame, fit_rows=1000)
    assert index.rows.count() == 4000 and index.probes < len(index.centroids)
    found = answers(nearest.search(index, frame.where("vec_id % 100 = 0")))
    assert recall(found, plain_nearest(rows)) >= 0.95


def test_copies_and_ties(spark):
    # a third of the rows share one vector, queries too; others tie in pairs
    rows = [(i, [1.0, 1.0, 0.0]) for i in range(0, 3000, 3)] + [(i, [float(i % 7), float(i // 7 % 5), 1.0]) for i in range(1, 3000, 3)]
    frame = table(spark, rows)
    index = nearest.indexed(frame, lists=1)
    found, plain = answers(nearest.search(index, frame.where("vec_id % 100 = 0"))), plain_nearest(rows)
    assert found == plain
    assert max(len(r["keys"]) for r in index.rows.collect()) == 11


def test_neighbours_of_odd_rows(spark):
    good = [(100 * i, [float(i), 1.0, 2.0, 0.0]) for i in range(6)]
    odd = ODD + [(1000, [0.0, -0.0, 0.0, 0.0]), (1100, [2.0 ** 126] * 4), (None, [1.0, 1.0, 1.0, 1.0])]
    rows = [*good, good[0], (100, [9.0, 9.0, 9.0, 9.0]), (1100, [2.0 ** 126] * 4)]
    frame = table(spark, [*good, good[0], (100, [9.0, 9.0, 9.0, 9.0]), *odd])
    found = answers(nearest.search(nearest.indexed(frame), frame.where("vec_id % 100 = 0 AND vec_id != 100")))
    plain = plain_nearest(sorted({(k, tuple(v)) for k, v in rows}))
    assert found == {q: near for q, near in plain.items() if q != 100}
    own = nearest.search(nearest.indexed(frame), frame.where("vec_id = 100")).collect()
    assert sorted(r["vec_id"] for r in own) == sorted([0, 200, 300, 400, 500, 1100] * 2) and {r["query_id"] for r in own} == {100}
    dotted = table(spark, good, "a.id", "a.vec")
    assert nearest.search(nearest.indexed(dotted, vector="a.vec", key="a.id"), dotted, "a.vec", "a.id").count() == 30
    assert nearest.indexed(table(spark, ODD[:2])) is None and nearest.indexed(table(spark, [])) is None
    alone = table(spark, [(0, [1.0])])
    assert nearest.search(nearest.indexed(alone), alone).collect() == []


def test_tests_abandon_far_candidates_only():
    rng = np.random.default_rng(8)
    turn = nearest.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    c = rng.standard_normal((4000, 64)) @ turn
    q = rng.standard_normal((50, 64)) @ turn
    true = np.sqrt(((q[:, None] - c[None]) ** 2).sum(axis=2))
    bounds = np.sort(true, axis=1)[:, 10]
    i, j = nearest.survivors(q, c, bounds)
    wanted = {(a, b) for a in range(50) for b in np.flatnonzero(true[a] <= bounds[a])}
    alive = set(zip(i.tolist(), j.tolist()))
    assert len(alive & wanted) >= 0.98 * len(wanted) and alive <= wanted
    first = nearest.survivors(q[:, :16], c[:, :16], bounds * 0.5)
    assert len(first[0]) < 0.2 * true.size
