"""Periodic runs against a plain search, the transform against direct sums."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import SF, docs, documents, prose  # noqa: F401
from spendscope.llm import queries, runs


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and all(
                    any(words[i + k] != words[i + k + r] for k in range(length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(key, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(key).encode())
    if h % 10 == 0 and n and key is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


repeats = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=8).map(
    lambda parts: [x for word, times in parts for x in word * times])


@settings(max_examples=400, deadline=None)
@given(repeats, st.integers(1, 5))
def test_runs_as_plain_search(word, times):
    codes = word * times
    assert [tuple(r) for r in runs.periodic_runs(np.array(codes, dtype=np.int64))] == plain_runs(codes)


@pytest.mark.parametrize("seed", range(4))
def test_long_periods_inside_of_noise(seed):
    rng = random.Random(seed)
    codes = []
    for period in (37, 64, 100, 127):
        codes += [rng.randrange(3) for _ in range(rng.randrange(50))]
        codes += ([rng.randrange(4) for _ in range(period)] * 6)[:period * 4 + rng.randrange(60)]
    assert [tuple(r) for r in runs.periodic_runs(np.array(codes, dtype=np.int64))] == plain_runs(codes)


@pytest.mark.parametrize("prime, generator", runs.PRIMES)
@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_transform_gives_squared_differences(prime, generator, size):
    rng = np.random.default_rng(size)
    blocks, windows = rng.integers(0, 1 << 20, (5, size)), rng.integers(0, 1 << 20, (5, 2 * size))
    windows[0, size // 2:size // 2 + size] = blocks[0]
    plain = [[sum((int(x) - int(y)) ** 2 for x, y in zip(b, w[j:])) % prime for j in range(size)] for b, w in zip(blocks, windows)]
    found = runs.differences(blocks, windows, prime, generator)
    assert found.tolist() == plain and found[0, size // 2] == 0


def test_large_numbers_need_more_primes():
    # the difference is a multiple of the first prime, and its square of no other
    prime = runs.PRIMES[0][0]
    codes = np.array([0, prime, 0, prime, 0, prime, 0, prime] * 2, dtype=np.int64)
    assert [tuple(r) for r in runs.periodic_runs(codes)] == [(0, 16, 2)]
    assert runs.periodic_runs(np.array([0, prime, 2 * prime, 3 * prime] * 2, dtype=np.int64)) == []


@pytest.mark.parametrize("codes", [[0] * 60_000, list(range(500)) * 120, ([0] * 50 + [1]) * 1200],
                         ids=["one word", "one long period", "runs inside of a run"])
def test_long_texts_are_no_squares(codes):
    found = runs.periodic_runs(np.array(codes, dtype=np.int64))
    assert max(r.length for r in found) == len(codes)


def test_query_as_plain_version(spark, documents):
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    found = {r["doc_id"]: tuple(r[c] for c in names) for r in queries.op12_periodic_runs(spark, SF).collect()}
    short = {r["doc_id"]: r["text"] for r in documents.collect() if len((r["text"] or "").split()) <= 400}
    assert len(found) == documents.count() and any(found[d][0] for d in short)
    assert {d: found[d] for d in short} == {d: plain_row(d, t) for d, t in short.items()}


def test_special_rows(spark, docs, prose):
    texts = [t for t in prose if t is None or len(t) < 20_000] + ["a b " * 3 + "a", "a b " * 4, "x " * 5, "x " * 6]
    rows = list(enumerate(texts)) + [(None, "z " * 9), (0, texts[0])]
    found = runs.digest(runs.runs(docs(rows), plant=True)).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(str((k, *plain_row(k, t))) for k, t in rows)
    dotted = docs([(1, "b " * 8)]).withColumnRenamed("doc_id", "a.id").withColumnRenamed("text", "a.text")
    row = runs.digest(runs.runs(dotted, "a.text", "a.id"), "a.id").first()
    assert (row["a.id"], row["length"], row["period"]) == (1, 8, 1)
    assert runs.digest(runs.runs(docs([(1, "x")]).where("false"))).collect() == []
    long = runs.runs(docs([(1, "word " * 300_000)])).first()
    assert long["runs"][0]["length"] == 300_000 and long["collapsed"] == "word"
