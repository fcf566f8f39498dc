"""Suffix dedup against a brute-force version."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from spendscope.llm import suffix_dedup

W = suffix_dedup.WIDTH


def brute(rows):
    """By order of (key, place in the list): removed runs and kept bytes of each row."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        text = (rows[i][1] or "").encode()
        gone = [False] * len(text)
        for a in range(len(text) - W + 1):
            string = text[a:a + W]
            if string in seen:
                gone[a:a + W] = [True] * W
            seen.add(string)
        kept = bytes(c for c, g in zip(text, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out[i] = (rows[i][0], len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def same(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, spans string").repartition(3)
    if len({k for k, _ in rows}) < len(rows):
        docs = docs.coalesce(1).orderBy("doc_id")
    found = suffix_dedup.removed(docs, **options)
    mine = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]),
             hashlib.sha256(r["kept"]).hexdigest()) for r in found.collect()]
    assert sorted(mine, key=key) == sorted(brute(rows).values(), key=key)


def corpus(seed, n=60):
    rng = random.Random(seed)

    def prose(size):
        return "".join(rng.choice(["the ", "of ", "éà", "tion ", "ab", "\n", "x"]) for _ in range(size))

    shared = [prose(rng.randint(20, 120)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [rng.choice([prose(rng.randint(0, 60)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 30):]])
                 for _ in range(rng.randint(0, 5))]
        texts.append("".join(parts))
    texts += [texts[3], texts[3] + "!", None, "", "a" * 99, "a" * 100, "a" * 101, "a" * 400, "ab" * 300, "ab" * 200 + "c",
              prose(4000), "é" * 50, "é" * 90]
    return texts


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 2000}, {"bucket_bytes": 2000, "hot": 1}, {"bucket_bytes": 9000, "hot": 4},
                                     {"bucket_bytes": 9000, "hot": 4, "mark_bits": 18}, {"bucket_bytes": 9000, "hot": 30, "mark_bits": 3}])
def test_as_brute_force(spark, options):
    texts = corpus(len(str(options)))
    ids = list(range(-5, len(texts) - 5))
    random.Random(3).shuffle(ids)
    same(spark, list(zip(ids, texts)), **options)


def test_one_common_line(spark):
    rng = random.Random(1)
    line = "".join(rng.choice("abcdefgh ") for _ in range(170))
    texts = [f"{rng.random()}" * rng.randint(1, 4) + line + f"{rng.random()}" * rng.randint(0, 5) for _ in range(150)]
    for hot in (5, 10_000):
        same(spark, list(enumerate(texts)), hot=hot, bucket_bytes=5000)


def test_marks_are_the_bits_of_hot_anchors():
    rng = np.random.default_rng(4)
    hot, other = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (40, 4000))
    for bits in (3, 20, 27):
        batch = pa.RecordBatch.from_pydict({"payload": [suffix_dedup.pack(hash=hot[:25]), suffix_dedup.pack(hash=hot[25:])]})
        table = pa.Table.from_batches(suffix_dedup._marked(bits)([batch]))
        keys = sorted(set(table.column("piece").to_pylist()))
        pieces = [suffix_dedup._piece((pa.scalar(k),), table.filter(pa.compute.equal(table.column("piece"), k))) for k in keys]
        marks = suffix_dedup.Marks([(k, p.column("bits")[0].as_py()) for k, p in zip(keys, pieces)], bits)
        taken = {int(h) >> (64 - bits) for h in hot}
        assert marks(hot).all() and marks(other).tolist() == [int(h) >> (64 - bits) in taken for h in other]
    assert not suffix_dedup.Marks([], 27)(other).any()


def test_keys_repeated_or_null(spark):
    text = corpus(5)[-3]
    rows = [(1, text), (1, text), (None, text[200:900]), (None, text[200:900]), (2, text[:500]), (0, "b" * 150)]
    same(spark, rows)


def test_query_as_brute_force(spark):
    from spendscope.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = queries.op6_suffix_dedup(spark, sf).collect()
    assert sorted(map(tuple, found)) == sorted(brute(rows).values())
    assert sum(r["n_removed"] for r in found) > 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.digest(docs).collect() == []


def test_leaves_are_the_equal_strings():
    rng = random.Random(2)
    rows = [bytes(rng.choice(b"ab") for _ in range(3)) * 60 for _ in range(300)]
    rows = [r[:rng.randint(60, 168)].ljust(168, b"z") for r in rows]
    spread = suffix_dedup.expanded(np.frombuffer(b"".join(rows), dtype="<u8").reshape(-1, 21))
    rep, s = np.repeat(np.arange(300), 5), np.tile(np.arange(0, 50, 10), 300)
    leaf = suffix_dedup.leaves(spread, rep, s, s)
    by_leaf, by_string = {}, {}
    for i, (r, a) in enumerate(zip(rep, s)):
        by_leaf.setdefault(leaf[i], set()).add(i)
        by_string.setdefault((a, rows[r][a:a + W]), set()).add(i)
    assert sorted(map(sorted, by_leaf.values())) == sorted(map(sorted, by_string.values()))
