"""The near-duplicate stage of the pipeline against brute-force Jaccard similarity."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_fixtures import docs  # noqa: F401
from spendscope.llm import frames, near_copies
from test_large_operators import classes

SF = "/root/testdata/sf0.01"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset([tuple(words[i:i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else []))


def kept(texts):
    sets = {k: plain_set(t) for k, t in texts.items()}
    pairs = [(a, b) for a, b in combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return sorted(set(classes(pairs, sets).values()))


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.getrandbits(40)}"
    return out


def test_stage_as_brute_force_jaccard(spark):
    table = frames.read(spark, SF, "documents")
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    found = stage(spark, table, SF)
    assert found.columns == table.columns
    assert sorted(r["doc_id"] for r in found.collect()) == kept({r["doc_id"]: r["text"] for r in table.select("doc_id", "text").collect()})


@pytest.mark.parametrize("limit", [2048, 3])
def test_one_changed_word_is_a_near_copy(docs, limit):
    rng, rows = random.Random(5), []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows += [words, edited(rng, words, 1)]
    # a chain in which only neighbours are alike, and one group around a text with copies at both sides of 0.8
    words = [f"c{i}" for i in range(60)]
    rows += [words[i:] + [f"d{j}" for j in range(i)] for i in range(0, 30, 3)]
    base = [f"b{rng.randrange(5000)}" for _ in range(120)]
    rows += [edited(rng, base, n % 5) for n in range(40)]
    # the words before and after are few, or the same in another order
    rows += [["a", "b"], ["b", "a"], ["A", "b"], list("abcde"), list("abcdef"), list("bcdef"), list("abcdefghi"), list("abcdefgh")]
    rng.shuffle(rows)
    texts = {i: " ".join(r) for i, r in enumerate(rows)}
    found = sorted(r["doc_id"] for r in near_copies.deduplicated(docs(list(texts.items())), limit=limit).collect())
    assert found == kept(texts)


def loose_group(n, rng):
    """Texts around one base, each with words changed so that two have a similarity near 0.66."""
    base = [f"g{i}" for i in range(300)]
    return {i: " ".join(edited(rng, base, 6)) for i in range(n)}


def test_a_group_below_the_threshold_makes_no_pairs(docs, monkeypatch):
    counts, stars = {}, near_copies._stars
    for n in (400, 800):
        texts = loose_group(n, random.Random(n))
        sets = {k: plain_set(t) for k, t in texts.items()}
        some = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in list(combinations(range(40), 2))]
        assert 0.6 < np.mean(some) < 0.75
        seen = []

        def counted(cells):
            found = stars(cells)
            seen.extend([cells.count(), found.count()])
            return found

        monkeypatch.setattr(near_copies, "_stars", counted)
        assert near_copies.deduplicated(docs(list(texts.items()))).count() == len(kept(texts))
        counts[n] = seen
    # each set travels once, and a block gives fewer links than it has sets
    assert counts[400][0] <= 400 and counts[800][0] <= 800 and all(c[1] < c[0] for c in counts.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_of_several_blocks(docs, seed):
    """One large cluster with a main component, small ones and single texts, in blocks of 25 sets."""
    rng = random.Random(seed)
    base = [f"g{i}" for i in range(120)]
    texts = {}
    for i in range(160):
        texts[i] = " ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4, 5, 6])))
    own = texts[159].split()
    for i in range(160, 200):
        texts[i] = " ".join(edited(rng, own, 1))
    found = sorted(r["doc_id"] for r in near_copies.deduplicated(docs(list(texts.items())), limit=25).collect())
    assert found == kept(texts)


def test_blocks_by_hashes(docs, monkeypatch):
    """Long sets fill a block before there are many."""
    monkeypatch.setattr(near_copies, "HASHES", 700)
    texts = loose_group(30, random.Random(3))
    base = texts[0].split()
    texts |= {100 + i: " ".join(edited(random.Random(i), base, 1)) for i in range(30)}
    assert sorted(r["doc_id"] for r in near_copies.deduplicated(docs(list(texts.items()))).collect()) == kept(texts)


def plain_links(sets, labels, visiting=None):
    return {(a, b) for a, b in combinations(range(len(sets)), 2)
            if labels[a] != labels[b] and (visiting is None or visiting[a] != visiting[b])
            and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("n", [2, 5, 120])
def test_verified_forest_connects_what_is_alike(n):
    rng = random.Random(n)
    base = [f"g{i}" for i in range(80)]
    texts = [" ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4]))).encode() for _ in range(n)]
    sets = [near_copies.shingle_hashes(t) for t in texts]
    prints = np.stack([near_copies.wide_fingerprint(s) for s in sets])
    labels = np.array([rng.randrange(n) for _ in range(n)])
    for visiting in (None, np.array([rng.random() < 0.3 for _ in range(n)])):
        found = near_copies.verified_forest(prints, sets, labels, visiting)
        plain = plain_links([set(s.tolist()) for s in sets], labels, visiting)
        assert {tuple(sorted(p)) for p in found} <= plain and len(found) < max(2, n)
        same = [(("l", int(labels[a])), a) for a in range(n)]
        assert groups(found, same, n) == groups(plain, same, n)


def groups(pairs, same, n):
    """Which of the places are connected by pairs and equal labels."""
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in [*pairs, *same]:
        parent[root(b)] = root(a)
    return {frozenset(i for i in range(n) if root(i) == r) for r in {root(i) for i in range(n)}}


def test_pivots_discard_unrelated_pairs(spark):
    """In a group of several kinds of texts, pivots of the group discard nearly all pairs of
    different kinds, and no pair within reach."""
    texts = [t.encode() for t in {r["text"] for r in frames.read(spark, SF, "documents").where(
        F.length("text") > 300).select("text").collect()}][:8]
    rng = random.Random(4)
    many = [(k, " ".join(edited(rng, t.decode().split(), 1)).encode()) for k, t in enumerate(texts) for _ in range(25)]
    rng.shuffle(many)
    prints = np.stack([near_copies.wide_fingerprint(near_copies.shingle_hashes(t)) for _, t in many])
    bits = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    left = {(min(i, j), max(i, j)) for i, near, alive in near_copies.survivors(prints) for j in near[alive].tolist()}
    close = {(a, b) for a, b in combinations(range(len(many)), 2) if bits[a, b] <= near_copies.REACH}
    other = [(a, b) for a, b in combinations(range(len(many)), 2) if many[a][0] != many[b][0] and (a, b) not in close]
    assert close <= left
    discarded = 1 - len(left.intersection(other)) / len(other)
    print(f"pivots discard {discarded:.4f} of {len(other)} pairs beyond reach")
    assert discarded > 0.9


def test_names_with_dots_and_texts_read_for_clusters_only(spark, docs, monkeypatch):
    texts = {i: f"a{i} b c d e f g h i j k l m n o p q r s t u v w x y z" for i in range(4)} | {9: "quite another text is this one"}
    table = docs([*texts.items(), (None, texts[9]), (2, texts[2])]).withColumn("a.b", F.lit(1)).withColumnRenamed("text", "t.x").withColumnRenamed("doc_id", "d.id")
    found = near_copies.deduplicated(table, "t.x", "d.id")
    assert found.columns == table.columns and sorted(r["d.id"] for r in found.collect()) == kept(texts)
    monkeypatch.setattr(near_copies, "TABLE_BITS", 64)
    assert sorted(r["d.id"] for r in near_copies.deduplicated(table, "t.x", "d.id").collect()) == kept(texts)
