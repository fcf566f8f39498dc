"""SimHash, training order, quality rules and classifier, and the pipeline against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from llm_fixtures import docs, documents, prose  # noqa: F401
from spendscope.llm import decontam, frames, langid, near_copies, packing, pii, quality, queries, rules, simhash, stars, training_order

SF = "/root/testdata/sf0.01"
NONE = "doc_id long, text string, lang string, source string, n_chars long"


def classes(pairs, nodes):
    """Smallest reachable node of each node."""
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for start in sorted(nodes):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


# ---------------------------------------------------------------- components and SimHash


@pytest.mark.parametrize("pairs", [
    [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 300)] + [(1000, i) for i in range(1001, 1100)],
    [(i, 2 * i) for i in range(1, 200)] + [(7, 7), (3, 900), (900, 3)],
    [],
])
def test_components_of_links(spark, pairs):
    found = {r["node"]: r["root"] for r in stars.connected(spark.createDataFrame(pairs, "u long, v long")).collect()}
    expected = classes(pairs, {x for p in pairs for x in p})
    assert found == {n: r for n, r in expected.items() if n != r}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    found = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    counts = [0] * 64
    for s in found:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(found)) if found else 0


def test_fingerprints(prose):
    for text in prose:
        if not text or len(text) < 9000:
            assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("limit", [2048, 20, 1])
def test_links_connect_all_near_fingerprints(spark, limit):
    rng = random.Random(limit)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = set(centres)
    for c in centres:
        for _ in range(60):
            x = c
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = {x - (1 << 64) if x >> 63 else x for x in prints}
    pairs = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit).collect()
    assert all(((r["u"] ^ r["v"]) & ((1 << 64) - 1)).bit_count() <= 2 for r in found)
    assert classes([(r["u"], r["v"]) for r in found], signed) == classes(pairs, signed)


def test_simhash_query_as_brute_force(spark):
    docs = frames.read(spark, SF, "documents").select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs}
    pairs = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    expected = classes(pairs, prints)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash(spark, SF).collect()}
    assert found == {d: (f"{p:016x}", expected[d]) for d, p in prints.items()}


def test_deduplicated_keeps_one_of_each_group(spark, docs):
    a, b = "one two three four five six seven", "completely other words are in this one here"
    table = docs([(5, a), (3, a), (9, b), (9, b), (9, a), (1, None), (2, ""), (None, a), (None, "only null key here now"),
                  (None, "only null key here now"), (4, "x")])
    kept = near_copies.deduplicated(table)
    assert kept.columns == table.columns
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in kept.collect()) == [
        (0, "only null key here now"), (1, ""), (3, a), (4, "x"), (9, b)]
    found = {(r["doc_id"], r["component_id"]) for r in simhash.components(table).collect()}
    assert {(5, 3), (3, 3), (9, 9), (9, 3), (1, 1), (2, 1), (None, 3), (None, None), (4, 4)} == found
    nothing = spark.createDataFrame([], NONE)
    assert simhash.components(nothing).collect() == [] and near_copies.deduplicated(nothing).collect() == []


# ---------------------------------------------------------------- training order


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_slots_are_a_permutation(n):
    index = np.arange(n)
    slots = training_order.permuted(index, n, "k")
    assert sorted(slots) == list(range(n))
    assert (training_order.permuted(slots, n, "k", inverse=True) == index).all()
    assert n < 64 or (slots != training_order.permuted(index, n, "other")).any()


def test_shards_are_written_and_read_back(spark, docs, prose, tmp_path):
    from tokenizers import Tokenizer

    path, length, per_shard = queries.tokenizer_path(), 64, 16
    texts = [t for t in prose if not t or len(t) < 9000]
    table = docs(list(enumerate(texts)) + [(None, "no id")]).coalesce(2)
    rows = training_order.ordered(table, path, "key", length, per_shard)
    made = {r["slot"]: r for r in rows.collect()}
    n = len(made)
    assert sorted(made) == list(range(n)) and sorted(r["index"] for r in made.values()) == list(range(n))
    plain = Tokenizer.from_file(path)
    stream = Counter(i for t in [*texts, "no id"] for i in [*plain.encode(t or "", add_special_tokens=False).ids, 1])
    tokens = [np.frombuffer(r["payload"], dtype="<u2")[:r["n_tokens"]] for r in made.values()]
    assert Counter(np.concatenate(tokens).tolist()) == stream
    training_order.write(rows, f"{tmp_path}/out")
    stride = 2 * length + 1
    for folder in (tmp_path / "out").glob("shard=*"):
        (file,) = folder.glob("part-*")
        body, shard = file.read_bytes(), int(folder.name.split("=")[1])
        assert len(body) % stride == 0
        for i in range(len(body) // stride):
            assert body[i * stride:(i + 1) * stride - 1] == bytes(made[shard * per_shard + i]["payload"])
    start = n - per_shard - 3
    back = {r["slot"]: bytes(r["payload"]) for r in training_order.read(
        spark, f"{tmp_path}/out", length, from_slot=start, shard_rows=per_shard).collect()}
    assert back == {s: bytes(r["payload"]) for s, r in made.items() if s >= start}
    nothing = spark.createDataFrame([], NONE)
    assert training_order.ordered(nothing, path, "key").collect() == []


# ---------------------------------------------------------------- quality rules


def plain_statistics(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_statistics_as_brute_force(docs, prose):
    rng = random.Random(8)
    texts = prose + [" ".join(rng.choice("ab") for _ in range(n)) + "\n" + "same line\n" * (n % 4) for n in range(0, 120, 7)]
    texts += [" ".join(str(i) for i in range(200)) + " 5 6 7 tail 5 6 7"]
    rows = rules.statistics(docs(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == \
            plain_statistics(texts[r["doc_id"]]), texts[r["doc_id"]]


def tail(k, n, p):
    p = Fraction(p)
    return float(sum(Fraction(math.comb(n, i)) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 5, 50, 400) for k in (0, 1, 3, 7) if k < n * 0.05] + [(0, 0), (50, 60), (90, 3000)]
    rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", rules.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p")).collect()
    for r in rows:
        expected = 1.0 if r["n"] == 0 or r["k"] >= r["n"] * 0.05 else tail(r["k"], r["n"], 0.05)
        assert r["p"] == pytest.approx(expected, rel=1e-9)
    (big,) = spark.createDataFrame([(400_000, 10_000_000)], "k long, n long").select(
        rules.binomial_tail(F.col("k"), F.col("n"), 0.04002).alias("p")).collect()
    # about 0.32 standard deviations below the mean
    assert 0.36 < big["p"] < 0.39


def test_cutoffs_limit_false_rejections(spark):
    rng = random.Random(3)
    rows = [(i, 100 + i % 2000, False, rng.random() ** 30, 0.0, 0.0, 0.0, 5.0, i % 9 != 0) for i in range(30_000)]
    stats = spark.createDataFrame(rows, "doc_id long, n_words long, base_failed boolean, symbol_share double, dup_line_share double, "
                                  "repeat_share double, capital_share double, mean_word double, good boolean")
    labels = stats.select("doc_id", F.col("good").cast("int").alias("quality")).unionByName(
        spark.createDataFrame([(None, 1), (1, None), (2, 0)], "doc_id long, quality int"))
    plan = rules.Plan(risk=0.1, failure=0.05)
    chosen = {r["stratum"]: r for r in rules.cutoffs(stats, labels, plan).collect()}
    assert set(chosen) == {0, 1, 2}
    own = [r for r in rows if r[8] and r[0] != 2]
    for s, r in chosen.items():
        mine = [x[3] for x in own if (x[1] >= 200) + (x[1] >= 1000) == s]
        assert r["n"] == len(mine)
        best = None
        for c in plan.cutoffs[0][1]:
            k = sum(x > c for x in mine)
            if k >= len(mine) * 0.1 or tail(k, len(mine), Fraction(1, 10)) > 0.05 / 3:
                break
            best = c
        assert r["symbol_share_cutoff"] == best and best is not None
        step = plan.cutoffs[0][1].index(best)
        assert r["mean_word_cutoff"] == plan.cutoffs[4][1][min(step, 7)]


def test_rules_reject_bad_documents_and_few_good_ones(spark):
    """At sf0.1 two strata have labels enough, and what is rejected there is bad."""
    big = "/root/testdata/sf0.1"
    docs, labels = frames.read(spark, big, "documents"), frames.read(spark, big, "labels")
    stats = frames.checkpointed(rules.statistics(docs))
    limits = rules.cutoffs(stats, labels).collect()
    assert sum(r["mean_word_cutoff"] is not None for r in limits) >= 2
    found = rules.judged(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("NOT base_failed").collect()
    good, bad = ([r["kept"] for r in found if r["quality"] == q] for q in (1, 0))
    print(f"rules reject {bad.count(False)} of {len(bad)} bad and {good.count(False)} of {len(good)} good documents")
    assert good.count(False) <= 0.01 * len(good) and bad.count(False) > good.count(False)


def test_rules_query_keeps_good_documents(spark, docs):
    found = queries.op4_quality_rules(spark, SF).join(frames.read(spark, SF, "labels"), "doc_id").where("quality = 1 AND NOT base_failed").collect()
    assert sum(r["kept"] for r in found) / len(found) >= 0.99
    labels = spark.createDataFrame([], "doc_id long, quality int")
    table = docs([(1, "w " * 60), (2, None), (None, " ".join(map(str, range(60)))), (None, " ".join(map(str, range(60))))])
    assert [r["kept"] for r in rules.judged(table, labels).orderBy("n_words", "n_repeat_words").collect()] == [False, True, True, False]
    assert rules.judged(spark.createDataFrame([], NONE), labels).collect() == []


# ---------------------------------------------------------------- classifier


def test_quality_on_held_out_labels(spark):
    found = queries.op1_quality_classifier(spark, SF).join(frames.read(spark, SF, "labels"), "doc_id").where("held_out").collect()
    good = [r["score"] for r in found if r["quality"] == 1]
    bad = [r["score"] for r in found if r["quality"] == 0]
    assert len(good) > 30 and len(bad) > 5
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
    assert auc > 0.95
    assert sum(r["predicted"] == r["quality"] for r in found) / len(found) > 0.92


def test_linear_time_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    shape = quality.Shape(bits=6)
    model = quality.Model(shape, 0.3, rng.normal(size=shape.size), rng.normal(size=(shape.size, 4)))
    rows = [shape.features(t, (n,)) for t, n in [(b"a b c d A b", 11), (b"", 0), (None, None), ("é ! ## | X".encode(), 10)]]
    scores = quality.forward(model, *quality.together(rows))[0]
    for (index, value), score in zip(rows, scores):
        pairs = sum(model.factors[i] @ model.factors[j] * x * y
                    for (i, x), (j, y) in combinations(list(zip(index, value)), 2))
        assert score == pytest.approx(0.3 + (model.linear[index] * value).sum() + pairs, rel=1e-6)


def test_quality_of_special_rows(spark, docs, prose):
    table = docs(list(enumerate(prose)) + [(None, "x"), (0, "again")])
    labelled = table.where("doc_id < 100").withColumn("quality", (F.col("doc_id") % 3 > 0).cast("int"))
    labelled = labelled.unionByName(labelled.limit(3).withColumn("quality", F.lit(None).cast("int")))
    rows = quality.scores(table, quality.fit(labelled)).collect()
    assert len(rows) == len(prose) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    untrained = quality.fit(labelled.where("false"))
    assert {r["score"] for r in quality.scores(table, untrained).collect()} == {0.5}
    assert quality.scores(spark.createDataFrame([], NONE), untrained).collect() == []


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_as_plain_versions(spark):
    docs = frames.read(spark, SF, "documents").limit(400)
    extra = spark.createDataFrame([(9001, "12 34 !!", None, None, None), (9002, None, None, None, None), (9003, "mail a.b@c.de to the end of that", "en", "s", 32)], NONE)
    stage = dict(corpus_pipeline.STAGES)
    table = docs.unionByName(extra).cache()
    known = stage["language ID"](spark, table, SF).cache()
    assert known.columns == table.columns
    assert {r["doc_id"] for r in table.collect()} - {r["doc_id"] for r in known.collect()} == {9001, 9002}
    from test_near_copies import kept

    single = stage["SimHash near-dedup"](spark, known, SF).cache()
    assert sorted(r["doc_id"] for r in single.collect()) == kept({r["doc_id"]: r["text"] for r in known.collect()})
    assert single.columns == table.columns
    clean = stage["benchmark decontamination"](spark, single, SF).cache()
    bad = {r["doc_id"] for r in queries.op5_decontamination(spark, SF).where("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - bad and clean.columns == table.columns
    private = stage["PII"](spark, clean, SF).cache()
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in (clean, private))
    assert {d: pii.scrubbed(t) for d, t in before.items()} == after and private.columns == table.columns
    assert after[9003] == "mail <EMAIL> to the end of that"
    out = stage["packing"](spark, private, SF).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    tokens = defaultdict(list)
    for r in sorted(out, key=lambda r: r["start"]):
        tokens[r["doc_id"]] += r["ids"]
    assert tokens == {d: [*plain.encode(t, add_special_tokens=False).ids, 1] for d, t in after.items()}


def test_pipeline_runs_on_an_empty_table(spark):
    docs = spark.createDataFrame([], NONE)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
