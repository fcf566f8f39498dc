"""Language ID, personal data, decontamination, packing and sharding against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_fixtures import docs, documents, prose  # noqa: F401
from spendscope.llm import decontam, frames, langid, packing, pii, queries, sharding
from spendscope.llm.tokens import encoder

SF = "/root/testdata/sf0.01"
NONE = "doc_id long, text string, lang string, source string, n_chars long"


# ---------------------------------------------------------------- language ID


def test_language_held_out_accuracy(spark):
    found = queries.op10_language_id(spark, SF).join(frames.read(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert len(rows) > 200
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_special_texts(spark, docs, documents):
    model = langid.fit(langid.learned(documents))
    table = docs([(1, None), (2, ""), (3, "123 !? ٣"), (4, "é" * 900_000), (5, "the of and that"), (5, "the of and that"), (None, "der die und")])
    found = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(table, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (5, "en"), (None, "de")} <= found and len(found) == 6
    kept = langid.identified(table, model)
    assert kept.columns == table.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 4, 5, 5]


def test_language_without_anything_to_learn_or_predict(spark, docs, documents):
    nothing = spark.createDataFrame([], NONE)
    model = langid.fit(nothing)
    assert {r["lang_pred"] for r in langid.predict(docs([(1, "the")]), model).collect()} == {"und"}
    assert langid.predict(nothing, langid.fit(documents)).collect() == []
    with pytest.raises(ValueError):
        langid.fit(documents, max_languages=2)


def test_grams_of_long_texts_come_in_pieces():
    text = "the quick brown fox " * 50
    whole, pieces = langid.Grams(1 << 12), langid.Grams(1 << 12, chunk=97)
    both = [Counter(x for _, p in g.pieces([text, None, "ab"]) for x in g.hashed(p)[1].ravel().tolist() if x < 1 << 12)
            for g in (whole, pieces)]
    assert both[0] == both[1] and sum(both[0].values()) > 2000


# ---------------------------------------------------------------- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def ok(kind, s):
        number = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
            return 16 <= len(number) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
        return kind == "email" or 8 <= len(number) <= 15

    return [(k, *m.span()) for k, p in PLAIN.items() for m in re.finditer(p, text) if ok(k, m.group())]


def test_base_spans_as_plain_patterns(prose):
    rng = random.Random(4)
    noise = ["".join(rng.choice("ab.@-+ 0123456789()%_\n") for _ in range(80)) for _ in range(3000)]
    for text in [t for t in prose if t and len(t) < 9000] + noise:
        assert pii.base_spans(text) == plain_spans(text)
        kinds = [s for s in pii.find(text) if s.kind in pii.BASE_KINDS]
        assert [(s.kind, s.start, s.end) for s in kinds] == plain_spans(text)


def test_validators_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    assert [s.kind for s in pii.find("IBAN DE89 3704 0044 0532 0130 00 here")] == ["iban"]
    assert [s.kind for s in pii.find("amex card 378282246310005")] == ["shortcard"]
    assert pii.find("number 378282246310005") == [] and pii.find("invoice card 378282246310005") == []
    assert [s.kind for s in pii.find("call 555-123-4567 now")] == ["localphone"] and pii.find("see 555-123-4567") == []
    assert pii.find("card at x@y.de").pop().score == pii.find("at x@y.de").pop().score


def test_pii_digest_and_redaction(docs, prose):
    table = docs(list(enumerate(prose)) + [(None, "a@b.cd")])
    rows = {r["doc_id"]: r for r in pii.digest(pii.spans(table)).collect()}
    for i, text in list(enumerate(prose)) + [(None, "a@b.cd")]:
        base = plain_spans(text) if text and len(text) < 9000 else pii.base_spans(text or "")
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(b[0] == k for b in base) for k in pii.BASE_KINDS]
    clean = pii.redacted(table)
    assert clean.columns == table.columns
    for r in clean.collect():
        assert pii.find(r["text"]) == []
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert pii.redact("a a@b.cd, 1.2.3.4", pii.find("a a@b.cd, 1.2.3.4")) == "a <EMAIL>, <IP>"


# ---------------------------------------------------------------- decontamination


def plain_hits(rows, items, size=13):
    def words(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    patterns = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            patterns.setdefault(tuple(w[i:i + size]), set()).add(item)
    for key, text in rows:
        w, hit, found = words(text), set(), set()
        for p, names in patterns.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i:i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found |= {str(n) for n in names if n is not None}
        yield key, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_as_brute_force(spark, docs, block_bytes):
    rng = random.Random(9)

    def text(n):
        return " ".join(rng.choice(["a", "B", "é", "c3", "d-e", "f"]) for _ in range(n))

    items = [(i, text(n)) for i, n in enumerate((30, 14, 13, 12, 5, 2, 1, 0, 40))] + [(3, text(9)), (None, "zz yy xx"), (20, None)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 40)), (rng.choice(items)[1] or "")[:rng.randint(5, 90)].upper(), text(rng.randint(0, 300))]
        rows.append((i, " ".join(parts)))
    rows += [(100, None), (101, ""), (102, "zz YY, xx"), (102, "zz YY, xx"), (None, items[0][1]), (103, "zz yy xx " + "q " * 57), (104, "zz yy xx " + "q " * 58)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = docs(rows)
    found = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"])
             for r in decontam.hits(table, benchmark, block_bytes=block_bytes).collect()]
    expected = list(plain_hits(rows, items))
    assert sorted(map(str, found)) == sorted(map(str, expected))
    clean = decontam.clean(table, benchmark, block_bytes=block_bytes)
    assert clean.columns == table.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(e[0] for e in expected if not e[4])


def test_blocks_of_the_benchmark_store_no_text(spark, docs, monkeypatch):
    """What is kept of a block are rows of texts with hits; a text that many rows hold gives one."""
    kept = []
    monkeypatch.setattr(decontam, "_found", lambda *given, real=decontam._found: kept.append(real(*given)) or kept[-1])
    items = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(8)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"own {i} " + (items[i % 8][1] if i % 5 == 0 else "rest " * 30)) for i in range(200)]
    rows += [(1000 + i, items[3][1] + " and " + items[5][1]) for i in range(150)] + [(2000, None)]
    found = {r["doc_id"]: (r["n_words"], r["runs"], r["items"])
             for r in decontam.hits(docs(rows), benchmark, block_bytes=400).collect()}
    one = {r["doc_id"]: (r["n_words"], r["runs"], r["items"]) for r in decontam.hits(docs(rows), benchmark).collect()}
    assert found == one and found[1000] == (41, [0, 20, 21, 41], ["3", "5"])
    assert len(kept) > 1 and all(k.columns == ["print", "runs", "items"] for k in kept)
    assert 41 <= sum(k.count() for k in kept) <= 42


def test_joined_runs():
    assert decontam.joined([5, 9, 0, 3, 8, 12, 3, 4]) == [0, 4, 5, 12]
    assert decontam.joined([]) == []


def test_decontamination_with_empty_tables(spark, docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    (row,) = decontam.hits(docs([(1, "a b")]), nothing).collect()
    assert (row["n_words"], row["n_hit"], row["items"], row["contaminated"]) == (2, 0, [], False)
    assert decontam.hits(spark.createDataFrame([], NONE), nothing).collect() == []


# ---------------------------------------------------------------- packing


def test_pieces_hold_every_token_once(spark, docs, prose):
    path = queries.tokenizer_path()
    rows = list(enumerate(prose)) + [(3, "again"), (None, "no id")]
    out = packing.pieces(docs(rows), path, block_tokens=20_000).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    expected = Counter()
    for key, text in rows:
        expected[key, tuple([*plain.encode(text or "", add_special_tokens=False).ids, 1])] += 1
    by_row, by_sequence = {}, {}
    for r in out:
        assert r["length"] == len(r["ids"]) > 0
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))
        by_row.setdefault((r["row"], r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"]))
    found = Counter()
    for (_, key, total), parts in by_row.items():
        ids = [i for start, own in sorted(parts) for i in own]
        assert len(ids) == total and sorted(parts)[0][0] == 0
        found[key, tuple(ids)] += 1
    assert found == expected
    for parts in by_sequence.values():
        at = 0
        for offset, length, tier in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0 and at == parts[0][2]
    steps = Counter()
    for r in out:
        steps[r["step_group"]] += r["length"]
    assert max(steps.values()) <= 65_536 + 2048
    assert packing.pieces(spark.createDataFrame([], NONE), path).collect() == []


def test_quick_encoder_gives_the_same_ids(prose, documents):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain, quick = Tokenizer.from_file(path), encoder(path)
    texts = [r["text"] for r in documents.select("text").collect()] + [t for t in prose if t and len(t) < 9000]
    texts += ["it's we'll 'd", "a  b", "end ", " start", "a\n\nb", "<|endoftext|> x", "tab\tx", "_a_1-é²", "\x85", "ÀÖØöøÿ×÷"]
    for text in texts:
        assert quick.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


# ---------------------------------------------------------------- sharding


def sharded(table, shards=8):
    rows = sharding.assigned(table, shards).collect()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r)
    for own in by_shard.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return rows, {s: sum(r["size"] for r in own) for s, own in by_shard.items()}


def test_shards_are_level_and_keep_groups(docs, prose):
    rng = random.Random(2)
    texts = ["x" * int(rng.lognormvariate(5, 1)) + str(i) for i in range(3000)]
    rows = list(enumerate(texts)) + [(5000 + i, "hot copy") for i in range(300)] + list(enumerate(prose[:155], 9000)) + [(None, "n"), (7, "same id")]
    found, loads = sharded(docs(rows))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    assert len({r["shard"] for r in found if r["doc_id"] and 5000 <= r["doc_id"] < 5300}) == 1
    assert len({r["shard"] for r in found if r["size"] == 1}) == 1
    assert max(loads.values()) - min(loads.values()) <= 0.001 * sum(loads.values())


def test_sharding_of_few_or_no_rows(spark, docs):
    assert sharding.assigned(spark.createDataFrame([], NONE)).collect() == []
    _, loads = sharded(docs([(1, None), (2, ""), (3, "abc")]))
    assert sorted(loads.values()) == [2, 4]


def test_schedule_gives_the_largest_to_the_least_loaded():
    assert sharding.schedule({1: 7, 2: 5, 3: 4, 4: 3, 5: 3}, 2) == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1}


# ---------------------------------------------------------------- what stands beside a number


@pytest.mark.parametrize("text, kind, number", [
    ("IBAN GB82 WEST 1234 5698 7654 32 AND more", "iban", "GB82 WEST 1234 5698 7654 32"),
    ("IBAN DE89 3704 0044 0532 0130 00 OK", "iban", "DE89 3704 0044 0532 0130 00"),
    ("our bank AB12 GB82 WEST 1234 5698 7654 32.", "iban", "GB82 WEST 1234 5698 7654 32"),
    ("account DE89370400440532013000", "iban", "DE89370400440532013000"),
    ("credit card 3782 822463 10005 777", "shortcard", "3782 822463 10005"),
    ("credit card 99 3782 822463 10005", "shortcard", "3782 822463 10005"),
])
def test_added_kinds_beside_other_words(text, kind, number):
    (span,) = pii.find(text)
    assert span.kind == kind and text[span.start:span.end] == number and number not in pii.scrubbed(text)


@pytest.mark.parametrize("text", ["IBAN GB82 WEST 1234 5698 7654 33 AND more", "IBAN GB82 WEST 1234 5698 7654 3", "bank XX82 WEST 1234 5698 7654 32",
                                  "bank DE89 3704  0044 0532 0130 00", "card 3782 822463 10006 777", "DE89" * 2000, "1 " * 9000])
def test_no_numbers(text):
    assert [s for s in pii.find(text) if s.kind in ("iban", "shortcard")] == []


def test_empty_tables_and_names_with_dots(spark, docs):
    table = docs([(1, "one two three"), (2, None)])
    assert pii.digest(pii.spans(table.where("false"))).collect() == []
    benchmark = spark.createDataFrame([(None, "one two three"), (None, "four"), ("q", "x y")], "`item.id` string, `the.text` string")
    dotted = table.withColumnRenamed("text", "the.text").withColumnRenamed("row", "a.b")
    clean = decontam.clean(dotted, benchmark, "the.text", "item.id")
    assert clean.columns == dotted.columns and [r["doc_id"] for r in clean.collect()] == [2]
    parts = decontam.clean(dotted, benchmark, "the.text", "item.id", block_bytes=4)
    assert [r["doc_id"] for r in parts.collect()] == [2]
    assert decontam.clean(table, benchmark.where("false").toDF("item_id", "text")).count() == 2
