"""The training-order query gives what its shards hold."""

import zlib
from pathlib import Path
from urllib.parse import urlparse

import numpy as np

from spendscope.llm import frames, queries, training_order

SF = "/root/testdata/sf0.01"


def test_query_writes_shards_and_reads_them_back(spark, monkeypatch):
    paths, write = [], training_order.write
    monkeypatch.setattr(training_order, "write", lambda rows, path: (paths.append(path), write(rows, path)))
    found = queries.op7_training_order(spark, SF).collect()
    (path,) = paths
    # the files themselves, record by record
    plain, stride = {}, 2 * 2048 + 1
    for file in Path(urlparse(path).path).glob("shard=*/part-*"):
        body, shard = file.read_bytes(), int(file.parent.name.split("=")[1])
        for at in range(0, len(body), stride):
            plain[shard * 4096 + at // stride] = zlib.crc32(body[at:at + stride - 1])
    assert {r["slot"]: r["payload_crc32"] for r in found} == plain and sorted(plain) == list(range(len(found)))
    slots = training_order.permuted(np.arange(len(found)), len(found), queries.ORDER_KEY)
    assert all(slots[r["index"]] == r["slot"] and (r["shard"], r["record"]) == divmod(r["slot"], 4096) for r in found)
    ids = {r["doc_id"] for r in frames.read(spark, SF, "documents").select("doc_id").collect()}
    assert {r["first_doc_id"] for r in found} <= ids and all(0 < r["n_tokens"] <= 2048 for r in found)


def test_payloads_are_digested_before_the_join(spark, tmp_path):
    docs = frames.read(spark, "/root/testdata/sf0.001", "documents")
    rows = training_order.numbered(docs, queries.tokenizer_path(), "key", 64, 32)
    found = training_order.materialised(rows, str(tmp_path / "out"), 64, shard_rows=32)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("crc32(")
    made = {r["slot"]: (r["index"], r["n_tokens"], zlib.crc32(r["payload"])) for r in rows.collect()}
    assert {r["slot"]: (r["index"], r["n_tokens"], r["payload_crc32"]) for r in found.collect()} == made
    nothing = training_order.numbered(docs.where("false"), queries.tokenizer_path(), "key")
    empty = training_order.materialised(nothing, str(tmp_path / "none"))
    assert empty.columns == found.columns and empty.collect() == []
