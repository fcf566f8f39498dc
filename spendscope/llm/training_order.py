"""Training-order materialisation: fixed-length token sequences, a keyed Feistel permutation
that gives each a global slot, and shards of fixed stride written by slot ranges.

Documents, each followed by the end token, are cut into sequences of ``length`` tokens
within a task; a task's last sequence is padded with ``pad``. The sequences are written
once, numbered without gaps, and their number n is the domain of the permutation: a
Feistel network over the smallest even number of bits that holds n, walked along its
cycle until the value is below n. Slots are therefore a permutation of 0 .. n-1 that
anyone who has the key can compute for any sequence, or invert.

Sequences are range-partitioned and sorted by slot. A shard is ``shard_rows`` successive
slots; each is one file of records of equal length, so slot s is record
``s % shard_rows`` of shard ``s // shard_rows``. A reader that resumes at a slot opens its shard
and those behind it, and no others. Records are little-endian ids of 2 bytes (4 if ids need
them) and a newline byte, written by Spark's text sink, which commits a task's files as a
whole.

Defined cases: a NULL or empty text has the end token only; a very long text is cut into
as many sequences as it fills; an empty table has no sequences; repeated rows are tokens
like others; a NULL id stays NULL; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendscope.llm import frames
from spendscope.llm.tokens import encoder

ROUNDS = 6


def round_keys(key: str, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") for r in range(rounds)]


def _mixed(half: np.ndarray, key: int) -> np.ndarray:
    """The round function: two rounds of multiply and shift on 64 bits."""
    x = (half ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, n: int, key: str, inverse: bool = False) -> np.ndarray:
    """The slots of indices below ``n``; with ``inverse`` the indices of slots."""
    half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = round_keys(key)
    out = np.array(index, dtype=np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & mask
        if inverse:
            for k in reversed(keys):
                left, right = right ^ (_mixed(left, k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (_mixed(right, k) & mask)
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer: str, length: int = 2048, text: str = "text", key: str = "doc_id",
              end_token: int = 1, pad: int = 0, wide: bool = False) -> DataFrame:
    """``part`` and ``at`` (task and place in it), ``first_id`` (key of the document of the
    first token), ``n_tokens`` without padding, ``payload`` (the record's ids)."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"part int, at long, first_id {kind}, n_tokens int, payload binary"
    dtype = np.dtype("<u4" if wide else "<u2")
    made = frames.arrow(schema)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        parts: list[tuple[object, np.ndarray]] = []
        size = 0

        def cut(last: bool) -> dict[str, list]:
            nonlocal parts, size, at
            stream = np.concatenate([x for _, x in parts]) if parts else np.empty(0, dtype=dtype)
            ends = np.cumsum([len(x) for _, x in parts])
            n = -(-size // length) if last else size // length
            used = min(size, n * length)
            firsts = np.searchsorted(ends, np.arange(n) * length, side="right")
            full = np.concatenate([stream[:used], np.full(n * length - used, pad, dtype=dtype)]).reshape(n, length)
            columns = {"part": [part] * n, "at": list(range(at, at + n)), "first_id": [parts[i][0] for i in firsts],
                       "n_tokens": [min(length, used - i * length) for i in range(n)],
                       "payload": [row.tobytes() for row in full]}
            left = parts[int(np.searchsorted(ends, used, side="right"))][0] if used < size else None
            parts = [(left, stream[used:])] if used < size else []
            size -= used
            at += n
            return columns

        def cuts():
            nonlocal size
            for batch in incoming:
                for own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = np.append(tokens.encode(value), np.array([end_token], dtype="<u4"))
                    if not wide and ids.max() > 0xFFFF:
                        raise ValueError("ids need 4 bytes: pass wide=True")
                    parts.append((own, ids.astype(dtype)))
                    size += len(ids)
                    if size >= 500 * length:
                        yield cut(False)
            if size:
                yield cut(True)

        yield from frames.batches(cuts(), made)

    return docs.select(key, text).mapInArrow(run, schema)


def numbered(docs: DataFrame, tokenizer: str, order_key: str, length: int = 2048, shard_rows: int = 4096,
             text: str = "text", key: str = "doc_id", end_token: int = 1, pad: int = 0, wide: bool = False) -> DataFrame:
    """The sequences with their places: ``slot``, ``shard``, ``record`` (place in the shard), ``index``
    (place before permuting), ``first_id``, ``n_tokens``, ``payload``.

    The sequences are stored once; reading places without payloads reads no payloads. The
    table of task offsets that is broadcast has one row for each task of the first pass.
    """
    made = frames.stored(sequences(docs, tokenizer, length, text, key, end_token, pad, wide), level=6)
    counts = made.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = frames.checkpointed(counts.select(F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("_before"), "n"))
    n = offsets.agg(F.sum("n")).first()[0] or 0

    @F.pandas_udf("long")
    def slot(index):
        return pd.Series(permuted(index.to_numpy(), n, order_key))

    indexed = made.join(F.broadcast(offsets.drop("n")), made["part"] == F.col("_part")).withColumn(
        "index", F.col("at") + F.col("_before"))
    return indexed.withColumn("slot", slot("index")).select(
        "slot", F.expr(f"slot div {shard_rows}").alias("shard"), (F.col("slot") % shard_rows).alias("record"),
        "index", "first_id", "n_tokens", "payload")


def _payloads(rows: DataFrame, change: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    """The rows with changed payloads, in the partitions and the order they have."""
    at = rows.columns.index("payload")

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changed = change()
        for batch in incoming:
            values = [changed(p) for p in batch.column(at).to_pylist()]
            yield batch.set_column(at, "payload", pa.array(values, type=batch.schema.field(at).type))

    return rows.mapInArrow(run, rows.schema)


def in_order(rows: DataFrame) -> DataFrame:
    """``numbered`` rows partitioned by ranges of shards and sorted by slot. A partition has
    about half a shard while there are few, and 64 shards at most. Payloads travel compressed."""
    shards = (rows.agg(F.max("shard")).first()[0] or 0) + 1
    parts = max(min(2 * shards, 4000), -(-shards // 64))
    packed = _payloads(rows, lambda: zstandard.ZstdCompressor(level=3).compress)
    return _payloads(packed.repartitionByRange(parts, "shard").sortWithinPartitions("shard", "slot"),
                     lambda: zstandard.ZstdDecompressor().decompress)


def ordered(docs: DataFrame, tokenizer: str, order_key: str, length: int = 2048, shard_rows: int = 4096,
            text: str = "text", key: str = "doc_id", end_token: int = 1, pad: int = 0, wide: bool = False) -> DataFrame:
    """The ``numbered`` sequences in training order."""
    return in_order(numbered(docs, tokenizer, order_key, length, shard_rows, text, key, end_token, pad, wide))


def write(rows: DataFrame, path: str) -> None:
    """One file for each shard, in folders ``shard=N``: records of equal length by slot."""
    rows.select("shard", F.col("payload").cast("string").alias("record")).write.partitionBy("shard").text(path, lineSep="\n")


def read(spark: SparkSession, path: str, length: int = 2048, wide: bool = False, from_slot: int = 0,
         shard_rows: int = 4096) -> DataFrame:
    """``slot`` and ``payload`` of the written sequences from ``from_slot`` on; shards before
    it are not opened."""
    stride = length * (4 if wide else 2) + 1
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
        .where(F.col("shard") >= from_slot // shard_rows)
    )
    record = F.explode(F.sequence(F.lit(0), F.expr(f"CAST(length div {stride} AS INT)") - 1)).alias("record")
    return (
        files.select("shard", "content", record)
        .select((F.col("shard").cast("long") * shard_rows + F.col("record")).alias("slot"),
                F.expr(f"substring(content, record * {stride} + 1, {stride - 1})").alias("payload"))
        .where(F.col("slot") >= from_slot)
    )


def materialised(rows: DataFrame, path: str, length: int = 2048, wide: bool = False, shard_rows: int = 4096) -> DataFrame:
    """``numbered`` rows written to ``path`` in training order and read back: slot, shard, record and
    ``payload_crc32`` are those of the files, the other columns are joined by slot. A slot that
    only one side has stays, with NULLs. Payloads are digested where they are read."""
    places = rows.select("slot", "index", "first_id", "n_tokens")
    if places.isEmpty():
        return places.select("slot", "slot", "slot", "index", "first_id", "n_tokens", "slot").toDF(
            "slot", "shard", "record", "index", "first_id", "n_tokens", "payload_crc32")
    write(in_order(rows), path)
    found = read(rows.sparkSession, path, length, wide, shard_rows=shard_rows).select(
        "slot", F.crc32("payload").alias("payload_crc32"))
    return found.join(places, "slot", "full").select(
        "slot", F.expr(f"slot div {shard_rows}").alias("shard"), (F.col("slot") % shard_rows).alias("record"),
        "index", "first_id", "n_tokens", "payload_crc32")
