"""SimHash near-duplicates: 64-bit fingerprints, linked at ``RADIUS`` or fewer differing
bits, pairs found with tables of distances to pivots.

Fingerprints that differ in at most two bits agree in two of four 16-bit quarters, so
each fingerprint is dealt to six groups, one for each pair of quarters. Inside a group
the table of Hamming distances to ``PIVOTS`` reference fingerprints is computed; a pair
whose distances to any one pivot differ by more than the radius cannot be linked and is
discarded, the survivors are compared. A group gives a spanning forest of its links, not
its pairs.

A group of more than ``limit`` different fingerprints is not compared in one task. Its
members go by an exact way of their own that scales with the number of members:
fingerprints within two bits share one of the 65 values at one bit or less from each, so
members are grouped by these values and linked to the smallest in the group (a value has
65 members at most).

Fingerprints, not documents, are linked; copies never meet in a group. Components are
found by alternating stars on the links, in rounds cut by checkpoints.

Near copies by the similarity of their shingles, which two bits of 64 reach few of, are in
``near_copies``.

Defined cases: NULL texts and texts without words have fingerprint 0; fewer words than a
shingle has are one shingle; texts of any length are hashed whole; a NULL id belongs to a
component but never names it unless all ids are NULL; repeated rows are documents like others;
ties of the name go to the smallest id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm import frames
from spendscope.llm.stars import connected

RADIUS = 2
PIVOTS = 16
SEED = 42


def shingles(text: bytes | None, size: int = 3) -> list[bytes]:
    words = text.lower().split() if text else []
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]


def fingerprint(text: bytes | None) -> int:
    """A bit is set where it is set in more than half of the shingles' hashes."""
    found = shingles(text)
    if not found:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), 1 << 16):
        part = found[at:at + (1 << 16)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), dtype="<u8", count=len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(found), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``fp`` (the fingerprint as signed long) of every row."""

    def work():
        def step(ids, texts):
            values = np.array([fingerprint(t) for t in frames.utf8(texts)], dtype=np.uint64)
            return {key: ids, "fp": values.view(np.int64)}
        return step

    kind = docs.schema[key].dataType.simpleString()
    return frames.per_document(docs, [key, text], f"{key} {kind}, fp long", work)


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(20240101).integers(0, 1 << 64, size=n, dtype=np.uint64)


def forest(members: np.ndarray, references: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links between the fingerprints of one group."""
    table = np.bitwise_count(members[:, None] ^ references[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    members, table = members[order], table[order]
    ends = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    parent = list(range(len(members)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(len(members) - 1):
        near = slice(i + 1, ends[i])
        apart = np.abs(table[near] - table[i]).max(axis=1, initial=0)
        alive = i + 1 + np.flatnonzero(apart <= radius)
        for j in alive[np.bitwise_count(members[alive] ^ members[i]) <= radius].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                links.append((i, j))
    return [(members[i], members[j]) for i, j in links]


def links(distinct: DataFrame, limit: int = 2048) -> DataFrame:
    """Links ``u``, ``v`` between the fingerprints of ``distinct`` (column ``fp``, no value
    twice) that connect all that are within ``RADIUS`` bits, by way of others or directly."""
    quarters = [F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF)) for q in range(4)]
    keys = F.array(*[
        (F.lit(i) * F.lit(1 << 32)).bitwiseOR(F.shiftleft(quarters[a], 16)).bitwiseOR(quarters[b])
        for i, (a, b) in enumerate(combinations(range(4), 2))])
    dealt = distinct.select("fp", F.explode(keys).alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = frames.checkpointed(sizes)
    small = dealt.join(sizes.where(F.col("n") <= limit).select("key"), "key").groupBy("key").agg(F.collect_list("fp").alias("fps"))
    hot = dealt.join(sizes.where(F.col("n") > limit).select("key"), "key").select("fp").distinct()

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = pivots()
        for batch in incoming:
            groups = batch.column(0)
            values = groups.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(groups.value_lengths().to_numpy(zero_copy_only=False))
            found = [pair for a, b in zip([0, *ends[:-1]], ends) for pair in forest(values[a:b], references)]
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    compared = small.select("fps").mapInArrow(run, "u long, v long")
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)])
    halfway = hot.select("fp", F.explode(near).alias("middle"))
    smallest = halfway.groupBy("middle").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    starred = halfway.join(smallest, "middle").where("fp != v").select(F.col("fp").alias("u"), "v").distinct()
    return compared.unionByName(starred)


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", limit: int = 2048) -> DataFrame:
    """``key``, ``fp`` and ``component_id``, the smallest key reachable, of every row."""
    prints = frames.checkpointed(fingerprints(docs, text, key))
    classes = prints.groupBy("fp").agg(F.min(key).alias("first"))
    linked = connected(links(classes.select("fp"), limit)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.select("fp", "root").join(named, "root")
    return prints.join(by_print, "fp").select(key, "fp", "component_id")
