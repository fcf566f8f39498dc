"""Near copies among texts: Jaccard similarity of 0.8 or more on sets of 5-word shingles.

Sets, not documents, are compared; equal sets are one.

1. A set is dealt to 40 groups by keys of five minimal hashes each; two sets at 0.8 share no
   group with a probability of (1 - 0.8 ** 5) ** 40 = 1.3e-7, less at more.
2. A group gives a spanning forest of its pairs with SimHash fingerprints of 256 bits within
   ``REACH`` bits, found by a table of distances to pivots. Pivots are fingerprints of the
   group, each the farthest from those before, so that members of other kinds differ from
   them by other distances: a pair whose distances to any one pivot differ by more than the
   reach is discarded, the survivors are compared. (Sets at 0.8 differ in about 39 bits, 48
   for the shortest, with a deviation of 6; unrelated ones in 128 with a deviation of 8.)
   Groups beyond ``limit`` link each member to the smallest instead.
3. Components of these links are clusters; no pair at 0.8 lies across two of them. They say
   only what must be verified. Each set of a cluster travels once, as hashes, to a block of
   about ``limit`` sets and ``HASHES`` hashes. In a block pairs that the pivots do not discard
   and that are not connected yet are verified by the exact similarity of the sets, and
   a block gives a spanning forest of what it verified, never its pairs.
4. Clusters of several blocks go on: sets outside of the component that holds most of the
   cluster visit all its blocks, dealt to cells of ``limit`` visitors, after a few members of
   each component have done so, which joins the main components of the blocks.

Texts are read again for the sets of clusters only: their keys are told apart by a bit table
of at most 8 MB, and what passes it wrongly is dropped by a join.

Defined cases: NULL texts and texts without words have equal sets; fewer words than a shingle
has are one shingle; a NULL key belongs to a component but never names it unless all keys
are NULL; repeated rows are documents like others; texts of any length are compared whole;
an empty table gives none; ties of the kept document go to the smallest key; all columns,
whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spendscope.llm import frames
from spendscope.llm.simhash import SEED, shingles
from spendscope.llm.stars import connected

#: words of a shingle, similarity as a fraction, 64-bit words of a fingerprint, bits that
#: near copies differ in at most, keys of a set, minima of a key
WORDS = 5
SIMILARITY = (4, 5)
WIDE = 4
REACH = 80
BANDS = 40
ROWS = 5
PIVOTS = 8
LIMIT = 2048
HASHES = 4 << 20
TABLE_BITS = 1 << 26


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors: one for each word of a wide fingerprint, one for each minimum of the bands."""
    odd = np.random.default_rng(20240202).integers(0, 1 << 64, size=WIDE + BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    return odd[:WIDE], odd[WIDE:]


def shingle_hashes(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """The set of the text's shingles, as sorted 64-bit hashes."""
    found = shingles(text, size)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), dtype=np.uint64, count=len(found)))


def set_id(hashes: np.ndarray) -> int:
    """One value for equal sets of shingles, as signed long; 0 for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64)) if len(hashes) else 0


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WIDE`` words of 64 bits; a bit is set where it is set in more than half of the hashes."""
    words, _ = _multipliers()
    counts = np.zeros(64 * WIDE, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 13):
        mixed = hashes[at:at + (1 << 13), None] * words
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def bands(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys, each of ``ROWS`` minimal hashes; none for the empty set."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    _, factors = _multipliers()
    least = np.full(len(factors), (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (factors[:, None] * hashes[None, at:at + 512]).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def sketches(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``key``, ``fp`` (the ``set_id``), ``size`` (of the set), ``wide`` and ``bands`` of every row."""
    frame = docs.select(F.col(frames.quoted(key)).alias("key"), F.col(frames.quoted(text)).alias("text"))

    def work():
        def step(keys, texts):
            sets = [shingle_hashes(t) for t in frames.utf8(texts)]
            return {"key": keys, "fp": [set_id(s) for s in sets], "size": [len(s) for s in sets],
                    "wide": [wide_fingerprint(s).view(np.int64) for s in sets], "bands": [bands(s) for s in sets]}
        return step

    kind = frame.schema["key"].dataType.simpleString()
    return frames.per_document(frame, ["key", "text"], f"key {kind}, fp long, size long, wide array<long>, bands array<long>", work)


def pivot_table(prints: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Hamming distances of the fingerprints (rows) to pivots among them: the first, then
    always the one farthest from all pivots so far."""
    columns, at = [], 0
    while len(columns) < min(most, len(prints)):
        columns.append(np.bitwise_count(prints ^ prints[at]).sum(axis=1, dtype=np.int16))
        nearest = np.min(columns, axis=0)
        at = int(nearest.argmax())
        if not nearest[at]:
            break
    return np.stack(columns, axis=1)


def survivors(prints: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each place with the places behind it in order of the first pivot's distances, and which
    of them no pivot discards."""
    table = pivot_table(prints)
    order = np.argsort(table[:, 0], kind="stable")
    ends = np.searchsorted(table[order, 0], table[order, 0] + REACH, side="right")
    for at, i in enumerate(order.tolist()):
        near = order[at + 1:ends[at]]
        if len(near):
            yield i, near, np.abs(table[near] - table[i]).max(axis=1) <= REACH


def _join(labels: np.ndarray, i: int, found: np.ndarray) -> list[tuple[int, int]]:
    """Gives the components of ``found`` the label of ``i``; a link for each."""
    others, first = np.unique(labels[found], return_index=True)
    out = [(i, int(found[f])) for o, f in zip(others.tolist(), first.tolist()) if o != labels[i]]
    if out:
        labels[np.isin(labels, others)] = labels[i]
    return out


def loose_forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of fingerprints within ``REACH`` bits."""
    labels, out = np.arange(len(prints)), []
    for i, near, alive in survivors(prints):
        near = near[alive & (labels[near] != labels[i])]
        near = near[np.bitwise_count(prints[near] ^ prints[i]).sum(axis=1) <= REACH]
        out += _join(labels, i, near)
    return out


class Overlaps:
    """The sizes of intersections of sets of hashes, by postings of each hash."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        self.ends = np.cumsum([0, *map(len, sets)])
        _, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        owners = np.repeat(np.arange(self.n), np.diff(self.ends))
        self.holders = owners[np.argsort(self.codes, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.codes))])

    def __call__(self, i: int) -> np.ndarray:
        """With the set ``i``, of every set."""
        own = self.codes[self.ends[i]:self.ends[i + 1]]
        counts = self.starts[own + 1] - self.starts[own]
        places = np.repeat(self.starts[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.bincount(self.holders[places], minlength=self.n)


def verified_forest(prints: np.ndarray, sets: list[np.ndarray], labels: np.ndarray,
                    visiting: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets with a similarity of ``SIMILARITY`` or more that connect all such of
    different labels; with ``visiting`` only those between a visitor and one that is none."""
    up, down = SIMILARITY
    sizes, labels, overlaps, out = np.array([len(s) for s in sets]), labels.copy(), None, []
    for i, near, alive in survivors(prints):
        alive &= labels[near] != labels[i]
        if visiting is not None:
            alive &= visiting[near] != visiting[i]
        alive &= down * np.minimum(sizes[near], sizes[i]) >= up * np.maximum(sizes[near], sizes[i])
        near = near[alive]
        near = near[np.bitwise_count(prints[near] ^ prints[i]).sum(axis=1) <= REACH]
        if not len(near):
            continue
        if len(sets) > 8:
            overlaps = overlaps or Overlaps(sets)
            common = overlaps(i)[near]
        else:
            common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in near.tolist()])
        out += _join(labels, i, near[down * common >= up * (sizes[i] + sizes[near] - common)])
    return out


def _clusters(classes: DataFrame, limit: int) -> DataFrame:
    """``fp`` and ``cluster`` of the sets that may be near copies of others."""
    dealt = classes.select("fp", F.explode("bands").alias("band"))
    sizes = dealt.groupBy("band").agg(F.count("*").alias("n"), F.min("fp").alias("centre")).where("n > 1")
    members = frames.checkpointed(dealt.join(frames.checkpointed(sizes), "band"))
    small = (
        members.where(F.col("n") <= limit).select("band", "fp").join(classes.select("fp", "wide"), "fp")
        .groupBy("band").agg(F.collect_list(F.struct("fp", "wide")).alias("m"))
        .select("m.fp", F.flatten("m.wide").alias("wide")))

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            ids, prints = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in range(2))
            prints = prints.view(np.uint64).reshape(-1, WIDE)
            ends = np.cumsum(batch.column(0).value_lengths().to_numpy(zero_copy_only=False))
            pairs = [(ids[a + i], ids[a + j]) for a, b in zip([0, *ends[:-1]], ends) for i, j in loose_forest(prints[a:b])]
            pairs = np.array(pairs, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    hot = members.where((F.col("n") > limit) & (F.col("fp") != F.col("centre"))).select(
        F.col("fp").alias("u"), F.col("centre").alias("v"))
    found = connected(small.mapInArrow(run, "u long, v long").unionByName(hot))
    found = found.select(F.col("node").alias("fp"), F.col("root").alias("cluster"))
    return frames.checkpointed(found.unionByName(found.select(F.col("cluster").alias("fp"), "cluster").distinct()))


def _bit_table(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A table of bits, two set for each hash of ``keys``, and its size: 16 bits a key, ``TABLE_BITS``
    at most (with more keys more pass wrongly)."""
    bits = min(TABLE_BITS, max(1 << 10, 1 << (16 * keys.count()).bit_length()))
    places = keys.select(F.explode(F.array(F.pmod("h", F.lit(bits)), F.pmod(F.shiftright("h", 32), F.lit(bits)))).alias("p"))
    words = places.groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS INT)))").alias("bits"))
    table = np.zeros(bits // 64, dtype=np.int64)
    found = words.toArrow()
    table[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return table, bits


def _sets(docs: DataFrame, placed: DataFrame, text: str, key: str) -> DataFrame:
    """``placed`` (with ``fp`` and ``first``, the key of a document that has the set) with ``hashes``.
    A set comes once for each row with that key and text."""
    frame = docs.select(F.col(frames.quoted(key)).alias("key"), F.col(frames.quoted(text)).alias("text"))
    frame = frame.select("key", "text", F.xxhash64("key").alias("h"))
    table, bits = _bit_table(placed.select(F.xxhash64("first").alias("h")))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kind = frame.schema["key"].dataType.simpleString()
    schema = f"key {kind}, own long, hashes array<long>"
    made = frames.arrow(schema)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def steps() -> Iterator[dict[str, object]]:
            for batch in incoming:
                h = batch.column("h").to_numpy(zero_copy_only=False)
                known = np.ones(len(h), dtype=bool)
                for p in (h % bits, (h >> 32) % bits):
                    known &= (shared.value[p // 64] >> (p % 64)) & 1 == 1
                some = batch.filter(pa.array(known))
                # few sets at a time: those of long texts are large
                for at in range(0, some.num_rows, 64):
                    part = some.slice(at, 64)
                    sets = [shingle_hashes(t) for t in frames.utf8(part.column("text"))]
                    yield {"key": part.column("key"), "own": [set_id(s) for s in sets], "hashes": [s.view(np.int64) for s in sets]}
        yield from frames.batches(steps(), made)

    found = frame.mapInArrow(run, schema)
    same = (F.col("own") == F.col("fp")) & F.col("key").eqNullSafe(F.col("first"))
    return found.join(placed, same).drop("key", "own", "first")


def _cells(cells: DataFrame, columns: str, work) -> DataFrame:
    """Pairs of sets that ``work(sets' ids, roots, fingerprints, hashes, visiting)`` gives for each cell: rows of
    ``cluster``, ``block``, ``chunk``, ``fp``, ``root``, ``wide``, ``hashes`` and ``visiting``."""
    made = frames.arrow(columns)

    def step(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        fps, first = np.unique(rows.column("fp").to_numpy(), return_index=True)
        taken = rows.take(pa.array(first)).combine_chunks()
        prints = np.stack([x.values.to_numpy() for x in taken.column("wide")]).view(np.uint64)
        sets = [x.values.to_numpy().view(np.uint64) for x in taken.column("hashes")]
        visiting = taken.column("visiting").to_numpy(zero_copy_only=False).astype(bool)
        pairs = np.array(work(fps, taken.column("root").to_numpy(), prints, sets, visiting), dtype=np.int64)
        return pa.Table.from_arrays([pa.array(column) for column in pairs.reshape(-1, 2).T], schema=made)

    return cells.groupBy("cluster", "block", "chunk").applyInArrow(step, columns)


def _stars(blocks: DataFrame) -> DataFrame:
    """``fp`` and ``root``, the smallest set it is connected to, for the sets of each block that are
    connected to a smaller one."""

    def work(fps, roots, prints, sets, visiting) -> list[tuple[int, int]]:
        parent = np.arange(len(fps))
        for i, j in verified_forest(prints, sets, parent):
            low, high = sorted((parent[i], parent[j]))
            parent[parent == high] = low
        # ids are sorted: the smallest place is the smallest id
        return [(fps[i], fps[p]) for i, p in enumerate(parent.tolist()) if i != p]

    return _cells(blocks, "fp long, root long", work)


def _root_links(cells: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` between the roots of visitors and of sets at home."""

    def work(fps, roots, prints, sets, visiting) -> list[tuple[int, int]]:
        labels = np.unique(roots, return_inverse=True)[1]
        return [(roots[i], roots[j]) for i, j in verified_forest(prints, sets, labels, visiting)]

    return _cells(cells, "u long, v long", work)


def _with_roots(fps: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows with ``root``; a set that ``roots`` doesn't have is its own."""
    return fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_components(docs: DataFrame, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """``key``, ``fp`` (set id), ``root`` and ``component_id`` of every row, linked at ``SIMILARITY`` of
    the sets of ``WORDS``-word shingles."""
    made = frames.stored(sketches(docs, text, key))
    classes = frames.stored(made.groupBy("fp").agg(
        F.min("key").alias("first"), F.first("size").alias("size"), F.first("wide").alias("wide"), F.first("bands").alias("bands")))
    clustered = _clusters(classes, limit)
    sizes = clustered.join(classes.select("fp", "size"), "fp").groupBy("cluster").agg(
        F.expr(f"CAST(ceil(greatest(count(*) / {limit}, sum(size) / {HASHES})) AS INT)").alias("blocks"))
    placed = clustered.join(sizes, "cluster").join(classes.select("fp", "first", "wide"), "fp").withColumn(
        "block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    sets = frames.stored(_sets(docs, placed, text, key))
    roots = frames.checkpointed(_stars(sets.select(
        "cluster", "block", F.lit(0).alias("chunk"), "fp", F.col("fp").alias("root"), "wide", "hashes", F.lit(False).alias("visiting"))))
    several = sets.where("blocks > 1")
    if not several.isEmpty():
        roots = _across(several, roots, limit)
    named = _with_roots(classes.select("fp", "first"), roots)
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return made.select("key", "fp").join(named.select("fp", "root").join(names, "root"), "fp").select("key", "fp", "root", "component_id")


def _across(sets: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """``fp`` and ``root`` with the links between blocks of a cluster. ``roots`` are those inside of blocks."""
    inside = frames.checkpointed(_with_roots(sets.select("cluster", "block", "blocks", "fp").distinct(), roots))
    first = frames.checkpointed(_root_links(_visits(sets, inside, 8, limit)))
    # one step of the links is enough to see what belongs together for the most part
    both = first.unionByName(first.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("root")).agg(F.min("v").alias("least"))
    joined = frames.checkpointed(inside.join(least, "root", "left").withColumn("root", F.least("root", "least")).drop("least"))
    links = first.unionByName(_root_links(_visits(sets, joined, None, limit)))
    top = connected(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    every = roots.unionByName(inside.where("fp = root").select("fp", "root"))
    return frames.checkpointed(every.join(top, "root", "left").select("fp", F.coalesce("top", "root").alias("root")))


def _visits(sets: DataFrame, rooted: DataFrame, few: int | None, limit: int) -> DataFrame:
    """Cells in which sets of several blocks meet those of other blocks: ``few`` sets of each
    component, or all but those of the cluster's largest component, visit all blocks but their own."""
    if few:
        # the sets with the smallest of several hashes, by partial aggregates: a component may be large
        some = F.array(*[F.min_by("fp", F.xxhash64(F.lit(i), "fp")) for i in range(few)])
        going = rooted.groupBy("cluster", "root").agg(some.alias("some")).select(
            "cluster", "root", F.explode(F.array_distinct("some")).alias("fp"))
    else:
        counts = rooted.groupBy("cluster", "root").agg(F.count("*").alias("n"))
        main = counts.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
        going = rooted.join(main, "cluster").where("root != main").select("cluster", "root", "fp")
    going = frames.checkpointed(going)
    chunks = going.groupBy("cluster").agg(F.expr(f"CAST(ceil(count(*) / {limit}) AS INT)").alias("chunks"))
    known = sets.drop("block", "blocks").join(rooted.select("fp", "root", "block", "blocks"), "fp")
    home = known.join(chunks, "cluster").select(
        "cluster", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "fp", "root", "wide", "hashes",
        F.lit(False).alias("visiting"))
    visits = known.join(going.select("fp"), "fp", "left_semi").join(chunks, "cluster").select(
        "cluster", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block"))).alias("block"),
        F.pmod(F.xxhash64("fp"), "chunks").cast("int").alias("chunk"), "fp", "root", "wide", "hashes", F.lit(True).alias("visiting"))
    return home.unionByName(visits)


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """One document of each group of near copies (see above), all columns: the one with
    the smallest key.

    Where rows repeat a key, or a component has NULL keys only, one of the rows with the
    smallest key is kept for each component. Such rows are few; the texts of all others
    are only filtered by key.
    """
    found = frames.checkpointed(near_components(docs, text, key, limit))
    own, mark, other = frames.unused(docs, "_own", "_fp", "_other")
    name = frames.quoted(key)
    stay = found.where(F.col("key").eqNullSafe(F.col("component_id")))
    counted = frames.checkpointed(
        stay.groupBy(F.col("key").alias(own)).agg(F.count("*").alias("n"), F.collect_set(F.struct("fp", "root")).alias("prints")))
    single = counted.where(F.col(own).isNotNull() & (F.col("n") == 1)).select(own)
    rows = docs.join(single, F.col(name) == F.col(own), "left_semi")
    several = counted.where(F.col(own).isNull() | (F.col("n") > 1))
    if several.isEmpty():
        return rows
    again = docs.join(several.select(own), F.col(name).eqNullSafe(F.col(own)), "left_semi")
    roots = several.select(own, F.explode("prints").alias("p")).select(own, F.struct("p.fp", "p.root").alias(other))
    marked = _with_set(again, text, mark).join(
        roots, F.col(name).eqNullSafe(F.col(own)) & (F.col(mark) == F.col(other)["fp"]))
    kept = marked.withColumn(mark, F.col(other)["root"]).dropDuplicates([own, mark]).select(*map(frames.quoted, docs.columns))
    return rows.unionByName(kept)


def _with_set(docs: DataFrame, text: str, name: str) -> DataFrame:
    """All columns, and the ``set_id`` as ``name``."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            values = [set_id(shingle_hashes(t)) for t in frames.utf8(batch.column(text))]
            yield batch.append_column(name, pa.array(values, type=pa.int64()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))
