"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of ASCII letters and digits and of any other character beyond ASCII, with
A-Z in lower case. The patterns are the windows of ``WINDOW`` consecutive words of the
benchmark items; an item with fewer words is one window. Patterns of one length are
searched together: a shift table over blocks of two adjacent words tells how far the
search may skip, blocks that end a pattern lead to a bucket of the patterns with that
suffix, and the words are compared directly. A document of n words takes about n / 12
steps where it shares nothing with the benchmark.

The benchmark is a stated set of queries: it is taken in blocks of bounded size, each
broadcast in turn and searched in all documents. Where there is more than one block, the
texts are read once a block, and only what is found is kept in between: one row for each
text that holds a passage, with the text's sha256, by which all rows of that text find it.
No text is stored or shuffled for this.

Defined cases: NULL texts have no words; an item or document without words has no hit;
a row of the benchmark with a NULL id marks words but is not listed; rows with one item
id are one item; repeated documents each give a row; a tie with the threshold
(``hit / words == share``) counts as contaminated; texts of any length are searched whole;
empty tables give no rows, or no hits; other columns, whatever their names, are ignored (``hits``)
or kept (``clean``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from spendscope.llm import frames

WINDOW = 13
_TABLE = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 32
               for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def windows(item: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The patterns of an item."""
    if not item:
        return []
    return list(dict.fromkeys(tuple(item[i:i + size]) for i in range(max(1, len(item) - size + 1))))


class Search:
    """The tables for patterns of one length ``m``."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list]):
        self.m, self.block = m, min(2, m)
        #: by the last word of a block, then by its first: how far the search may skip
        self.shift: dict[bytes, dict[bytes, int]] = {}
        #: by the block that ends a pattern: the patterns, with their items
        self.buckets: dict[tuple[bytes, bytes], dict[tuple[bytes, ...], list]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, m + 1):
                first, last = pattern[end - self.block], pattern[end - 1]
                row = self.shift.setdefault(last, {})
                row[first] = min(row.get(first, m), m - end)
            self.buckets.setdefault((pattern[-self.block], pattern[-1]), {})[pattern] = items

    def __call__(self, text: list[bytes]) -> Iterator[tuple[int, list]]:
        """Start and items of each occurrence."""
        m, shift, buckets, back, n = self.m, self.shift, self.buckets, self.block - 1, len(text)
        far, at, none = m - back, m - 1, {}
        while at < n:
            last, first = text[at], text[at - back]
            skip = shift.get(last, none).get(first, far)
            if skip:
                at += skip
                continue
            start = at - m + 1
            items = buckets[first, last].get(tuple(text[start:at + 1]))
            if items is not None:
                yield start, items
            at += 1


class Index:
    """The searches for a block of benchmark items."""

    def __init__(self, items: list[tuple[object, bytes | None]], size: int = WINDOW):
        by_length: dict[int, dict[tuple[bytes, ...], list]] = {}
        for item_id, text in items:
            for pattern in windows(words(text), size):
                by_length.setdefault(len(pattern), {}).setdefault(pattern, []).append(item_id)
        self.searches = [Search(m, patterns) for m, patterns in sorted(by_length.items())]

    def __call__(self, text: list[bytes]) -> tuple[list[int], set]:
        """Maximal runs of hit words as start, end, start, end, ..., and the items found."""
        cover, found = None, set()
        for search in self.searches:
            for start, items in search(text):
                if cover is None:
                    cover = np.zeros(len(text) + 2, dtype=np.int8)
                cover[start + 1:start + search.m + 1] = 1
                found.update(items)
        return ([] if cover is None else np.flatnonzero(np.diff(cover)).tolist()), found


def block_filters(benchmark: DataFrame, text: str = "text", item: str = "item_id", block_bytes: int = 16 << 20) -> list[DataFrame]:
    """The benchmark in blocks of whole rows, of about ``block_bytes`` of text each. Rows of one
    item, or without an item id, may be in different blocks."""
    total = benchmark.agg(F.sum(F.octet_length(F.col(frames.quoted(text))))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    rows = benchmark.select(F.col(frames.quoted(item)).alias("item"), F.col(frames.quoted(text)).cast("binary").alias("text"))
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) if n > 1 else rows for i in range(n)]


def joined(edges: list[int]) -> list[int]:
    """Runs (start, end, start, end, ...) in any order, joined where they overlap or touch."""
    out, depth = [], 0
    for x, kind in sorted([(x, -1) for x in edges[::2]] + [(x, 1) for x in edges[1::2]]):
        if (kind < 0 and depth == 0) or (kind > 0 and depth == 1):
            out.append(x)
        depth -= kind
    return out


def search(docs: DataFrame, carried: list[str], benchmark: DataFrame, text: str, item: str, size: int,
           block_bytes: int) -> DataFrame:
    """``row`` (a struct of the carried columns), ``n_words``, ``runs``, ``items`` of each row."""
    body = F.col(frames.quoted(text)).cast("binary").alias("text")
    frame = docs.select(F.struct(*[F.col(frames.quoted(c)) for c in carried]).alias("row"), body)
    row = StructField("row", frame.schema["row"].dataType)
    parts = block_filters(benchmark, text, item, block_bytes)
    if len(parts) == 1:
        found = StructType.fromDDL("n_words long, runs array<long>, items array<string>")
        return frame.mapInArrow(_searched(_shared(parts[0]), size), StructType([row, *found.fields]))
    found = reduce(DataFrame.union, [_found(docs.select(body), part, size) for part in parts])
    found = found.groupBy("print").agg(
        F.flatten(F.collect_list("runs")).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counted = frame.mapInArrow(_counted, StructType([row, *StructType.fromDDL("n_words long, print binary").fields]))
    return counted.join(found.mapInArrow(_joined, found.schema), "print", "left").select(
        "row", "n_words", *[F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("runs", "items")])


def _shared(block: DataFrame):
    return block.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in block.collect()])


def _index(shared, size: int) -> Index:
    return Index([(i, None if t is None else bytes(t)) for i, t in shared.value], size)


def _names(items: set) -> list[str]:
    return sorted({str(x) for x in items if x is not None})


def _searched(shared, size: int):
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared, size)
        for batch in incoming:
            n_words, runs, items = [], [], []
            for text in batch.column("text").to_pylist():
                found = words(text)
                own = index(found)
                n_words.append(len(found))
                runs.append(own[0])
                items.append(_names(own[1]))
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"), "n_words": pa.array(n_words, pa.int64()),
                "runs": pa.array(runs, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))})

    return run


def _found(texts: DataFrame, block: DataFrame, size: int) -> DataFrame:
    """``print``, ``runs`` and ``items`` of the distinct texts that hold passages of a block; stored."""
    made = "print binary, runs array<long>, items array<string>"
    shared, schema = _shared(block), frames.arrow(made)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared, size)
        for batch in incoming:
            out: dict[bytes, tuple[list, list]] = {}
            for text in batch.column("text").to_pylist():
                runs, items = index(words(text))
                if runs:
                    out[sha256(text).digest()] = runs, _names(items)
            runs, items = zip(*out.values()) if out else ((), ())
            yield from frames.batches([{"print": list(out), "runs": list(runs), "items": list(items)}], schema)

    out = frames.stored(texts.mapInArrow(run, made).dropDuplicates(["print"]))
    shared.unpersist()
    return out


def _counted(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        texts = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_pydict({
            "row": batch.column("row"), "n_words": pa.array([len(words(t)) for t in texts], pa.int64()),
            "print": pa.array([None if t is None else sha256(t).digest() for t in texts], pa.binary())})


def _joined(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        runs = pa.array([joined(r) for r in batch.column("runs").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_pydict({"print": batch.column("print"), "runs": runs, "items": batch.column("items")})


def _measured(found: DataFrame, parts: int) -> DataFrame:
    starts = F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2))
    none = F.lit(0).cast("long")
    n_hit = F.when(F.size("runs") > 0, F.aggregate(
        starts, none, lambda s, i: s + F.get("runs", i + 1) - F.get("runs", i))).otherwise(none)
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * parts >= F.col("n_words")))


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id",
         parts: int = 20, size: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """Per row: ``key``, ``n_words``, ``runs`` of hit words (start, end, start, end, ...),
    ``n_hit``, ``items`` found (sorted as text) and ``contaminated``: at least one word in
    ``parts`` is hit."""
    found = search(docs, [key], benchmark, text, item, size, block_bytes)
    return _measured(found, parts).select(F.col("row")[key].alias(key), "n_words", "runs", "n_hit", "items", "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", parts: int = 20,
          size: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    found = search(docs, docs.columns, benchmark, text, item, size, block_bytes)
    return _measured(found, parts).where(~F.col("contaminated")).select("row.*")
