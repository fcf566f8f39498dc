"""Hierarchical packing: documents are routed to context-size tiers, each tier is packed,
gaps of long windows are filled from shorter tiers, and step groups are balanced.

Each task takes its documents in blocks of about ``block_tokens`` tokens and packs a block
by itself, so there is no shuffle, memory is bounded by a block, and a lost task is done
again from its input alone. In a block:

1. A document longer than the longest window gives whole windows of it; what is left of it,
   and each shorter document, goes to the smallest tier that holds it.
2. From the longest tier down, items open windows of their tier, longest first; what a
   window has left is filled with the largest whole items that fit from shorter tiers.
   What is still left is filled with the head of the next item, which is cut there.
3. The last window may not fill. It is cut into windows of power-of-two sizes, which need
   no padding.
4. Windows go to step groups of equal tokens: longest first, each to the group with
   the fewest.

A window's size is a power of two up to ``window``. Without padding the padded size of a
window is its number of tokens.

Defined cases: a NULL or empty text has the end token only; a NULL id stays NULL; repeated
rows are packed as often as they occur (their pieces carry the same id, so ``row`` tells
them apart); an empty table gives no pieces; other columns are ignored. The result depends
on how rows are dealt to tasks, so the input should be files or a checkpoint, whose tasks
are the same when repeated.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from spendscope.llm import frames
from spendscope.llm.tokens import encoder

Piece = tuple[int, int, int]


def tier_of(length: int, window: int, tiers: int) -> int:
    """0 for the longest window, 1 for half of it, ...: the smallest that holds ``length``."""
    tier = 0
    while tier + 1 < tiers and length <= window >> (tier + 1):
        tier += 1
    return tier


class _Tier:
    """Items of a tier by length."""

    def __init__(self):
        self.items: list[tuple[int, int, int]] = []

    def add(self, length: int, doc: int, start: int) -> None:
        insort(self.items, (length, doc, start))

    def longest(self, most: int) -> tuple[int, int, int] | None:
        """Take the longest item of at most ``most`` tokens."""
        at = bisect_right(self.items, (most, 1 << 62, 0))
        return self.items.pop(at - 1) if at else None


def pack(lengths: list[int], window: int = 2048, tiers: int = 4) -> list[list[Piece]]:
    """Windows as lists of pieces (document, start, length). Every window is full or has a
    power-of-two size, and every token of every document is in one piece."""
    shelves = [_Tier() for _ in range(tiers)]
    full: list[list[Piece]] = []
    for doc, n in enumerate(lengths):
        whole = n // window * window
        full += [[(doc, start, window)] for start in range(0, whole, window)]
        if n > whole:
            shelves[tier_of(n - whole, window, tiers)].add(n - whole, doc, whole)
    open_window: list[Piece] = []
    for tier, shelf in enumerate(shelves):
        size = window >> tier
        while shelf.items:
            length, doc, start = shelf.items.pop()
            pieces, room = open_window, size - sum(p[2] for p in open_window)
            while True:
                take = min(length, room)
                pieces.append((doc, start, take))
                room -= take
                if take < length:
                    shelves[max(tier, tier_of(length - take, window, tiers))].add(length - take, doc, start + take)
                following = next((found for other in shelves[tier:] if room
                                  and (found := other.longest(room))), None)
                if following is None and room:
                    following = next((other.items.pop() for other in shelves[tier:] if other.items), None)
                if following is None:
                    break
                length, doc, start = following
            open_window = []
            if room:
                open_window = pieces
            else:
                full.append(pieces)
        if open_window and tier + 1 < tiers:
            # nothing shorter was left to fill it
            break
    return full + _powers(open_window)


def _powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces of an unfinished window as windows of power-of-two sizes."""
    left = sum(p[2] for p in pieces)
    out, queue = [], list(reversed(pieces))
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        own = []
        while size:
            doc, start, length = queue.pop()
            take = min(length, size)
            own.append((doc, start, take))
            size -= take
            if take < length:
                queue.append((doc, start + take, length - take))
        out.append(own)
    return out


def balanced(sizes: list[int], step_tokens: int) -> list[int]:
    """A step group for each window: ``ceil(tokens / step_tokens)`` groups, the longest
    window first, each to the group with the fewest tokens."""
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, group = heapq.heappop(groups)
        out[i] = group
        heapq.heappush(groups, (load + sizes[i], group))
    return out


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end_token: int = 1,
           window: int = 2048, tiers: int = 4, step_tokens: int = 65_536, block_tokens: int = 2_000_000,
           with_ids: bool = True) -> DataFrame:
    """One row per piece: ``key``, ``row`` (numbers the documents of the input), ``start``,
    ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``tier``,
    ``step_group`` and, if wanted, the token ``ids`` themselves.

    ``sequence_id`` is unique, with the task in its upper bits; ``tier`` is the size of
    the window. ``window`` is a power of two.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = (f"{key} {kind}, row long, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long, tier int, step_group long" + ", ids array<int>" * with_ids)

    made = frames.arrow(schema)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 33
        row, sequence, group = base, base, base
        keys, ids, size = [], [], 0

        def flush():
            nonlocal row, sequence, group
            windows = pack([len(x) for x in ids], window, tiers)
            sizes = [sum(p[2] for p in w) for w in windows]
            steps = balanced(sizes, step_tokens)
            columns = {name: [] for name in ("key", "row", "start", "length", "ids_crc32", "doc_tokens",
                                             "sequence_id", "offset", "tier", "step_group", "ids")}
            for w, total, step in zip(windows, sizes, steps):
                offset = 0
                for doc, start, length in w:
                    own = ids[doc][start:start + length]
                    values = (keys[doc], row + doc, start, length, zlib.crc32(own), len(ids[doc]), sequence, offset,
                              total, group + step)
                    for name, value in zip(columns, values):
                        columns[name].append(value)
                    if with_ids:
                        columns["ids"].append(own.astype(np.int32))
                    offset += length
                sequence += 1
            row += len(ids)
            group += max(steps, default=-1) + 1
            columns[key] = columns.pop("key")
            return columns

        def filled():
            nonlocal keys, ids, size
            for batch in incoming:
                for own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = tokens.encode(value)
                    keys.append(own)
                    ids.append(np.append(found, np.array([end_token], dtype="<u4")).astype("<u4"))
                    size += len(found) + 1
                    if size >= block_tokens:
                        yield flush()
                        keys, ids, size = [], [], 0
            if ids:
                yield flush()

        yield from frames.batches(filled(), made)

    return docs.select(key, text).mapInArrow(run, schema)


def padding(packed: DataFrame, window: int = 2048) -> DataFrame:
    """One row: sequences, tokens, and the tokens that padding adds (none to a window of a
    power-of-two size)."""
    from pyspark.sql import functions as F

    sizes = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.bit_count("n") == 1
    return sizes.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"),
                     F.sum(F.when(power, 0).otherwise(window - F.col("n"))).alias("padding"))
