"""Removal of repeated substrings by suffix sorting: every byte covered by a string of
``WIDTH`` bytes that also starts earlier (in a smaller key, or before in the same text).

Two equal strings of ``WIDTH`` bytes hold the same anchor at the same place: the smallest
hash of the ``GRAM``-byte grams in it. Only about one position in 35 is an anchor, so
anchors instead of all suffixes are exchanged, in five steps:

1. ``_anchors``: anchors of each batch, with a hash of their context (all bytes that a string
   around the anchor can reach). Of equal contexts in a batch the first is kept, the others
   are covered: all their strings start earlier too.
2. ``_classes``: anchors by their hash. A batch sends one row for an anchor hash, so a passage
   that a third of all texts share is no hot group. Of one context the first is kept; where
   the contexts of a hash differ, the first of each is refined.
3. ``_contexts``: contexts of the anchors to refine, cut out of the texts.
4. ``_sorted_windows``: the strings around these anchors, sorted deep-shallow: multikey
   sorting by two words of eight bytes to a shallow depth, then the groups that still tie are
   ordered by blind tries, built level by level for all groups at once: each member is
   compared with the first of its group, and the members part by the length of the common
   prefix and the byte that follows it. Equal strings end in one leaf; all but the first of a
   leaf start earlier too.
5. ``_removed``: the covered ranges of each text are joined and cut out.

An anchor hash with more than ``hot`` contexts to refine, at any size of the input, is not
sorted in one task: its strings are dealt out one by one by a hash of theirs (equal ones of a
batch once), and equal 128-bit hashes of one anchor and place are taken for equal strings. The
tasks know such anchors by a bitmap of fixed size over the hashes (``MARK_BITS``); an anchor
that only shares its bit with one takes the same way, with the same result.

Defined cases: a NULL text is empty; texts shorter than ``WIDTH`` lose nothing; NULL keys
come before all others, and rows that share a key are taken as texts one after the other, in
the order of their rows; an empty table gives no rows; other columns are ignored. Keys are
integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm import frames
from spendscope.llm.sharding import numbered

WIDTH = 100
GRAM = 32
LEFT = WIDTH - GRAM
CONTEXT = LEFT + WIDTH
MARK_BITS = 27
_PIECE = 17
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_COVERED, _REFINE, _HOT = 0, 1, 2

PACKED = "bucket long, kind int, payload binary"


# -------------------------------------------------- bytes as numbers

def words(buffer: bytes) -> np.ndarray:
    """The eight bytes from each position on, as little-endian integers."""
    n = len(buffer) - 7
    out = np.empty(n, dtype="<u8")
    for shift in range(8):
        part = out[shift::8]
        part[:] = np.frombuffer(buffer, dtype="<u8", offset=shift, count=len(part))
    return out


def mixed(state: np.ndarray, more: np.ndarray, step: int) -> np.ndarray:
    state = (state + more) * _MIX[step % 4]
    return state ^ (state >> np.uint64(29))


def grams(w: np.ndarray) -> np.ndarray:
    """Hashes of the grams, along the last axis."""
    n = w.shape[-1] - GRAM + 8
    out = np.zeros(w.shape[:-1] + (n,), dtype=np.uint64)
    for i in range(GRAM // 8):
        out = mixed(out, w[..., 8 * i:8 * i + n], i)
    return out


def sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` (minimum or maximum) of each ``width`` successive values."""
    reach = 1
    while 2 * reach <= width:
        values = least(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return least(values[:-rest], values[rest:]) if rest else values


def pack(**columns: np.ndarray) -> bytes:
    """Columns of numbers as one compressed value."""
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.compress(sink.getvalue().to_pybytes(), 1)


def unpack(payloads: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(zstandard.decompress(p)).read_all() for p in payloads])


def by_bucket(bucket: np.ndarray, kind: int, columns: dict[str, np.ndarray]) -> list[tuple[int, int, bytes]]:
    """One packed row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    return [(int(bucket[a]), kind, pack(**{k: v[order[a:b]] for k, v in columns.items()}))
            for a, b in zip(at, [*at[1:], len(bucket)])]


def packed_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "payload"])


# -------------------------------------------------- texts

class Texts:
    """Texts side by side, with room around for contexts."""

    def __init__(self, texts: list[bytes]):
        self.ends = LEFT + np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[LEFT], self.ends[:-1]]).astype(np.int64)
        self.words = words(bytes(LEFT) + b"".join(texts) + bytes(CONTEXT))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the anchors, their texts, their hashes."""
        hashes = grams(self.words)
        least = sliding(hashes, LEFT + 1, np.minimum)
        inside = np.zeros(len(least) + 1, dtype=np.int8)
        whole = self.ends - self.starts >= WIDTH
        np.add.at(inside, self.starts[whole], 1)
        np.add.at(inside, self.ends[whole] - WIDTH + 1, -1)
        least[np.cumsum(inside[:-1]) == 0] = 0
        border = np.zeros(LEFT, dtype=np.uint64)
        most = sliding(np.concatenate([border, least, border]), LEFT + 1, np.maximum)
        at = np.flatnonzero((most == hashes[:len(most)]) & (most > 0))
        return at, np.searchsorted(self.ends, at, side="right"), hashes[at]

    def contexts(self, at: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes around the places as rows of words (zero outside of the text), and how
        far the text reaches to the left and to the right."""
        left = np.minimum(at - self.starts[text], LEFT)
        right = np.minimum(self.ends[text] - at, WIDTH)
        rows = self.words[(at - LEFT)[:, None] + np.arange(0, CONTEXT, 8)]
        cut = np.flatnonzero((left < LEFT) | (right < WIDTH))
        if len(cut):
            place = np.arange(CONTEXT)
            outside = (place < LEFT - left[cut, None]) | (place >= LEFT + right[cut, None])
            own = rows[cut].view(np.uint8)
            own[outside] = 0
            rows[cut] = own.view("<u8")
        return rows, left, right


def chunks(keys: list, texts: list[bytes | None], size: int = 1 << 20) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    own_keys, own, total = [], [], 0
    for key, text in zip(keys, texts):
        own_keys.append(key)
        own.append(text or b"")
        total += len(own[-1])
        if total >= size:
            yield np.array(own_keys, dtype=np.int64), own
            own_keys, own, total = [], [], 0
    if own:
        yield np.array(own_keys, dtype=np.int64), own


def context_hash(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = (left * 256 + right).astype(np.uint64)
    for i in range(rows.shape[1]):
        out = mixed(out, rows[:, i], i)
    return out | np.uint64(1)


# -------------------------------------------------- steps 1 and 2: classes of contexts

def starts_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys starts."""
    new = np.zeros(len(sorted_keys[0]), dtype=bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _anchors(buckets: int, doc_buckets: int):
    """Batches of texts to packed rows: anchors by hash (kind -1), and what the batch
    decides by itself."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            parts = []
            for keys, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                side = Texts(texts)
                at, text, hashes = side.anchors()
                rows, left, right = side.contexts(at, text)
                parts.append((hashes, context_hash(rows, left, right), keys[text], at - side.starts[text]))
            if not parts:
                continue
            hashes, contexts, docs, at = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((at, docs, contexts, hashes))
            hashes, contexts, docs, at = hashes[order], contexts[order], docs[order], at[order]
            first = starts_of(hashes, contexts)
            out = flagged(docs[~first], at[~first], _COVERED, doc_buckets)
            hashes, contexts, docs, at = hashes[first], contexts[first], docs[first], at[first]
            group = np.cumsum(starts_of(hashes)) - 1
            count = np.bincount(group)
            several = count[group] > 1
            out += flagged(docs[several], at[several], _REFINE, doc_buckets)
            marker = several & starts_of(hashes)
            contexts[marker] = 0
            docs[marker], at[marker] = 0, count[group[marker]]
            send = ~several | marker
            send = np.flatnonzero(send)[np.argsort(docs[send], kind="stable")]
            out += by_bucket((hashes[send] % np.uint64(buckets)).astype(np.int64), -1, {
                "hash": hashes[send], "context": contexts[send], "doc": docs[send], "at": at[send]})
            yield packed_batch(out)

    return run


def flagged(docs: np.ndarray, at: np.ndarray, kind: int, doc_buckets: int) -> list[tuple[int, int, bytes]]:
    return ranges(docs, at - LEFT, at + WIDTH, kind, doc_buckets) if kind == _COVERED else (
        by_bucket(docs % doc_buckets, kind, {"doc": docs, "start": at}))


def ranges(docs: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int, doc_buckets: int) -> list[tuple[int, int, bytes]]:
    """Covered ranges by text; those of one text that overlap are joined."""
    order = np.lexsort((start, docs))
    docs, start, end = docs[order], np.maximum(start[order], 0), end[order]
    if not len(docs):
        return []
    # ranges of one text sorted by start: as all have nearly one length, ends grow too
    new = starts_of(docs)
    reach = np.maximum.accumulate(end + (np.cumsum(new) << 40)) - (np.cumsum(new) << 40)
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(docs)) - 1
    return by_bucket(docs[at] % doc_buckets, kind, {"doc": docs[at], "start": start[at], "end": reach[last]})


def _classes(doc_buckets: int, hot: int):
    """Anchors of a bucket from all batches: what is covered, what to refine, and the anchor
    hashes with more than ``hot`` contexts to refine (kind _HOT)."""

    def run(table: pa.Table) -> pa.Table:
        payloads = table.column("payload").to_pylist()
        rows = unpack(payloads)
        hashes, contexts, docs, at = (rows.column(c).to_numpy() for c in ("hash", "context", "doc", "at"))
        order = np.lexsort((at, docs, contexts, hashes))
        hashes, contexts, docs, at = hashes[order], contexts[order], docs[order], at[order]
        marker = contexts == 0
        new_hash = starts_of(hashes)
        group = np.cumsum(new_hash) - 1
        first = starts_of(hashes, contexts) & ~marker
        refined = np.bincount(group, first + marker * at, minlength=group[-1] + 1)
        again = ~first & ~marker
        out = flagged(docs[again], at[again], _COVERED, doc_buckets)
        several = first & (refined[group] > 1)
        out += flagged(docs[several], at[several], _REFINE, doc_buckets)
        many = np.flatnonzero(refined > hot)
        if len(many):
            out.append((0, _HOT, pack(hash=hashes[new_hash][many])))
        return pa.Table.from_batches([packed_batch(out)])

    return run


# -------------------------------------------------- step 3: contexts

def _marked(bits: int):
    """Packed rows of hot anchors to the places of their bits."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            payloads = batch.column("payload").to_pylist()
            if payloads:
                hashes = unpack(payloads).column("hash").to_numpy()
                at = np.unique(hashes >> np.uint64(64 - bits)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"piece": pa.array(at >> _PIECE), "at": pa.array(at & ((1 << _PIECE) - 1))})

    return run


def _piece(key: tuple, table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << _PIECE, dtype=np.uint8)
    bits[table.column("at").to_numpy()] = 1
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": [np.packbits(bits).tobytes()]})


class Marks:
    """The bitmap of hot anchors, from its pieces that hold any."""

    def __init__(self, pieces: list[tuple[int, bytes]], bits: int):
        self.bits, self.pieces = bits, pieces
        if pieces:
            self.map = np.zeros(1 << max(bits - 3, _PIECE - 3), dtype=np.uint8)
            for piece, own in pieces:
                self.map[piece << (_PIECE - 3):(piece + 1) << (_PIECE - 3)] = np.frombuffer(own, dtype=np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not self.pieces:
            return np.zeros(len(hashes), dtype=bool)
        at = hashes >> np.uint64(64 - self.bits)
        return (self.map[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0


def _contexts(buckets: int, shared_hot, bits: int):
    """Texts of a bucket, and the places to refine in them, to contexts by anchor hash
    (kind 0), or for hot anchors to strings by their hash (kind 1)."""

    def run(texts: pa.Table, flags: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if flags.num_rows and texts.num_rows:
            found = unpack(flags.column("payload").to_pylist())
            docs, places = found.column("doc").to_numpy(), found.column("start").to_numpy()
            order = np.lexsort((places, docs))
            docs, places = docs[order], places[order]
            hot = Marks(shared_hot.value, bits)
            parts = []
            wanted = {int(d): (int(a), int(b)) for d, a, b in zip(*spans_of(docs))}
            keys, bodies = texts.column("doc").to_pylist(), texts.column("text").to_pylist()
            own = [(k, b) for k, b in zip(keys, bodies) if k in wanted]
            for doc, text in chunks([k for k, _ in own], [b for _, b in own]):
                side = Texts(text)
                slices = [slice(*wanted[int(d)]) for d in doc]
                index = np.repeat(np.arange(len(doc)), [s.stop - s.start for s in slices])
                at = np.concatenate([places[s] for s in slices]) + side.starts[index]
                rows, left, right = side.contexts(at, index)
                parts.append((rows, left, right, doc[index], at - side.starts[index]))
            rows, left, right, docs, at = (np.concatenate(x) for x in zip(*parts))
            hashes = grams(expanded(rows)[:, LEFT:LEFT + GRAM - 7])[:, 0]
            is_hot = hot(hashes)
            cold = np.flatnonzero(~is_hot)
            if len(cold):
                body = np.empty(len(cold), dtype=object)
                body[:] = [r.tobytes() for r in rows[cold]]
                out += by_bucket((hashes[cold] % np.uint64(buckets)).astype(np.int64), 0, {
                    "hash": hashes[cold], "doc": docs[cold], "at": at[cold], "left": left[cold], "right": right[cold], "body": body})
            warm = np.flatnonzero(is_hot)
            for part in np.array_split(warm, -(-len(warm) // 20_000)) if len(warm) else []:
                spread = expanded(rows[part])
                rep, s = owned(spread, left[part], right[part])
                place = (hashes[part][rep] * _MIX[0]) ^ (s.astype(np.uint64) * _MIX[1])
                print_, check = (string_hash(spread, rep, s, turn) ^ place for turn in (0, 2))
                order = np.lexsort((at[part][rep], docs[part][rep], check, print_))
                first = starts_of(print_[order], check[order])
                # later equal strings of this bucket are kept out of the exchange: each is
                # covered, as the first of them starts earlier
                later = order[~first]
                begin = at[part][rep[later]] - LEFT + s[later]
                out += [(b, 2, p) for b, _, p in ranges(docs[part][rep[later]], begin, begin + WIDTH, 2, buckets)]
                keep = order[first]
                keep = keep[np.lexsort((at[part][rep[keep]] + s[keep], docs[part][rep[keep]]))]
                out += by_bucket((print_[keep] % np.uint64(buckets)).astype(np.int64), 1, {
                    "print": print_[keep], "check": check[keep], "doc": docs[part][rep[keep]], "at": at[part][rep[keep]] - LEFT + s[keep]})
        return pa.Table.from_batches([packed_batch(out)])

    return run


def spans_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.flatnonzero(starts_of(sorted_keys))
    return sorted_keys[at], at, np.append(at[1:], len(sorted_keys))


def expanded(rows: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of the contexts on."""
    body = np.ascontiguousarray(rows).view(np.uint8)
    padded = np.concatenate([body, np.zeros((len(body), 8), dtype=np.uint8)], axis=1)
    flat = words(padded.tobytes() + bytes(8))
    return flat[:padded.size].reshape(len(body), -1)[:, :CONTEXT - 7]


def owned(spread: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings whose leftmost smallest gram is the anchor: context number, start."""
    hashes = grams(spread)
    own = hashes[:, LEFT:LEFT + 1]
    place = np.arange(hashes.shape[1])
    lower = (hashes[:, :LEFT] <= own) & (place[:LEFT] >= LEFT - left[:, None])
    low = np.where(lower.any(axis=1), LEFT - lower[:, ::-1].argmax(axis=1), 0)
    higher = (hashes[:, LEFT + 1:] < own) & (place[LEFT + 1:] <= LEFT + right[:, None] - GRAM)
    high = np.where(higher.any(axis=1), LEFT + 1 + higher.argmax(axis=1) - LEFT - 1, LEFT)
    low = np.maximum(low, LEFT - left)
    high = np.minimum(np.minimum(high, LEFT), LEFT + right - WIDTH)
    count = np.maximum(high - low + 1, 0)
    rep = np.repeat(np.arange(len(low)), count)
    return rep, np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count) + low[rep]


def string_hash(spread: np.ndarray, rep: np.ndarray, s: np.ndarray, turn: int) -> np.ndarray:
    """One of several hashes of the strings, by ``turn``."""
    out = np.full(len(rep), turn, dtype=np.uint64)
    for i, offset in enumerate([*range(0, WIDTH - 8, 8), WIDTH - 8]):
        out = mixed(out, spread[rep, s + offset], i + turn)
    return out


# -------------------------------------------------- step 4: deep-shallow sorting

def leaves(spread: np.ndarray, rep: np.ndarray, s: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A number for each string, the same for equal strings of one ``group``."""
    n = len(rep)
    leaf = np.full(n, -1, dtype=np.int64)
    # shallow: multikey sorting by the first two words
    first, second = spread[rep, s].byteswap(), spread[rep, s + 8].byteswap()
    order = np.lexsort((second, first, group))
    tied = np.cumsum(starts_of(group[order], first[order], second[order])) - 1
    named = 0
    offsets = [*range(16, WIDTH - 8, 8), WIDTH - 8]
    # deep: blind tries, a level for all groups at a time
    while len(order):
        begin = np.flatnonzero(starts_of(tied))
        size = np.diff(np.append(begin, len(order)))
        owner = np.repeat(np.arange(len(begin)), size)
        head = order[begin][owner]
        prefix = np.full(len(order), WIDTH, dtype=np.int64)
        byte = np.zeros(len(order), dtype=np.int64)
        open_ = np.flatnonzero(order != head)
        for offset in offsets:
            if not len(open_):
                break
            mine = spread[rep[order[open_]], s[order[open_]] + offset]
            differ = mine ^ spread[rep[head[open_]], s[head[open_]] + offset]
            parted = differ != 0
            where = np.bitwise_count((differ[parted] & (~differ[parted] + np.uint64(1))) - np.uint64(1)) // 8
            prefix[open_[parted]] = offset + where
            byte[open_[parted]] = (mine[parted] >> (where.astype(np.uint64) * np.uint64(8))) & np.uint64(255)
            open_ = open_[~parted]
        equal = prefix == WIDTH
        leaf[order[equal]] = named + owner[equal]
        named += len(begin)
        rest = ~equal
        again = np.lexsort((byte[rest], prefix[rest], owner[rest]))
        order = order[rest][again]
        tied = np.cumsum(starts_of(owner[rest][again], prefix[rest][again], byte[rest][again])) - 1 if len(order) else order
    return leaf


def repeated(hashes: np.ndarray, docs: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray,
             rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered ranges of the contexts: text, start, end."""
    spread = expanded(rows)
    rep, s = owned(spread, left, right)
    anchor = np.unique(hashes, return_inverse=True)[1]
    leaf = leaves(spread, rep, s, anchor[rep] * (LEFT + 1) + s)
    age = np.empty(len(docs), dtype=np.int64)
    age[np.lexsort((at, docs))] = np.arange(len(docs))
    youngest = np.full(leaf.max(initial=-1) + 1, len(docs))
    np.minimum.at(youngest, leaf, age[rep])
    later = np.flatnonzero(age[rep] > youngest[leaf])
    begin = at[rep[later]] - LEFT + s[later]
    return docs[rep[later]], begin, begin + WIDTH


def _sorted_windows(doc_buckets: int, at_once: int = 8_000):
    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        kinds, payloads = table.column("kind").to_pylist(), table.column("payload").to_pylist()
        cold = [p for k, p in zip(kinds, payloads) if k == 0]
        if cold:
            found = unpack(cold)
            columns = [found.column(c).to_numpy() for c in ("hash", "doc", "at", "left", "right")]
            rows = np.frombuffer(b"".join(found.column("body").to_pylist()), dtype="<u8").reshape(-1, CONTEXT // 8)
            order = np.argsort(columns[0], kind="stable")
            edges = np.append(np.flatnonzero(starts_of(columns[0][order])), len(order))
            a = 0
            while a < len(edges) - 1:
                b = max(a + 1, int(np.searchsorted(edges, edges[a] + at_once, side="right")) - 1)
                part = order[edges[a]:edges[b]]
                out += ranges(*repeated(*(c[part] for c in columns), rows[part]), _COVERED, doc_buckets)
                a = b
        hot = [p for k, p in zip(kinds, payloads) if k == 1]
        if hot:
            found = unpack(hot)
            prints, checks, docs, at = (found.column(c).to_numpy() for c in ("print", "check", "doc", "at"))
            order = np.lexsort((at, docs, checks, prints))
            later = order[~starts_of(prints[order], checks[order])]
            out += ranges(docs[later], at[later], at[later] + WIDTH, _COVERED, doc_buckets)
        for p in (p for k, p in zip(kinds, payloads) if k == 2):
            found = unpack([p])
            out += ranges(*(found.column(c).to_numpy() for c in ("doc", "start", "end")), _COVERED, doc_buckets)
        return pa.Table.from_batches([packed_batch(out)])

    return run


# -------------------------------------------------- step 5: cutting out

def runs(start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges joined to maximal runs inside of a text of ``size`` bytes."""
    edge = np.zeros(size + 1, dtype=np.int32)
    np.add.at(edge, np.clip(start, 0, size), 1)
    np.add.at(edge, np.clip(end, 0, size), -1)
    bits = np.diff((np.cumsum(edge[:-1]) > 0).astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(bits > 0), np.flatnonzero(bits < 0)


def _removed(table_texts: pa.Table, flags: pa.Table) -> pa.Table:
    wanted, start, end = {}, None, None
    if flags.num_rows:
        found = unpack(flags.column("payload").to_pylist())
        docs, start, end = (found.column(c).to_numpy() for c in ("doc", "start", "end"))
        order = np.argsort(docs, kind="stable")
        start, end = start[order], end[order]
        wanted = {int(d): slice(int(a), int(b)) for d, a, b in zip(*spans_of(docs[order]))}
    docs, removed = table_texts.column("doc").to_pylist(), []
    kept, spans = [], []
    for doc, text in zip(docs, table_texts.column("text").to_pylist()):
        text = text or b""
        own = wanted.get(doc)
        a, b = runs(start[own], end[own], len(text)) if own else ((), ())
        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b)])
        kept.append(b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)])) if len(a) else text)
        removed.append(len(text))
    return pa.table({
        "doc": pa.array(docs, pa.int64()), "n_bytes": pa.array(removed, pa.int64()),
        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        "kept": pa.array(kept, pa.binary())})


def _keyed(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame | None]:
    """``doc`` and ``text`` with ``doc`` unique; the keys by ``doc`` where it is not the key."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    unclear = rows.groupBy("key").agg(F.count("*").alias("n")).where("key IS NULL OR n > 1").limit(1).count()
    if not unclear:
        return rows.select(F.col("key").cast("long").alias("doc"), "text"), None
    rows = frames.stored(rows.withColumn("row", F.monotonically_increasing_id()))
    ranks = numbered(rows.select(F.lit(0).alias("all"), "key", "row"), "all", ["key", "row"], "doc")
    ranks = frames.checkpointed(ranks.select("row", "doc", "key"))
    return rows.join(ranks.select("row", "doc"), "row").select("doc", "text"), ranks.select("doc", "key")


def removed(docs: DataFrame, text: str = "text", key: str = "doc_id", bucket_bytes: int = 6 << 20,
            hot: int = 16_384, mark_bits: int = MARK_BITS) -> DataFrame:
    """``key``, ``n_bytes``, ``spans`` (the removed runs of bytes) and ``kept`` (what is left,
    as bytes) of every row."""
    keyed, keys = _keyed(docs, text, key)
    total, = keyed.agg(F.sum(F.octet_length("text"))).first()
    buckets = -(-(total or 0) // bucket_bytes) or 1
    sc = docs.sparkSession.sparkContext
    anchors = keyed.mapInArrow(_anchors(buckets, buckets), PACKED)
    decided = frames.stored(anchors.groupBy("bucket").applyInArrow(_passed(_classes(buckets, hot)), PACKED))
    marks = decided.where(F.col("kind") == _HOT).select("payload").mapInArrow(_marked(mark_bits), "piece long, at long")
    pieces = [(r["piece"], bytes(r["bits"])) for r in marks.distinct().groupBy("piece").applyInArrow(
        _piece, "piece long, bits binary").collect()]
    texts = keyed.withColumn("bucket", F.pmod("doc", F.lit(buckets)))
    refine = decided.where(F.col("kind") == _REFINE)
    contexts = texts.groupBy("bucket").cogroup(refine.groupBy("bucket")).applyInArrow(
        _contexts(buckets, sc.broadcast(pieces), mark_bits), PACKED)
    windows = contexts.groupBy("bucket").applyInArrow(_sorted_windows(buckets), PACKED)
    covered = decided.where(F.col("kind") == _COVERED).unionByName(windows)
    out = texts.groupBy("bucket").cogroup(covered.groupBy("bucket")).applyInArrow(
        _removed, "doc long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    if keys is None:
        return out.select(F.col("doc").cast(docs.schema[key].dataType).alias(key), "n_bytes", "spans", "kept")
    return out.join(keys, "doc").select(F.col("key").alias(key), "n_bytes", "spans", "kept")


def _passed(classes):
    """What batches have decided by themselves goes through, anchors are classed."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        own = table.filter(pa.array(kinds < 0))
        rest = table.filter(pa.array(kinds >= 0))
        return pa.concat_tables([rest, classes(own)]) if own.num_rows else rest

    return run


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The result of ``removed`` as counts and a checksum."""
    found = removed(docs, text, key)
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(key, "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
