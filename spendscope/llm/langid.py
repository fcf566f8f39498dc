"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, everything but letters becomes a space, and its 1-, 2- and
3-grams of characters are hashed to ``buckets``. The model is a matrix of
log-probabilities, one row for each bucket and one column for each language. It is
broadcast (its size is checked) and texts are scored in batches: the rows of a text's
n-grams are gathered and summed, which is the product of its sparse count vector with
the matrix, without building the counts.

Defined cases: a NULL text, an empty one and one without any letter give ``und`` and
score 0. Rows with NULL text, NULL language or NULL id are not learned from. Without
any row to learn from every text is ``und``. Equal posteriors go to the language that
sorts first. Repeated rows count as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm import frames

UNKNOWN = "und"
_ORDERS = 3
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    #: a row of zeros comes last, for positions that hold no n-gram
    log_prob: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.log_prob) - 1


class Grams:
    """Bucket numbers of the n-grams of many texts at once."""

    def __init__(self, buckets: int, chunk: int = 400_000):
        self.buckets, self.chunk = buckets, chunk
        self.letter = np.zeros(0x110000, dtype=bool)
        self.letter[:] = [chr(c).isalpha() for c in range(0x110000)]

    def pieces(self, texts: Iterable[str | None]) -> Iterator[tuple[list[int], list[str]]]:
        """Texts in chunks of bounded length; a longer text comes in several pieces, each
        with the n-grams that start in its first ``chunk`` characters."""
        owners, parts, size = [], [], 0
        for i, text in enumerate(texts):
            text = (text or "").lower()
            for at in range(0, len(text), self.chunk):
                part = text[at:at + self.chunk + _ORDERS - 1]
                if parts and size + len(part) > self.chunk:
                    yield owners, parts
                    owners, parts, size = [], [], 0
                owners.append(i)
                parts.append(part)
                size += len(part)
        if parts:
            yield owners, parts

    def hashed(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the parts, buckets by n-gram length (rows), letters per part."""
        gap = "\x00" * _ORDERS
        codes = np.frombuffer((gap.join(parts) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(p) for p in parts])
        starts = np.cumsum(sizes + _ORDERS) - sizes - _ORDERS
        letters = self.letter[codes]
        codes = np.where(letters, codes, np.uint32(32))
        counts = np.add.reduceat(letters, starts, dtype=np.int64)
        found = np.empty((_ORDERS, len(codes)), dtype=np.int32)
        mixed = np.zeros(len(codes), dtype=np.uint32)
        seen = np.zeros(len(codes), dtype=bool)
        for n in range(_ORDERS):
            end = len(codes) - n
            mixed[:end] = (mixed[:end] ^ codes[n:]) * _MULTIPLIERS[n]
            seen[:end] |= letters[n:]
            found[n] = np.where(seen, (mixed ^ (mixed >> np.uint32(15))) & np.uint32(self.buckets - 1), self.buckets)
            # no n-gram starts where it would leave its part, or in the next piece
            for first, last in zip(starts + np.minimum(np.maximum(sizes - n, 0), self.chunk), starts + sizes + _ORDERS):
                found[n, first:last] = self.buckets
        return starts, found, counts


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", buckets: int = 1 << 15,
        fit_rows: int = 40_000, smoothing: float = 0.5, max_languages: int = 500) -> Model:
    """Learn from about ``fit_rows`` of the labelled rows at most (chosen by a hash of ``key``).

    ``buckets`` is a power of two. The sample is dealt to a fixed number of tasks, so the
    counts that reach the driver are bounded by ``max_languages`` times ``buckets``; more
    languages raise an error.
    """
    rows = frames.sampled(
        labelled.select(key, text, lang).where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull()),
        key, fit_rows)
    found = [r[0] for r in rows.select(lang).distinct().limit(max_languages + 1).collect()]
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn")
    languages = tuple(sorted(found))
    blocks = 16

    partial = "lang string, block int, documents long, counts array<long>"
    made = frames.arrow(partial)

    def count(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(buckets)
        totals: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for batch in incoming:
            langs = batch.column(1).to_pylist()
            texts = batch.column(0).to_pylist()
            for name in sorted(set(langs)):
                own = [t for t, other in zip(texts, langs) if other == name]
                counts = totals.setdefault(name, np.zeros(buckets + 1, dtype=np.int64))
                documents[name] = documents.get(name, 0) + len(own)
                for _, parts in grams.pieces(own):
                    counts += np.bincount(grams.hashed(parts)[1].ravel(), minlength=buckets + 1)
        for name, counts in totals.items():
            for block, part in enumerate(np.split(counts[:buckets], blocks)):
                yield from frames.batches([{"lang": [name], "block": [block], "documents": [documents[name]],
                                            "counts": [part.tolist()]}], made)

    summed = (
        rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).repartition(24)
        .mapInArrow(count, partial)
        .select("lang", "block", "documents", F.posexplode("counts").alias("at", "n")).where("n > 0")
        .groupBy("lang", (F.col("block") * (buckets // blocks) + F.col("at")).alias("bucket"))
        .agg(F.sum("n").alias("n"))
    )
    counts = np.zeros((buckets, len(languages)))
    columns = {name: i for i, name in enumerate(languages)}
    for r in summed.toLocalIterator(prefetchPartitions=True):
        counts[r["bucket"], columns[r["lang"]]] = r["n"]
    documents = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}
    prior = np.array([documents[name] for name in languages], dtype=float)
    if languages:
        prior = np.log(prior / prior.sum())
        counts = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * buckets))
    return Model(languages, prior, np.vstack([counts, np.zeros((1, len(languages)))]).astype(np.float32))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.grams = model, Grams(model.buckets)
        self.columns = np.ascontiguousarray(model.log_prob.T)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        model = self.model
        if not model.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total = np.tile(model.log_prior, (len(texts), 1))
        letters = np.zeros(len(texts), dtype=np.int64)
        for owners, parts in self.grams.pieces(texts):
            starts, found, counts = self.grams.hashed(parts)
            np.add.at(letters, owners, counts)
            for column, values in enumerate(self.columns):
                sums = np.add.reduceat(values[found].sum(axis=0, dtype=np.float64), starts)
                np.add.at(total[:, column], owners, sums)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        known = letters > 0
        return ([model.languages[b] if k else UNKNOWN for b, k in zip(best, known)],
                np.where(known, score, 0.0).tolist())


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` (posterior of the language, 0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        scorer = Scorer(shared.value)

        def step(ids, texts):
            langs, scores = scorer(texts.to_pylist())
            return {key: ids, "lang_pred": langs, "score": scores}
        return step

    kind = docs.schema[key].dataType.simpleString()
    return frames.per_document(docs, [key, text], f"{key} {kind}, lang_pred string, score double", work)


def learned(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: those not held out."""
    return docs.where(frames.remainder(key, 4) != 2)


def identified(docs: DataFrame, model: Model, min_score: float = 0.5, text: str = "text") -> DataFrame:
    """Rows whose language is known with a posterior of at least ``min_score``; the
    others (no letters, undecided) go. All columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        scorer = Scorer(shared.value)

        def step(texts):
            return [lang != UNKNOWN and score >= min_score for lang, score in zip(*scorer(texts.to_pylist()))]
        return step

    return frames.kept_rows(docs, text, work)
