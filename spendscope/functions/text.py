"""Text predicates and the parts of a creative name."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import or_
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The separator of creative names, and white space as a set of characters
# and as a regular expression class (ASCII spaces, Unicode separators, byte order mark).
NAME_SEPARATOR = " // "
WHITE_SPACE_CHARACTERS = "".join(
    map(chr, [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
              0x202F, 0x205F, 0x3000, 0xFEFF])
)
WHITE_SPACE = r"[\s\x0B\p{Z}\x{FEFF}]"

UNKNOWN_CONCEPT = "Unknown_Concept"


def strip(value: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.trim(value, F.lit(WHITE_SPACE_CHARACTERS))


def contains_any(value: Column, terms: Sequence[str]) -> Column:
    """Case-insensitive literal substring match on any term; no terms match nothing. Hundreds
    of terms are a tree of few levels; for more, see ``names_with_any``."""
    lowered = F.lower(value)
    hits = [F.contains(lowered, F.lower(F.lit(term.strip()))) for term in terms]
    while len(hits) > 1:
        hits = [reduce(or_, hits[i:i + 2]) for i in range(0, len(hits), 2)]
    return hits[0] if hits else F.lit(False)


def in_list(value: Column, values: Sequence[str]) -> Column:
    """IN list; an empty list matches nothing."""
    return value.isin(list(values))


def shortened(value: Column, length: int) -> Column:
    return F.substring(value, 1, length)


def _part(name: Column, index: int) -> Column:
    return F.get(F.split(name, NAME_SEPARATOR), F.lit(index))


def creative_concept(name: Column) -> Column:
    """First part of the name; a name without separator is its own concept, by its first
    50 characters (longer names with one beginning are one concept)."""
    return (
        F.when(F.contains(name, F.lit(NAME_SEPARATOR)), strip(_part(name, 0)))
        .when(name.isNotNull(), shortened(name, 50))
        .otherwise(UNKNOWN_CONCEPT)
    )


def creative_format(name: Column) -> Column:
    return strip(_part(name, 2))


def creative_creator(name: Column) -> Column:
    return strip(_part(name, 3))


def names_with_any(frame: DataFrame, column: str, terms: Sequence[str]) -> DataFrame:
    """The distinct values of ``column`` for which ``contains_any`` holds, by a dictionary: the
    work for a name does not grow with the number of terms. The result is to be joined back to
    rows that are aggregated by name."""
    stripped = list(dict.fromkeys(term.strip() for term in terms))
    values = frame.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    if "" in stripped or not stripped:
        return values.where(F.lit("" in stripped)).toDF(column)
    found = term_candidates(values, stripped).where(F.contains(F.col("lowered"), F.col("term")))
    return found.select("value").distinct().toDF(column)


def term_candidates(values: DataFrame, terms: Sequence[str]) -> DataFrame:
    """The terms to compare each ``value`` with: ``value``, ``lowered``, ``term``.

    Every value is cut into its grams of a few lengths, and every term is looked up by one gram
    of its own: its first or its last, whichever fewer terms share.
    """
    # lower case never has fewer characters, so a gram fits into the term in either form
    sizes = {t: 1 << ((len(t) + 1) // 2).bit_length() - 1 for t in terms}
    shared = Counter(side for t, n in sizes.items() for side in ((False, t[:n].lower()), (True, t[-n:].lower())))
    rows = [(t, n, shared[True, t[-n:].lower()] < shared[False, t[:n].lower()]) for t, n in sizes.items()]
    lowered, size = F.lower(F.col("term")), F.col("size")
    dictionary = values.sparkSession.createDataFrame(rows, "term string, size int, at_end boolean").select(
        lowered.alias("term"),
        F.when(F.col("at_end"), F.right(lowered, size)).otherwise(F.left(lowered, size)).alias("gram"),
    )
    name = F.lower(F.col("value"))

    def grams(n: int) -> Column:
        starts = F.when(F.length(name) >= n, F.sequence(F.lit(1), F.length(name) - (n - 1)))
        return F.coalesce(F.transform(starts, lambda at: F.substring(name, at, F.lit(n))), F.array().cast("array<string>"))

    cut = F.array_distinct(F.concat(*[grams(n) for n in sorted(set(sizes.values()))]))
    return (
        values.select("value", name.alias("lowered"), F.explode(cut).alias("gram"))
        .join(dictionary, "gram")
        .select("value", "lowered", "term")
    )
