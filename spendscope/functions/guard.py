"""Rules for ad-hoc query text, as Column expressions.

They audit a table of query texts in one pass without shuffle. Word boundaries and white
space are spelled out as character classes, so a pattern means the same in every regular
expression engine.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendscope.functions.text import WHITE_SPACE
from spendscope.settings import SETTINGS, Settings


# ---------------------------------------------------------------------------
# The words and patterns the rules look for.
# ---------------------------------------------------------------------------
WRITE_VERBS = ("DROP", "CREATE", "ALTER", "INSERT", "UPDATE", "DELETE", "TRUNCATE")
FILE_VERBS = ("LOAD", "OUTFILE", "DUMPFILE", "EXPORT")
SYSTEM_PROCEDURES = ("xp_cmdshell", "sp_executesql")
SYSTEM_SCHEMAS = ("INFORMATION_SCHEMA", "mysql", "pg_")
AGGREGATES = ("SUM", "AVG", "MAX", "MIN", "COUNT")
STACKED_WRITE = rf"(?i);{WHITE_SPACE}*(?:{'|'.join(WRITE_VERBS)})"
LINE_COMMENT = "--"
BLOCK_COMMENT = r"/\*[\s\S]*?\*/"
SYS_MEMBER = r"(?i)(?:^|\W)sys\.\w"
QUALIFIED_TABLE = r"`[^`]+`\.`[^`]+`\.`[^`]+`|[\w-]+\.[\w-]+\.[\w-]+"
LIMIT_CLAUSE = rf"(?i)(?:^|\W)LIMIT{WHITE_SPACE}+\d+(?:\W|$)"

PASSED = "PASSED"


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions)


def longer_than(value: Column, units: int) -> Column:
    """Whether a text has more UTF-16 units (a character outside the basic plane has
    two). It has at least as many bytes, so short texts need no encoding."""
    encoded = F.octet_length(F.encode(value, "UTF-16BE"))
    return (F.octet_length(value) > units) & (encoded > 2 * units)


class QueryText:
    """A trimmed query text and its lower-case form, as two columns.

    A regular expression costs far more per character than a search for a literal, so
    every pattern runs only on texts that hold the literal it cannot do without.
    """

    def __init__(self, cleaned: Column, lowered: Column) -> None:
        self.cleaned, self.lowered = cleaned, lowered

    def holds(self, literal: str) -> Column:
        return F.contains(self.lowered, F.lit(literal.lower()))

    def matches(self, pattern: str) -> Column:
        return F.rlike(self.cleaned, F.lit(pattern))

    def has_word(self, *words: str) -> Column:
        return any_of(self.holds(w) & self.matches(rf"(?i)(?:^|\W){w}(?:\W|$)") for w in words)

    def calls(self, *functions: str) -> Column:
        opened = rf"{WHITE_SPACE}*\("
        return self.holds("(") & any_of(
            self.holds(f) & self.matches(rf"(?i)(?:^|\W){f}{opened}") for f in functions
        )

    def tables(self) -> Column:
        """Three-part names as they are written."""
        return F.regexp_extract_all(self.cleaned, F.lit(QUALIFIED_TABLE), F.lit(0))

    def may_have_tables(self) -> Column:
        return self.matches(r"[\w-]\.[\w-]+\.[\w-]") | self.holds("`.`")


def first_failed_rule(
    query: QueryText, allowed_tables: Sequence[str], settings: Settings = SETTINGS
) -> Column:
    """Name of the first rule a query text breaks, or PASSED. ``allowed_tables`` are
    three-part names without quotes."""

    def names_allowed(text: Column) -> Column:
        return any_of(F.contains(text, F.lit(table)) for table in allowed_tables)

    dangerous = any_of(
        [
            query.holds(";") & query.matches(STACKED_WRITE),
            query.holds(LINE_COMMENT),
            query.holds("/*") & query.matches(BLOCK_COMMENT),
            query.has_word(*SYSTEM_PROCEDURES),
        ]
    )
    system = query.has_word(*SYSTEM_SCHEMAS) | (query.holds("sys.") & query.matches(SYS_MEMBER))
    limited = query.holds("limit") & query.matches(LIMIT_CLAUSE)
    unauthorized = query.may_have_tables() & F.exists(query.tables(), lambda t: ~names_allowed(t))
    return (
        F.when(query.cleaned.isNull(), "NOT_A_STRING")
        .when(longer_than(query.cleaned, settings.max_query_length), "TOO_LONG")
        .when(dangerous, "DANGEROUS_PATTERN")
        .when(query.has_word(*WRITE_VERBS), "WRITE_OPERATION")
        .when(system, "SYSTEM_SCHEMA")
        .when(query.has_word(*FILE_VERBS), "FILE_OPERATION")
        .when(unauthorized, "UNAUTHORIZED_TABLE")
        .when(query.has_word("JOIN") & (F.size(query.tables()) > 1), "JOIN")
        # a count is one of the aggregate calls, so one test covers both exceptions
        .when(~(limited | query.calls(*AGGREGATES)), "NO_LIMIT")
        .when(~names_allowed(query.cleaned), "NO_ALLOWED_TABLE")
        .otherwise(PASSED)
    )
