"""Rules of governed SQL, decided on the nodes of Spark's own parsed plan.

The plan is read through the session's JVM, so this works in classic sessions, not over
Spark Connect.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import SparkSession

# What a governed query may be made of. Names of plan nodes as Spark
# parses a query, and names of functions: aggregates, arithmetic, conditions, dates,
# text and windows. Whatever is not listed is refused.
NODES = frozenset("""
    Aggregate Distinct Except Filter GlobalLimit Intersect Join LocalLimit Offset OneRowRelation Project Sort
    SubqueryAlias Union UnresolvedHaving UnresolvedOrderBy UnresolvedRelation UnresolvedSubqueryColumnAliases
    UnresolvedWith Window WithWindowDefinition""".split())
AGGREGATES = frozenset("""
    any_value approx_count_distinct avg bool_and bool_or corr count count_if max max_by mean median min min_by
    percentile percentile_approx stddev stddev_pop stddev_samp sum try_avg try_sum var_pop var_samp variance""".split())
FUNCTIONS = AGGREGATES | frozenset("""
    abs ceil ceiling div exp floor greatest least ln log log10 log2 mod nullif pmod pow power round bround sign
    signum sqrt try_add try_divide try_multiply try_subtract safe_divide
    case coalesce if ifnull iff isnan isnotnull isnull nvl nvl2 when
    add_months current_date date date_add date_diff date_format date_sub date_trunc datediff day dayofmonth
    dayofweek dayofyear extract hour last_day make_date minute month months_between now quarter second to_date
    to_timestamp trunc unix_timestamp week weekofyear week_start year current_timestamp date_part timestamp
    btrim char_length character_length concat concat_ws contains endswith initcap instr lcase left length like lower
    lpad ltrim position regexp_extract regexp_like regexp_replace replace right rlike rpad rtrim split split_part
    startswith strpos substr substring translate trim ucase upper ilike
    cume_dist dense_rank first first_value lag last last_value lead nth_value ntile percent_rank rank row_number
    and or not in between cast bigint boolean decimal double float int string""".split())


class Parsed:
    """Names and node kinds of one parsed query, subqueries and CTEs included."""

    def __init__(self, spark: SparkSession, select: str):
        self._parser = spark._jsparkSession.sessionState().sqlParser()
        self._select = select
        self.kinds: set[str] = set()
        self.relations: list[tuple[str, ...]] = []
        self.functions: set[str] = set()
        self.ctes: set[str] = set()
        #: first and last character of each relation's name
        self._places: list[tuple[int, int]] = []
        for node in self._plans(self._parser.parsePlan(select)):
            kind = node.getClass().getSimpleName()
            self.kinds.add(kind)
            if kind == "UnresolvedRelation":
                self.relations.append(tuple(_items(node.multipartIdentifier())))
                self._places.append((node.origin().startIndex().get(), node.origin().stopIndex().get()))

    def with_views(self, aliases: Mapping[str, str]) -> str:
        """The query with the relations whose names are aliases replaced by their views. Only
        the places that the parsed relations come from change; a name that a CTE of the
        query has is the CTE's."""
        views = {name.lower(): view for name, view in aliases.items()}
        out = self._select
        for parts, (first, last) in sorted(zip(self.relations, self._places), key=lambda r: -r[1][0]):
            name = ".".join(parts).lower()
            if name not in views or name in self.ctes:
                continue
            if tuple(_items(self._parser.parseMultipartIdentifier(out[first:last + 1]))) != parts:
                raise ValueError(f"the place of relation {name!r} is not known")
            out = f"{out[:first]}`{views[name]}`{out[last + 1:]}"
        return out

    def _plans(self, plan) -> Iterator:
        yield plan
        kind = plan.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            for relation in _items(plan.cteRelations()):
                self.ctes.add(relation.productElement(0).lower())
                yield from self._plans(relation.productElement(1))
        for expression in _items(plan.expressions()):
            yield from self._expressions(expression)
        for child in _items(plan.children()):
            yield from self._plans(child)

    def _expressions(self, expression) -> Iterator:
        kind = expression.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            self.functions.add(".".join(_items(expression.nameParts())).lower())
        elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            yield from self._plans(expression.plan())
        elif "Unresolved" in kind and kind not in ("UnresolvedAttribute", "UnresolvedStar", "UnresolvedAlias",
                                                   "UnresolvedWindowExpression", "UnresolvedOrdinal"):
            self.kinds.add(kind)
        for child in _items(expression.children()):
            yield from self._expressions(child)


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def unequal_join(spark: SparkSession, optimized) -> bool:
    """Whether a plan holds a join without an equality between its sides."""
    keys = spark._jvm.org.apache.spark.sql.catalyst.planning.ExtractEquiJoinKeys
    if optimized.getClass().getSimpleName() == "Join" and keys.unapply(optimized).isEmpty():
        return True
    return any(unequal_join(spark, child) for child in _items(optimized.children()))
