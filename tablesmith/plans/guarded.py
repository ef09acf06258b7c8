"""Read-only SQL over registered tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

MAX_ROWS = 40
#: The nodes that a parsed query is made of; a statement with any other is refused.
NODES = frozenset(
    "Project Filter Aggregate Join LateralJoin AsOfJoin SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith Union Intersect Except Distinct Sort "
    "GlobalLimit LocalLimit Limit Offset Tail OneRowRelation UnresolvedInlineTable LocalRelation UnresolvedHaving Pivot Unpivot Generate WithWindowDefinition Window Sample "
    "UnresolvedHint UnresolvedTableValuedFunction UnresolvedTVFAliases Deduplicate Expand GroupingSets".split()
)
#: Functions that reach beyond the rows, and the table functions that do not.
FORBIDDEN = frozenset(("reflect", "java_method", "try_reflect"))
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())


def view_name(name: str) -> str:
    return re.sub(r"\W", "_", name)


def _seq(s: object) -> list:
    return [s.apply(i) for i in range(s.size())]


def _expressions(top: list) -> Iterator[object]:
    while top:
        e = top.pop()
        yield e
        top += _seq(e.children())


class Refused(ValueError):
    """A statement that is more than a query over the given relations."""


def relations(spark: SparkSession, query: str, known: Iterable[str] | None = None) -> set[str]:
    """The relations that a query reads, by its parsed plan; Refused if it is anything but a query.

    Every node must be one of NODES, every function built in and none of
    FORBIDDEN, and every relation a plain name: of ``known`` (if given) or of
    the query's own WITH. So no file, catalog or class is within reach, and
    keywords inside literals do not matter.
    """
    session = spark._jsparkSession.sessionState()
    registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry
    kind = lambda x: x.getClass().getSimpleName()
    todo, names, own = [session.sqlParser().parsePlan(query)], set(), set()
    while todo:
        node = todo.pop()
        name = kind(node)
        if name not in NODES:
            raise Refused(f"only queries are allowed, not {name}")
        if name == "UnresolvedRelation":
            parts = _seq(node.multipartIdentifier())
            if len(parts) != 1:
                raise Refused(f"no registered table: {'.'.join(parts)}")
            names.add(parts[0])
        elif name == "UnresolvedWith":
            own |= {x.alias() for x in _seq(node.innerChildren())}
            todo += _seq(node.innerChildren())
        elif name == "UnresolvedTableValuedFunction" and _seq(node.name())[-1].lower() not in TABLE_FUNCTIONS:
            raise Refused(f"no such table function: {_seq(node.name())[-1]}")
        for e in _expressions(_seq(node.expressions())):
            if kind(e) == "UnresolvedFunction":
                parts = [p.lower() for p in _seq(e.nameParts())]
                if parts[-1] in FORBIDDEN or not registry.functionSet().contains(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(parts[-1])):
                    raise Refused(f"no such function: {'.'.join(parts)}")
            elif kind(e).endswith("Subquery") and kind(e) != "InSubquery" or kind(e) in ("Exists", "ListQuery"):
                todo.append(e.plan())
        todo += _seq(node.children())
    read = {n for n in names if n.lower() not in {o.lower() for o in own}}
    if known is not None and (strange := {n for n in read if n.lower() not in {k.lower() for k in known}}):
        raise Refused(f"no registered table: {', '.join(sorted(strange))}")
    return read


def is_query(spark: SparkSession, query: str) -> bool:
    """Whether the parsed statement only reads, and by plain names."""
    try:
        relations(spark, query)
    except Refused:
        return False
    return True


class SqlSession:
    """Views over tables, guarded queries, and which views a query reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.views = spark, set()

    def register(self, name: str, df: DataFrame) -> str:
        """The view's name: ``name`` with signs as underscores, and a number where another table of this session has it."""
        first = v = view_name(name)
        n = 1
        while v.lower() in {x.lower() for x in self.views}:
            n += 1
            v = f"{first}_{n}"
        df.createOrReplaceTempView(v)
        self.views.add(v)
        return v

    def run(self, query: str, rows: int | None = MAX_ROWS) -> DataFrame:
        relations(self.spark, query, self.views)
        df = self.spark.sql(query)
        return df if rows is None else df.limit(rows)

    def touched(self, query: str) -> set[str]:
        read = {n.lower() for n in relations(self.spark, query, self.views)}
        return {v for v in self.views if v.lower() in read}
