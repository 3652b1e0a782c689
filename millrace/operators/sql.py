"""Ad-hoc read-only SQL over tables."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Collection, Iterator, Mapping

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_SETTINGS = ("spark.sql.ansi.enabled", "spark.sql.ansi.doubleQuotedIdentifiers")
# Functions that call into the JVM by name.
_REFLECTIVE = {"reflect", "java_method", "try_reflect"}
_REFLECTIVE_CALLS = {"CallMethodViaReflection", "TryReflect"}
# Relations of an analysed plan that hold rows of the query's own text.
_UNSTORED = {"OneRowRelation", "LocalRelation"}
# The settings below belong to the session, which queries of other threads share.
_SETTINGS_LOCK = threading.Lock()
_FENCE = re.compile(r"\A\s*```[a-zA-Z]*\s*\n(.*?)\n?\s*```\s*\Z", re.S)


class QueryRefused(PermissionError):
    """The query reaches for something else than the given tables."""


def _inner(node, part: str) -> list:
    try:
        found = getattr(node, part)()
    except Py4JError:  # not a part of this kind of node
        return []
    return [found.apply(i) for i in range(found.size())]


def _check(node, names: frozenset[str] | None) -> None:
    """Refuse external scripts, calls by name, and relations that are neither
    given tables nor named by the query itself. Files are relations with a format
    in front, so a name of one part is never a path."""
    kind = node.getClass().getSimpleName()
    if kind == "ScriptTransformation":
        raise QueryRefused("a query cannot run external programs")
    if "UnresolvedIdentifier" in kind:  # IDENTIFIER(..), a name known only later
        raise QueryRefused("a query has to spell names out")
    if kind == "UnresolvedFunction" and node.nameParts().last().lower() in _REFLECTIVE:
        raise QueryRefused("a query cannot call code by name")
    if kind == "UnresolvedWith":
        relations = _inner(node, "cteRelations")
        if names is not None:
            names = names | {r._1().lower() for r in relations}
        for r in relations:
            _check(r._2(), names)
    if kind == "UnresolvedRelation":
        parts = _inner(node, "multipartIdentifier")
        if len(parts) != 1 or names is not None and parts[0].lower() not in names:
            known = "" if names is None else f"; there are {sorted(names)}"
            raise QueryRefused(f"a query cannot read {'.'.join(parts)}{known}")
    if "Subquery" in kind or kind in ("Exists", "ListQuery"):
        try:
            _check(node.plan(), names)
        except Py4JError:  # InSubquery holds its query as an expression
            pass
    for part in ("children", "expressions"):
        for inner in _inner(node, part):
            _check(inner, names)


def _nodes(node, views: Collection[str]) -> Iterator:
    """Nodes of an analysed plan, also of its expressions and subqueries, as far as
    the views: what a given table is made of is its owner's business."""
    kind = node.getClass().getSimpleName()
    if kind == "View" and node.desc().identifier().table() in views:
        return
    yield node, kind
    inner = _inner(node, "children") + _inner(node, "expressions")
    if "Subquery" in kind or kind in ("Exists", "ListQuery"):
        try:
            inner.append(node.plan())
        except Py4JError:  # InSubquery holds its query as an expression
            pass
    for one in inner:
        yield from _nodes(one, views)


def _check_analysed(plan, views: Collection[str]) -> None:
    """What names have turned out to be, before anything runs: no calls by name and,
    beside the views, nothing stored."""
    for node, kind in _nodes(plan, views):
        if kind in _REFLECTIVE_CALLS:
            raise QueryRefused("a query cannot call code by name")
        if views and kind.endswith("Relation") and kind not in _UNSTORED:
            raise QueryRefused("a query cannot read anything but the given tables")


def sql_query(
    spark: SparkSession, query: str, tables: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Run one SELECT with double-quoted column names.

    Scans are pruned and filters pushed down as in any Spark SQL. The text is
    wrapped as a subquery: statements that change data, or a second statement, do
    not parse. Its plan is checked as parsed and as analysed, before it runs: it can
    read the given tables (without any, the session's views) and nothing else, and
    names stand in it as they are, not as ``IDENTIFIER(..)``. The tables are views
    under new names, seen by the query alone; a code fence around the text and a
    final semicolon are taken off.
    """
    fenced = _FENCE.match(query)
    text = (fenced[1] if fenced else query).strip().rstrip(";").rstrip()
    heads, views = [], []
    for name, df in (tables or {}).items():
        view = f"millrace_{uuid.uuid4().hex}"
        views.append(view)
        df.createOrReplaceTempView(view)
        quoted = name.replace('"', '""')
        heads.append(f'"{quoted}" AS (SELECT * FROM {view})')
    head = f"WITH {', '.join(heads)} " if heads else ""
    _SETTINGS_LOCK.acquire()
    before = {k: spark.conf.get(k) for k in _SETTINGS}
    try:
        # Double-quoted identifiers are part of ANSI mode; both only matter here.
        for k in _SETTINGS:
            spark.conf.set(k, "true")
        wrapped = f"SELECT * FROM (\n{text}\n)"
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(wrapped)
        _check(parsed, frozenset(t.lower() for t in tables) if tables else None)
        out = spark.sql(head + wrapped)
        _check_analysed(out._jdf.queryExecution().analyzed(), views)
        return out
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        _SETTINGS_LOCK.release()
        for view in views:  # the analysed query no longer needs the names
            spark.catalog.dropTempView(view)
