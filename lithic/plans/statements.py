"""SQL statements read with Spark's own parser.

The parser is reached through the session's JVM gateway.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..errors import Unsupported
from .catalyst import items, kind


@dataclass
class Statement:
    kind: str  # delete, update, merge or other
    table: str = ""
    alias: str | None = None
    condition: str | None = None
    assignments: list[tuple[str, str]] = field(default_factory=list)
    source: str = ""
    source_alias: str | None = None
    matched: list[tuple[str, list[tuple[str, str]] | None, str | None]] = field(default_factory=list)  # (what, values; None: by name, condition)
    missing: list[tuple[str, list[tuple[str, str]] | None, str | None]] = field(default_factory=list)


def parse_plan(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def _relation(plan) -> tuple[str, str | None]:
    """Name and alias of a plain table."""
    what = kind(plan)
    if what == "SubqueryAlias":
        name, _ = _relation(plan.child())
        return name, plan.alias()
    if what == "UnresolvedRelation":
        parts = items(plan.multipartIdentifier())
        if len(parts) != 1:
            raise Unsupported(f"qualified table name {'.'.join(parts)}")
        return parts[0].lower(), None
    raise Unsupported("the target must be one plain table")


def _assignments(seq) -> list[tuple[str, str]]:
    out = []
    for a in items(seq):
        key = a.key()
        if kind(key) != "UnresolvedAttribute":
            raise Unsupported("only plain columns can be set")
        out.append((items(key.nameParts())[-1], a.value().sql()))
    return out


def referenced_tables(spark: SparkSession, sql: str) -> list[str]:
    """Names of the relations a query reads, those of its own WITH clause left out."""
    text = parse_plan(spark, sql).toString()
    names = dict.fromkeys(n.lower() for n in re.findall(r"UnresolvedRelation \[([^\]]+)\]", text))
    own = {n.lower() for n in re.findall(r"(?i)(?:\bwith\s+(?:recursive\s+)?|,\s*)(\w+)\s*(?:\([^()]*\)\s*)?as\s*\(", sql)}
    return [n for n in names if n not in own]


def parse_statement(spark: SparkSession, sql: str) -> Statement:
    plan = parse_plan(spark, sql)
    what = kind(plan)
    if what == "DeleteFromTable":
        name, alias = _relation(plan.table())
        cond = plan.condition().sql()
        return Statement("delete", name, alias, None if cond.lower() == "true" else cond)
    if what == "UpdateTable":
        name, alias = _relation(plan.table())
        return Statement("update", name, alias, plan.condition().get().sql() if plan.condition().isDefined() else None, _assignments(plan.assignments()))
    if what == "MergeIntoTable":
        name, alias = _relation(plan.targetTable())
        if not plan.notMatchedBySourceActions().isEmpty():
            raise Unsupported("MERGE has no WHEN NOT MATCHED BY SOURCE")
        out = Statement("merge", name, alias, plan.mergeCondition().sql())
        m = re.search(r"(?is)\busing\s+(.*?)\s+(?:as\s+)?(\w+)\s+on\b", sql) or re.search(r"(?is)\busing\s+(\w+)()\s+on\b", sql)
        if not m:
            raise Unsupported("MERGE needs USING source [AS alias] ON")
        out.source, out.source_alias = m[1].strip(), m[2] or m[1].strip()
        arms = {"UpdateAction": "update", "UpdateStarAction": "update", "DeleteAction": "delete", "InsertAction": "insert", "InsertStarAction": "insert"}
        for actions, into in ((plan.matchedActions(), out.matched), (plan.notMatchedActions(), out.missing)):
            for a in items(actions):
                name = kind(a)
                values = _assignments(a.assignments()) if name in ("UpdateAction", "InsertAction") else None
                into.append((arms[name], values, a.condition().get().sql() if a.condition().isDefined() else None))
        return out
    return Statement("other")
