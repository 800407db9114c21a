"""Row-level DELETE, UPDATE and MERGE that never rewrite a fragment.

A mutation finds its rows once in the live view and writes their positions to a delete
set before anything else; new images, lost partials and counts are all made from that
set, so a condition on the clock or on another changing source can't mark other rows
than it patches.  New images go to patch fragments that keep row ids.  One manifest
makes all of it visible.

Up to ``SMALL`` matched rows are read with their columns in the same job, and what
follows works on those rows instead of scanning again.
"""

from __future__ import annotations

import decimal
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MergeConflict, SchemaMismatch, Unsupported
from ..plans.pruning import prune
from ..sources.table import FLOATS, INTEGERS, ORDERED, ROW_ID, Table, by_file, decode, encode, unpack
from .unique import check_inserted, extended

#: Share of deleted rows from which a fragment's statistics are computed anew instead of taken back.
RECOMPUTE_DENSITY = 0.10
#: Delete sets that a snapshot names before they are written together as one.
MERGE_DELETES = 16
#: Matched rows that are held on the driver, at most.
SMALL = 2_000


class Matched:
    """The rows of a mutation: marked in a delete set, and read back from there or, if few, held."""

    def __init__(self, table: Table, base: dict, rows: DataFrame, fragments: list[dict]):
        """``rows``: the columns of the table, ``_rowid``, ``_rowaddr``, ``__file`` and ``__pos`` of the matched ones."""
        self.table, self.base, self.fragments = table, base, fragments
        names = [*table.schema(base).names, "_rowid", "__file", "__pos"]
        rows = rows.select(*[f"`{n}`" for n in names])
        self.held = None
        few = rows.limit(SMALL + 1).collect()
        if len(few) <= SMALL:
            self.held = few
            schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
            self.rows = table.spark.createDataFrame(few, schema).coalesce(1)
        else:
            self.rows = rows
        self.path = f"deletes/{uuid.uuid4().hex}"
        marks = self.rows.select(F.col("__file").alias("file_name"), F.col("__pos").alias("row_index"))
        if self.held is None or few:
            marks.write.parquet(table.files.uri(self.path))
        if self.held is None:
            marks = table.spark.read.schema("file_name string, row_index bigint").parquet(table.files.uri(self.path))
            hit = {r[0] for r in marks.select("file_name").distinct().collect()}  # at most as many as there are fragments
            self.touched = [f for f in base["fragments"] if f["path"].rsplit("/", 1)[-1] in hit]
            self.marks = marks.select(F.col("file_name").alias("__file"), F.col("row_index").alias("__pos"))
            if self.touched:
                self.rows = table.scan(base, self.touched, physical=True).join(self.marks, ["__file", "__pos"], "left_semi").select(*[f"`{n}`" for n in names])
        else:
            hit = {r["__file"] for r in few}
            self.touched = [f for f in base["fragments"] if f["path"].rsplit("/", 1)[-1] in hit]
            self.marks = self.rows.select("__file", "__pos")

    def lost(self) -> dict[str, dict]:
        """File name to row count and partials of the matched rows."""
        schema = self.table.schema(self.base)
        if self.held is None:
            got = by_file(self.rows, schema, F.count(F.lit(1)).alias("rows"))
            return {r["__file"]: {"rows": r["rows"], "stats": unpack(r.asDict())} for r in got}
        out = {}
        for f in self.touched:
            name = f["path"].rsplit("/", 1)[-1]
            rows = [r for r in self.held if r["__file"] == name]
            out[name] = {"rows": len(rows), "stats": {c.name: _partials(c, [r[c.name] for r in rows]) for c in schema}}
        return out


def _partials(f: T.StructField, values: list) -> dict:
    """What ``stat_columns`` gives, of a few values."""
    values = [v for v in values if v is not None]
    out: dict = {"n": len(values)}
    if not isinstance(f.dataType, ORDERED):
        return out
    if isinstance(f.dataType, FLOATS):
        plain = [v for v in values if math.isfinite(v)]
        out["odd"], values = len(values) - len(plain), plain
        out |= {"s": None, "q": None}  # never taken back
    elif isinstance(f.dataType, INTEGERS):
        square = sum(v * v for v in values)
        out |= {"s": encode(decimal.Decimal(sum(values))) if values else None, "q": encode(decimal.Decimal(square)) if values and square < 10**38 else None}
    return out | {"lo": encode(min(values, default=None)), "hi": encode(max(values, default=None))}


def _retracted(table: Table, base: dict, matched: Matched) -> tuple[list[dict], int]:
    """The fragments without the matched rows.

    Counts and integer sums are taken back.  Float sums, which rounding keeps from being
    taken back, are left out, and extremes that a matched row holds become loose bounds;
    answers scan such a fragment.  A fragment with many dead rows gets all of them anew.
    """
    schema = table.schema(base)
    lost = matched.lost()
    again, out, total = [], {}, 0
    for f in matched.touched:
        name = f["path"].rsplit("/", 1)[-1]
        n, dead = lost[name]["rows"], lost[name]["stats"]
        total += n
        stats = {}
        for c, s in f["stats"].items():
            d = dead.get(c, {"n": 0})
            new = {"n": s["n"] - d["n"]}
            if "odd" in s:
                new["odd"] = s["odd"] - d["odd"]
            if "lo" in s:
                new |= {"lo": s["lo"], "hi": s["hi"]}
                if s.get("loose") or d.get("lo") is not None and (d["lo"] == s["lo"] or d["hi"] == s["hi"]):
                    new["loose"] = True
            if "s" in s:
                if isinstance(schema[c].dataType, FLOATS):
                    new |= {"s": s["s"], "q": s["q"]} if not d["n"] else {"s": None, "q": None}
                else:
                    new |= {k: encode((decode(s[k]) or 0) - (decode(d.get(k)) or 0)) if new["n"] and s[k] is not None and (d["n"] == 0 or d.get(k) is not None) else None for k in ("s", "q")}
            stats[c] = new
        out[f["id"]] = f | {"deleted": f["deleted"] + n, "stats": stats, "groups": None}
        if f["deleted"] + n == f["rows"]:
            out[f["id"]]["gone"] = True
        elif (f["deleted"] + n) / f["rows"] >= RECOMPUTE_DENSITY:
            again.append(f["id"])
    fragments = [out.get(f["id"], f) for f in base["fragments"]]
    fragments = [f for f in fragments if not f.get("gone")]
    if again:
        trial = base | {"fragments": fragments, "deletes": [*base["deletes"], matched.path]}
        live = table.scan(trial, [f for f in fragments if f["id"] in set(again)], physical=True)
        fresh = {r["__file"]: unpack(r.asDict()) for r in by_file(live, schema)}
        fragments = [f | {"stats": fresh.get(f["path"].rsplit("/", 1)[-1], f["stats"])} if f["id"] in set(again) else f for f in fragments]
    return fragments, total


def _commit(table: Table, base: dict, matched: Matched | None, patches: list[dict] = (), inserts: list[dict] = (), stream: dict | None = None) -> int:
    fragments, deletes, total = base["fragments"], base["deletes"], 0
    if matched is not None and matched.touched:
        check_inserted(table, base, [*patches, *inserts], matched.marks)
        fragments, total = _retracted(table, base, matched)
        deletes = [*deletes, matched.path]
    elif inserts:
        check_inserted(table, base, [*inserts])
    new = [*patches, *inserts]
    if not total and not new and not stream:
        return 0
    added = sum(f["rows"] for f in inserts)
    top = max([base["next_fragment"] - 1, *(f["id"] for f in new)]) + 1
    dirty = [f for f in fragments if f["deleted"]]
    if len(deletes) > MERGE_DELETES and dirty:
        deletes = [merged_deletes(table, deletes, dirty)]
    extra = {"streams": base.get("streams", {}) | stream} if stream else {}
    table.commit(base, fragments=[*fragments, *new], deletes=deletes if dirty else [], next_fragment=top, next_row_id=base["next_row_id"] + added, indexes=extended(table, base, new), **extra)
    return total


def merged_deletes(table: Table, deletes: list[str], dirty: list[dict]) -> str:
    """One delete set in place of many, without rows of files that no fragment names any more."""
    path = f"deletes/{uuid.uuid4().hex}"
    rows = table.spark.read.schema("file_name string, row_index bigint").parquet(*[table.files.uri(d) for d in deletes])
    if len(dirty) <= 10_000:
        rows = rows.where(F.col("file_name").isin([f["path"].rsplit("/", 1)[-1] for f in dirty]))
    if sum(f["deleted"] for f in dirty) <= 1_000_000:
        rows = rows.coalesce(1)
    rows.write.parquet(table.files.uri(path))
    return path


def _matched(table: Table, base: dict, condition: str | None, alias: str | None, name: str) -> Matched:
    fragments = prune(table, base, condition, alias or name)
    live = table.scan(base, fragments, physical=True).alias(alias or name)
    return Matched(table, base, live.where(F.expr(condition)) if condition else live, fragments)


def delete(table: Table, condition: str | None = None, name: str = "t", alias: str | None = None) -> int:
    """Delete the rows of the condition, or all; returns how many."""
    base = table.manifest()
    if not condition:
        n = sum(f["rows"] - f["deleted"] for f in base["fragments"])
        if n:
            table.commit(base, fragments=[], deletes=[])
        return n
    return _commit(table, base, _matched(table, base, condition, alias, name))


def update(table: Table, assignments: list[tuple[str, str]], condition: str | None = None, name: str = "t", alias: str | None = None) -> int:
    """Set columns to expressions over the old row; returns how many rows."""
    base = table.manifest()
    schema = table.schema(base)
    folded = {n.lower(): n for n in schema.names}
    for c, _ in assignments:
        if c.lower() not in folded:
            raise SchemaMismatch(f"no column {c}")
    new = {folded[c.lower()]: e for c, e in assignments}
    matched = _matched(table, base, condition, alias, name)
    if not matched.touched:
        return 0
    rows = matched.rows.alias(alias or name)
    images = rows.select(*[(F.expr(new[f.name]).cast(f.dataType) if f.name in new else F.col(f"`{f.name}`")).alias(f.name) for f in schema], F.col("_rowid").alias(ROW_ID))
    patches = table.stage(images, base, (ROW_ID,), few=matched.held is not None)
    return _commit(table, base, matched, patches)


@dataclass
class Action:
    """An arm of MERGE: ``update`` (values by column; None takes the source's), ``delete`` or ``insert``, where a condition holds."""

    what: str
    values: dict[str, str] | None = None
    condition: str | None = None


def merge(
    table: Table,
    source: DataFrame,
    key: str,
    source_key: str | None = None,
    matched: list[Action] | None = None,
    missing: list[Action] | None = None,
    target_alias: str = "t",
    source_alias: str = "s",
    stream: dict | None = None,
) -> tuple[int, int, int]:
    """MERGE on a unique key; (updated, inserted, deleted).

    Rows of ``source`` whose key is live take the first arm of ``matched`` whose condition
    holds, others the first of ``missing``; without arms matched rows are updated and others
    inserted, columns taken by name.  The source is evaluated once and kept in the table's
    staging folder until the commit.
    """
    base = table.manifest()
    if not any(i["unique"] and i["column"] == key for i in base["indexes"]):
        raise Unsupported(f"MERGE needs a unique index on {key}")
    schema, source_key = table.schema(base), source_key or key
    matched = [Action("update")] if matched is None else matched
    missing = [Action("insert")] if missing is None else missing
    by_name = {n: f"{source_alias}.`{n}`" for n in source.columns if n in schema.names}
    for a in (*matched, *missing):
        if unknown := set(a.values or ()) - set(schema.names):
            raise SchemaMismatch(f"no column {sorted(unknown)}")
    held = f"staging/{uuid.uuid4().hex}"
    source.write.parquet(table.files.uri(held))
    try:
        source = table.spark.read.schema(source.schema).parquet(table.files.uri(held))
        k = F.col(f"`{source_key}`")
        counts = source.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("k is null or n > 1").limit(1).collect()
        if counts:
            raise MergeConflict("the source has a null key" if counts[0]["k"] is None else f"the source has key {counts[0]['k']!r} twice")
        live, src = table.scan(base, physical=True).alias(target_alias), source.alias(source_alias)
        on = F.col(f"{target_alias}.`{key}`") == F.col(f"{source_alias}.`{source_key}`")

        def chosen(arms: list[Action]):
            """Number of the first arm whose condition holds."""
            out = F.lit(None).cast("int")
            for n, a in reversed(list(enumerate(arms))):
                out = F.when(F.expr(a.condition) if a.condition else F.lit(True), F.lit(n)).otherwise(out)
            return out

        hit, patches, gone = None, [], 0
        if matched:
            # the arm is chosen once, with the row that it is chosen for
            both = live.join(src, on).withColumn("__arm", chosen(matched)).where("__arm is not null")
            images = []
            for f in schema:
                e = F.col(f"{target_alias}.`{f.name}`")
                for n, a in enumerate(matched):
                    new = by_name if a.values is None else a.values
                    if a.what == "update" and f.name in new:
                        e = F.when(F.col("__arm") == n, F.expr(new[f.name]).cast(f.dataType)).otherwise(e)
                images.append(e.alias(f.name))
            doomed = [n for n, a in enumerate(matched) if a.what == "delete"]
            picked = both.select(*images, F.col(f"{target_alias}._rowid").alias(ROW_ID), F.col("__file").alias("__f"), F.col("__pos").alias("__p"), F.col("__arm").isin(doomed).alias("__gone"))
            side = f"staging/{uuid.uuid4().hex}"
            picked.write.parquet(table.files.uri(side))
            picked = table.spark.read.schema(picked.schema).parquet(table.files.uri(side))
            gone = picked.where("__gone").count() if doomed else 0
            patches = table.stage(picked.where("not __gone").drop("__f", "__p", "__gone"), base, (ROW_ID,))
            if patches or gone:
                marked = table.scan(base, physical=True).join(picked.select(F.col("__f").alias("__file"), F.col("__p").alias("__pos")), ["__file", "__pos"], "left_semi")
                hit = Matched(table, base, marked, base["fragments"])
            table.files.delete(side)
        inserts: list[dict] = []
        if missing:
            fresh = src.join(live.select(F.col(f"{target_alias}.`{key}`").alias("__k")), F.col(f"{source_alias}.`{source_key}`") == F.col("__k"), "left_anti")
            fresh = fresh.withColumn("__arm", chosen(missing)).where("__arm is not null")
            rows = []
            for f in schema:
                e = F.lit(None).cast(f.dataType)
                for n, a in enumerate(missing):
                    new = by_name if a.values is None else a.values
                    if f.name in new:
                        e = F.when(F.col("__arm") == n, F.expr(new[f.name]).cast(f.dataType)).otherwise(e)
                rows.append(e.alias(f.name))
            inserts = table.stage(fresh.select(*rows), base | {"next_fragment": base["next_fragment"] + len(patches)})
        _commit(table, base, hit, patches, inserts, stream)
        return sum(f["rows"] for f in patches), sum(f["rows"] for f in inserts), gone
    finally:
        table.files.delete(held)
