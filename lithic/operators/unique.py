"""Unique keys and point look-ups by sorted key files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Unsupported, UniqueViolation
from ..plans.pruning import indexed, surviving
from ..sources.table import Table, decode


def check_duplicates(keys: DataFrame, column: str) -> None:
    twice = keys.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").limit(1).collect()
    if twice:
        raise UniqueViolation(f"{column} = {twice[0][0]!r} would occur twice")


def check_inserted(table: Table, base: dict, fragments: list[dict], gone: DataFrame | None = None) -> None:
    """The unique keys of staged fragments against each other and the live rows but those of ``gone(__file, __pos)``."""
    for index in base["indexes"]:
        if not index["unique"] or not fragments:
            continue
        c = index["column"]
        new = table.scan(base, [f | {"deleted": 0} for f in fragments]).select(c)
        check_duplicates(new, c)
        bounds = [(decode(f["stats"][c]["lo"]), decode(f["stats"][c]["hi"])) for f in fragments if f["stats"].get(c, {}).get("lo") is not None]
        near = base["fragments"]
        if bounds:  # only fragments whose keys reach into the new ones' range can hold one of them
            near = surviving(near, [(c, ">=", min(b[0] for b in bounds)), (c, "<=", max(b[1] for b in bounds))])
        if near:
            live = table.scan(base, near, physical=True)
            if gone is not None:
                live = live.join(gone, ["__file", "__pos"], "left_anti")
            met = live.join(new.withColumnRenamed(c, "__k"), F.col(c) == F.col("__k"), "left_semi").limit(1).collect()
            if met:
                raise UniqueViolation(f"{c} = {met[0][c]!r} exists")


def create_index(table: Table, name: str, column: str, unique: bool = False) -> None:
    base = table.manifest()
    if any(i["name"] == name for i in base["indexes"]):
        raise Unsupported(f"index {name} exists")
    kind = dict(table.scan(base).dtypes).get(column)
    if kind not in ("bigint", "string", "int"):
        raise Unsupported("an index takes an integer or string column")
    if unique:
        check_duplicates(table.scan(base).select(column), column)
    index = {"name": name, "column": column, "unique": unique, "files": [], "covers": []}
    table.commit(base, indexes=[*base["indexes"], _extended(table, base, index)])


def drop_index(table: Table, name: str) -> None:
    base = table.manifest()
    table.commit(base, indexes=[i for i in base["indexes"] if i["name"] != name])


def _extended(table: Table, base: dict, index: dict, fresh: list[dict] | None = None) -> dict:
    """The index with key files for the fragments it doesn't cover yet; fragments never change, so old files stay right."""
    fresh = [f for f in (base["fragments"] if fresh is None else fresh) if f["id"] not in set(index["covers"])]
    if not fresh:
        return index
    path = f"index/{index['name']}/{uuid.uuid4().hex}"
    keys = table.scan(base, [f | {"deleted": 0} for f in fresh], physical=True).where(F.col(index["column"]).isNotNull())
    keys.select(F.col(index["column"]).alias("key"), F.col("__file").alias("file_name")).distinct().sort("key").write.parquet(table.files.uri(path))
    return index | {"files": [*index["files"], path], "covers": [*index["covers"], *(f["id"] for f in fresh)]}


def extended(table: Table, base: dict, fragments: list[dict]) -> list[dict]:
    """The table's indexes with the keys of new fragments, for the commit that adds those."""
    return [_extended(table, base, i, fragments) for i in base["indexes"]]


def refresh_indexes(table: Table) -> None:
    base = table.manifest()
    table.commit(base, indexes=[_extended(table, base, i) for i in base["indexes"]])


def lookup(table: Table, column: str, values: list, sequence: int | None = None) -> DataFrame:
    """Live rows whose column is one of the values, reading only fragments that can hold them."""
    base = table.manifest(sequence)
    found = [(column, "IN", [v for v in values if v is not None])]
    fragments = indexed(table, base, surviving(base["fragments"], found), found)
    return table.scan(base, fragments).where(F.col(column).isin(values))
