"""Snapshot tables: immutable Parquet fragments, delete sets and hash-chained manifests.

Layout of a table folder::

    schemas/0001.json           versions of the declared schema
    manifests/000000001.json    one immutable snapshot each, with the hash of its parent
    data/<uuid>.parquet         fragments
    deletes/<uuid>              rows (file_name, row_index) that are gone
    groups/<uuid>               per-group partial aggregates of fragments
    index/<name>/<uuid>         sorted (key, file_name) pairs of fragments

The current snapshot is the largest manifest, created exclusively: of two writers
that start from one snapshot, one fails with ``CommitConflict``.

Every fragment carries statistics and additive partial aggregates of its live
rows.  Row ids are ``base + position`` for inserted fragments, and a physical
column in fragments that updates and compaction write.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CommitConflict, NullViolation, SchemaMismatch, SnapshotNotFound
from .files import Files
from .types import schema_from_json, schema_to_json

ROW_ID = "__row_id"
#: Deleted rows up to this many are broadcast to the scan; more are joined by a shuffle.
BROADCAST_DELETES = 2_000_000
#: Groups of a fragment that partial aggregates are kept for, at most; others are scanned.
MAX_GROUPS = 4096
#: Rows that a fragment should hold.
TARGET_ROWS = 1_000_000
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
ORDERED = (*INTEGERS, *FLOATS, T.StringType, T.BooleanType, T.TimestampNTZType, T.DateType)


def encode(value):
    """A statistic as JSON."""
    if isinstance(value, decimal.Decimal):
        return {"dec": str(value)}
    if isinstance(value, dt.datetime):
        return {"ts": value.isoformat()}
    if isinstance(value, dt.date):
        return {"date": value.isoformat()}
    return value


def decode(value):
    if isinstance(value, dict):
        (kind, text), = value.items()
        return {"dec": decimal.Decimal, "ts": dt.datetime.fromisoformat, "date": dt.date.fromisoformat}[kind](text)
    return value


def stat_columns(schema: T.StructType, prefix: str = "") -> list:
    """Aggregates of every column that has statistics."""
    out = []
    for f in schema:
        c, n = F.col(f"`{f.name}`"), f.name
        if not isinstance(f.dataType, ORDERED):
            out.append(F.count(c).alias(f"{n}|n"))
            continue
        value = c
        if isinstance(f.dataType, FLOATS):  # NaN and infinities have no place in an order or a sum that is taken back
            finite = ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf"))
            value = F.when(finite, c)
            out.append(F.count_if(c.isNotNull() & ~finite).alias(f"{n}|odd"))
            out += [F.sum(c.cast("double")).alias(f"{n}|s"), F.sum(c.cast("double") * c.cast("double")).alias(f"{n}|q")]
        if isinstance(f.dataType, INTEGERS):
            wide = c.cast("decimal(19,0)")
            out += [F.sum(wide).alias(f"{n}|s"), F.expr(f"try_sum(cast(cast(`{n}` as decimal(19,0)) * cast(`{n}` as decimal(19,0)) as decimal(38,0)))").alias(f"{n}|q")]
        out += [F.count(c).alias(f"{n}|n"), F.min(value).alias(f"{n}|lo"), F.max(value).alias(f"{n}|hi")]
    return out


def by_file(df: DataFrame, schema: T.StructType, *more) -> list:
    """A row for each ``__file`` of ``df`` with the statistics of its columns, and more aggregates.

    For the least and greatest strings alone Spark would sort all rows by file; beside
    ``collect_list``, here of nothing, it keeps the few files in a hash table.
    """
    return df.groupBy("__file").agg(*more, *stat_columns(schema), F.collect_list(F.lit(None).cast("int")).alias("__none")).collect()


def unpack(row: dict) -> dict[str, dict]:
    out: dict[str, dict] = {}
    for k, v in row.items():
        if "|" in k:
            name, _, what = k.rpartition("|")
            out.setdefault(name, {})[what] = encode(v)
    return out


class Table:
    """One table folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files, self.path = spark, Files(spark, path), path.rstrip("/")
        self._manifests: dict[int, dict] = {}
        self._metas: dict[int, dict] = {}
        #: URI of the record that makes this table object's commits visible, and the snapshots it wrote.
        self.transaction: str | None = None
        self.written: list[int] = []

    # -- snapshots -------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, partition_by=(), sort_by=(), group_keys=()) -> Table:
        self = cls(spark, path)
        if self.files.exists("manifests"):
            raise CommitConflict(f"{path} holds a table")
        for c in (*partition_by, *sort_by, *group_keys):
            if c not in schema.names:
                raise SchemaMismatch(f"no column {c}")
        meta = {"version": 1, "fields": schema_to_json(schema), "partition_by": list(partition_by), "sort_by": list(sort_by), "group_keys": list(group_keys)}
        self.files.create("schemas/0001.json", json.dumps(meta, indent=1))
        self._write({"sequence": 0, "schema": 1, "fragments": [], "deletes": [], "indexes": [], "next_row_id": 0, "next_fragment": 1, "parent_hash": None})
        return self

    def _write(self, manifest: dict) -> dict:
        manifest = {k: v for k, v in manifest.items() if k != "transaction"} | {"committed_at": dt.datetime.now(dt.timezone.utc).isoformat()}
        if self.transaction:
            manifest["transaction"] = self.transaction
        name = f"manifests/{manifest['sequence']:09d}.json"
        if self.files.exists(name):
            raise CommitConflict(f"snapshot {manifest['sequence']} exists")
        try:
            self.files.create(name, json.dumps(manifest, sort_keys=True))
        except FileExistsError as e:
            raise CommitConflict(f"snapshot {manifest['sequence']} exists") from e
        self._manifests[manifest["sequence"]] = manifest
        if self.transaction:
            self.written.append(manifest["sequence"])
        return manifest

    def stored(self) -> list[int]:
        """Numbers of all manifests, those of open transactions too."""
        return [int(n[:9]) for n in self.files.names("manifests") if n[:9].isdigit() and n.endswith(".json")]

    def visible(self, sequence: int) -> bool:
        """Whether a snapshot belongs to no open transaction but this object's."""
        record = self.manifest(sequence).get("transaction")
        return record is None or record == self.transaction or self.files.there(record)

    def sequences(self) -> list[int]:
        """Numbers of the visible snapshots; only the last ones can belong to an open transaction."""
        found = self.stored()
        while found and not self.visible(found[-1]):
            self._manifests.pop(found.pop(), None)
        return found

    @property
    def sequence(self) -> int:
        found = self.sequences()
        if not found:
            raise SnapshotNotFound(self.path)
        return found[-1]

    def manifest(self, sequence: int | None = None) -> dict:
        sequence = self.sequence if sequence is None else sequence
        if sequence not in self._manifests:
            name = f"manifests/{sequence:09d}.json"
            if not self.files.exists(name):
                raise SnapshotNotFound(f"{self.path} has no snapshot {sequence}")
            self._manifests[sequence] = json.loads(self.files.read(name))
        return self._manifests[sequence]

    def hash_of(self, sequence: int) -> str:
        return hashlib.sha256(self.files.read(f"manifests/{sequence:09d}.json").encode()).hexdigest()

    def commit(self, base: dict, **changes) -> dict:
        """The next snapshot after ``base``."""
        return self._write(base | changes | {"sequence": base["sequence"] + 1, "parent_hash": self.hash_of(base["sequence"])})

    def meta(self, manifest: dict | None = None) -> dict:
        version = (manifest or self.manifest())["schema"]
        if version not in self._metas:  # schema files never change
            self._metas[version] = json.loads(self.files.read(f"schemas/{version:04d}.json"))
        return self._metas[version]

    def schema(self, manifest: dict | None = None) -> T.StructType:
        return schema_from_json(self.meta(manifest)["fields"])

    # -- reading ---------------------------------------------------------------

    def scan(self, manifest: dict, fragments: list[dict] | None = None, rows: bool = False, physical: bool = False) -> DataFrame:
        """Live rows of the fragments; with ``rows`` also id and address, with ``physical`` also file and position."""
        fragments = manifest["fragments"] if fragments is None else fragments
        schema = self.schema(manifest)
        open_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])  # fragments older than a column give nulls
        if not fragments:
            extra = {"_rowid": "bigint", "_rowaddr": "bigint"} if rows or physical else {}
            extra |= {"__file": "string", "__pos": "bigint"} if physical else {}
            empty = self.spark.createDataFrame([], open_schema)
            return empty.select("*", *(F.lit(None).cast(t).alias(n) for n, t in extra.items()))
        paths = [self.files.uri(f["path"]) for f in fragments]
        dirty = any(f["deleted"] for f in fragments)
        names = [F.col(f"`{n}`") for n in schema.names]
        if not (rows or physical or dirty):
            return self.spark.read.schema(open_schema).parquet(*paths)
        held = rows or physical
        df = self.spark.read.schema(T.StructType([*open_schema, T.StructField(ROW_ID, T.LongType(), True)]) if held else open_schema).parquet(*paths)
        df = df.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__pos"))
        if dirty:
            gone = self.spark.read.schema("file_name string, row_index bigint").parquet(*[self.files.uri(d) for d in manifest["deletes"]])
            marked = [f["path"].rsplit("/", 1)[-1] for f in fragments if f["deleted"]]
            if sum(f["deleted"] for f in fragments) <= BROADCAST_DELETES and len(marked) <= 10_000:
                # delete sets also hold rows of fragments that are gone or not read here
                gone = F.broadcast(gone.where(F.col("file_name").isin(marked)))
            df = df.join(gone, (F.col("__file") == F.col("file_name")) & (F.col("__pos") == F.col("row_index")), "left_anti")
        if held:
            known = [(f["path"].rsplit("/", 1)[-1], f["id"], f["base"]) for f in fragments]
            bases = F.broadcast(self.spark.createDataFrame(known, "__name string, __frag bigint, __base bigint"))  # one row a fragment of the manifest
            df = df.join(bases, F.col("__file") == F.col("__name"))
            names += [F.coalesce(F.col(ROW_ID), F.col("__base") + F.col("__pos")).alias("_rowid"), (F.shiftleft("__frag", 32) + F.col("__pos")).alias("_rowaddr")]
        if physical:
            names += [F.col("__file"), F.col("__pos")]
        return df.select(*names)

    def live(self, sequence: int | None = None, rows: bool = False) -> DataFrame:
        return self.scan(self.manifest(sequence), rows=rows)

    # -- writing fragments -----------------------------------------------------

    def conform(self, df: DataFrame, manifest: dict, extra: tuple[str, ...] = ()) -> DataFrame:
        """``df`` in declared order and types; other names, and nulls that aren't allowed, are errors."""
        schema = self.schema(manifest)
        missing, unknown = set(schema.names) - set(df.columns), set(df.columns) - set(schema.names) - set(extra)
        if missing or unknown:
            raise SchemaMismatch(f"missing columns {sorted(missing)}, unknown {sorted(unknown)}")
        out = []
        for f in schema:
            c = F.col(f"`{f.name}`").cast(f.dataType)
            if not f.nullable:
                c = F.coalesce(c, F.raise_error(F.lit(f"null in column {f.name}, which is declared not null")).cast(f.dataType))
            out.append(c.alias(f.name))
        return df.select(*out, *extra)

    def stage(self, df: DataFrame, manifest: dict, extra: tuple[str, ...] = (), sort_by: list[str] | None = None, few: bool = False) -> list[dict]:
        """Write ``df`` as fragments and describe them; nothing is committed.  ``few`` rows go to one file without a shuffle."""
        meta = self.meta(manifest)
        sort_by = meta["sort_by"] if sort_by is None else sort_by
        df = self.conform(df, manifest, extra)
        folder = f"staging/{uuid.uuid4().hex}"
        if meta["partition_by"]:  # a fragment holds one tuple of partition values
            keys = [f"`{c}`" for c in meta["partition_by"]]
            shadow = [F.col(k).alias(f"__p{i}") for i, k in enumerate(keys)]
            df = df.select("*", *shadow)
            df = df.coalesce(1) if few else df.repartition(*[F.col(k) for k in keys])
            df = df.sortWithinPartitions(*[f"__p{i}" for i in range(len(keys))], *sort_by)
            writer = df.write.option("maxRecordsPerFile", TARGET_ROWS).partitionBy(*[f"__p{i}" for i in range(len(keys))])
        else:
            if few:
                df = df.coalesce(1)
            if sort_by:
                df = (df if few else df.repartitionByRange(*[F.col(f"`{c}`") for c in sort_by])).sortWithinPartitions(*[F.col(f"`{c}`") for c in sort_by])
            writer = df.write.option("maxRecordsPerFile", TARGET_ROWS)
        try:
            writer.parquet(self.files.uri(folder))
        except Exception as e:
            self.files.delete(folder)
            if "declared not null" in str(e):
                raise NullViolation(str(e).split("declared not null")[0][-80:] + "declared not null") from None
            raise
        found = []
        for name in self._parts(folder):
            path = f"data/{uuid.uuid4().hex}.parquet"
            self.files.move(f"{folder}/{name}", path)
            found.append(path)
        self.files.delete(folder)
        return self.describe(found, manifest, bool(extra), few) if found else []

    def _parts(self, folder: str, inside: str = "") -> list[str]:
        out = []
        for n in self.files.names(f"{folder}/{inside}" if inside else folder):
            full = f"{inside}/{n}" if inside else n
            if n.startswith("__p"):
                out += self._parts(folder, full)
            elif n.endswith(".parquet"):
                out.append(full)
        return out

    def describe(self, paths: list[str], manifest: dict, with_ids: bool, few: bool = False) -> list[dict]:
        """Statistics and partials of new files, in one job over all of them; those of ``few`` rows have no groups, answers scan them."""
        schema, meta = self.schema(manifest), self.meta(manifest)
        open_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        held = T.StructType([*open_schema, T.StructField(ROW_ID, T.LongType(), True)]) if with_ids else open_schema
        df = self.spark.read.schema(held).parquet(*[self.files.uri(p) for p in paths]).select("*", F.col("_metadata.file_name").alias("__file"))
        df = df.coalesce(1) if few else df
        ends = [F.min(ROW_ID).alias("__low_id"), F.max(ROW_ID).alias("__high_id")] if with_ids else []
        rows = {r["__file"]: r.asDict() for r in by_file(df, schema, F.count(F.lit(1)).alias("rows"), *ends)}
        groups = None if few else self._group_partials(df, schema, meta)
        out, fid, rid = [], manifest["next_fragment"], manifest["next_row_id"]
        for path in paths:
            r = rows.get(path.rsplit("/", 1)[-1])
            if r is None:
                self.files.delete(path)  # an empty part
                continue
            ids = [r.pop("__low_id", None), r.pop("__high_id", None)]
            stats = unpack(r)
            part = {c: stats[c]["lo"] for c in meta["partition_by"]}
            out.append({"id": fid, "path": path, "rows": r["rows"], "deleted": 0, "base": None if with_ids else rid, "stats": stats, "partition": part, "groups": groups} | ({"ids": ids} if with_ids else {}))
            fid += 1
            rid += 0 if with_ids else r["rows"]
        return out

    def _group_partials(self, df: DataFrame, schema: T.StructType, meta: dict) -> str | None:
        if not meta["group_keys"]:
            return None
        parts = None
        for key in meta["group_keys"]:
            sums = [a for f in schema if isinstance(f.dataType, (*INTEGERS, *FLOATS)) for a in group_sums(f)]
            one = df.groupBy("__file", F.lit(key).alias("key"), F.col(f"`{key}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"), *sums)
            parts = one if parts is None else parts.unionByName(one)
        path = f"groups/{uuid.uuid4().hex}"
        parts.write.parquet(self.files.uri(path))
        return path

    # -- commits ---------------------------------------------------------------

    def insert(self, df: DataFrame, stream: dict | None = None) -> int:
        """Append rows; returns how many.  ``stream`` names the last batch of a checkpoint, in the same manifest."""
        base = self.manifest()
        streams = {"streams": base.get("streams", {}) | stream} if stream else {}
        fragments = self.stage(df, base)
        if not fragments:
            if streams:
                self.commit(base, **streams)
            return 0
        from ..operators.unique import check_inserted, extended

        check_inserted(self, base, fragments)
        n = sum(f["rows"] for f in fragments)
        indexes = extended(self, base, fragments)
        self.commit(base, fragments=[*base["fragments"], *fragments], next_fragment=fragments[-1]["id"] + 1, next_row_id=base["next_row_id"] + n, indexes=indexes, **streams)
        return n

    def insert_parquet(self, path: str) -> int:
        """Append a Parquet file as it is if its columns fit, else re-encode it."""
        base = self.manifest()
        source = self.spark.read.parquet(path)
        want = [(f.name, f.dataType) for f in self.schema(base)]
        if [(f.name, f.dataType) for f in source.schema] != want or self.meta(base)["partition_by"] or any(not f.nullable for f in self.schema(base)):
            return self.insert(source)
        target = f"data/{uuid.uuid4().hex}.parquet"
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        src = jvm.org.apache.hadoop.fs.Path(path)
        if src.getFileSystem(conf).getFileStatus(src).isDirectory():
            return self.insert(source)
        jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, self.files._fs, self.files._path(target), False, conf)
        fragments = self.describe([target], base, False)
        if not fragments:
            return 0
        from ..operators.unique import check_inserted

        check_inserted(self, base, fragments)
        n = fragments[0]["rows"]
        self.commit(base, fragments=[*base["fragments"], *fragments], next_fragment=fragments[-1]["id"] + 1, next_row_id=base["next_row_id"] + n)
        return n

    def replace(self, df: DataFrame) -> int:
        """Overwrite with ``df``; an empty one empties the table."""
        base = self.manifest()
        fragments = self.stage(df, base)
        from ..operators.unique import check_inserted

        check_inserted(self, base | {"fragments": [], "deletes": []}, fragments)
        n = sum(f["rows"] for f in fragments)
        self.commit(base, fragments=fragments, deletes=[], next_fragment=base["next_fragment"] + len(fragments), next_row_id=base["next_row_id"] + n)
        return n

    # -- schema evolution ------------------------------------------------------

    def add_column(self, name: str, kind: T.DataType) -> None:
        self._evolve(lambda fields: [*fields, T.StructField(name, kind, True)], name)

    def drop_column(self, name: str) -> None:
        self._evolve(lambda fields: [f for f in fields if f.name != name], name)

    def _evolve(self, change, name: str) -> None:
        base = self.manifest()
        meta, schema = self.meta(base), self.schema(base)
        if name in (*meta["partition_by"], *meta["sort_by"], *meta["group_keys"]) or any(i["column"] == name for i in base["indexes"]):
            raise SchemaMismatch(f"column {name} is a key")
        known = {f["name"]: f["id"] for f in meta["fields"]}
        fields = change(list(schema))
        kept = {f.name for f in fields}
        top = meta.get("last_id", max(known.values(), default=0))
        new = schema_to_json(T.StructType(fields), {k: v for k, v in known.items() if k in kept}, top + 1)
        version = meta["version"] + 1
        self.files.create(f"schemas/{version:04d}.json", json.dumps(meta | {"version": version, "fields": new, "last_id": max([top, *(f["id"] for f in new)])}, indent=1))
        self.commit(base, schema=version)

    # -- listings --------------------------------------------------------------

    def snapshots(self) -> DataFrame:
        rows = []
        for s in self.sequences():
            m = self.manifest(s)
            rows.append((s, m["committed_at"], sum(f["rows"] - f["deleted"] for f in m["fragments"]), len(m["fragments"]), m["parent_hash"]))
        return self.spark.createDataFrame(rows, "sequence bigint, committed_at string, rows bigint, fragments bigint, parent_hash string")

    def verify_history(self) -> list[str]:
        """Breaks of the hash chain; the oldest snapshot kept may name a parent that is gone."""
        found, seq = [], self.sequences()
        for before, s in zip(seq, seq[1:]):
            if self.manifest(s)["parent_hash"] != self.hash_of(before) and s == before + 1:
                found.append(f"snapshot {s} doesn't name the hash of {before}")
        return found


def group_sums(f: T.StructField) -> list:
    c, n = F.col(f"`{f.name}`"), f.name
    if isinstance(f.dataType, INTEGERS):
        wide = c.cast("decimal(19,0)")
        return [F.count(c).alias(f"{n}|n"), F.sum(wide).cast("decimal(38,0)").alias(f"{n}|s"), F.expr(f"try_sum(cast(cast(`{n}` as decimal(19,0)) * cast(`{n}` as decimal(19,0)) as decimal(38,0)))").alias(f"{n}|q")]
    wide = c.cast("double")
    return [F.count(c).alias(f"{n}|n"), F.sum(wide).alias(f"{n}|s"), F.sum(wide * wide).alias(f"{n}|q")]

