"""Command line: ``python -m lithic.cli DATABASE COMMAND …``."""

from __future__ import annotations

import argparse
import sys

from .database import open_database
from .operators import unique
from .sources import maintenance
from .sources.formats import read_arrow, to_csv_text, to_json_lines


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lithic")
    p.add_argument("database")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, v in options.items():
            c.add_argument(f"--{k}", **v)

    add("create", "table", "schema", partition={"default": ""}, sort={"default": ""}, groups={"default": ""})
    add("insert", "table", "file")
    add("query", "sql", format={"choices": ["json", "csv"], "default": "json"}, snapshot={"type": int})
    add("mutate", "sql")
    add("tables")
    add("drop", "table")
    add("snapshots", "table")
    add("index", "table", "name", "column", unique={"action": "store_true"})
    add("create-view", "name", "sql")
    add("refresh-view", "name")
    add("import-tsv", "table", "file")
    add("export-tsv", "table", "file")
    add("compact", "table", sort={"default": ""})
    add("optimize", "table", sort={"default": ""})
    add("gc", "table", keep={"type": int, "default": 3})
    add("check", "table")
    add("statistics", "table")
    add("export-iceberg", "table", "folder")
    add("doctor", "table", repair={"action": "store_true"})
    return p


def run(spark, argv: list[str], out=print) -> int:
    a = parser().parse_args(argv)
    db = open_database(spark, a.database, snapshot=getattr(a, "snapshot", None))
    names = lambda text: [x for x in text.split(",") if x]
    match a.command:
        case "create":
            db.create_table(a.table, a.schema, names(a.partition), names(a.sort), names(a.groups))
        case "insert":
            t = db.table(a.table)
            out(t.insert(read_arrow(spark, a.file)) if a.file.endswith((".arrow", ".ipc")) else t.insert_parquet(a.file))
        case "query":
            df = db.sql(a.sql)
            out("\n".join(to_json_lines(df)) if a.format == "json" else to_csv_text(df))
        case "mutate":
            out(db.mutate(a.sql))
        case "tables":
            out("\n".join(db.tables()))
        case "drop":
            db.drop_table(a.table)
        case "snapshots":
            out("\n".join(to_json_lines(db.snapshots(a.table))))
        case "statistics":
            out("\n".join(to_json_lines(db.statistics(a.table))))
        case "export-iceberg":
            out(db.export_iceberg(a.table, a.folder))
        case "index":
            unique.create_index(db.table(a.table), a.name, a.column, a.unique)
        case "create-view":
            db.create_view(a.name, a.sql)
        case "refresh-view":
            out(db.refresh_view(a.name))
        case "import-tsv":
            out(db.import_tsv(a.table, a.file))
        case "export-tsv":
            db.export_tsv(a.table, a.file)
        case "compact":
            out(maintenance.compact(db.table(a.table), names(a.sort) or None))
        case "optimize":
            db.optimize(a.table, names(a.sort) or None)
        case "gc":
            out("\n".join(maintenance.gc(db.table(a.table), a.keep)))
        case "check" | "doctor":
            t = db.table(a.table)
            found = maintenance.check(t) if a.command == "check" else maintenance.doctor(t, a.repair)
            out("\n".join(found) or "nothing found")
            return int(bool(found) and not getattr(a, "repair", False))
    return 0


def main() -> None:
    from pyspark.sql import SparkSession

    sys.exit(run(SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate(), sys.argv[1:]))


if __name__ == "__main__":
    main()
