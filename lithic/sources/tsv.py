"""Tab-separated text: a header row, empty fields for null, backslash escapes, nested values as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaMismatch

NESTED = (T.ArrayType, T.MapType, T.StructType)


def _unescaped(c):
    out = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for mark, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
        out = F.replace(out, F.lit(mark), F.lit(char))
    return F.replace(out, F.lit("\x00"), F.lit("\\"))


def _escaped(c):
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
        out = F.replace(out, F.lit(char), F.lit(mark))
    return out


def infer(rows: list[list[str]], width: int) -> list[str]:
    """Narrowest of boolean, bigint, double, timestamp_ntz and string that fits each column of sample rows."""
    import datetime as dt

    def fits(kind: str, v: str) -> bool:
        try:
            if kind == "boolean":
                return v in ("true", "false")
            if kind == "bigint":
                return -(1 << 63) <= int(v) < 1 << 63
            if kind == "double":
                return float(v) is not None
            return kind == "string" or bool(dt.datetime.fromisoformat(v))
        except ValueError:
            return False

    out = []
    for i in range(width):
        seen = [r[i] for r in rows if i < len(r) and r[i] != ""]
        out.append(next(k for k in ("boolean", "bigint", "double", "timestamp_ntz", "string") if (seen or k == "string") and all(fits(k, v) for v in seen)))
    return out


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A file or folder; without a schema types come from the first 100 rows."""
    lines = spark.read.text(path)
    first = lines.first()
    if first is None:
        raise SchemaMismatch(f"{path} has no header")
    header = first[0].split("\t")
    if len(set(header)) != len(header):
        raise SchemaMismatch("duplicate header")
    # each file has the header once; further lines that equal it are rows
    like = lines.where(F.col("value") == first[0]).groupBy(F.col("_metadata.file_path").alias("f"), "value").agg(F.count(F.lit(1)).alias("n"))
    body = lines.where(F.col("value") != first[0]).union(like.where("n > 1").select("f", F.explode(F.sequence(F.lit(2), F.col("n"))), "value").select("value"))
    if schema is None:
        sample = [r[0].split("\t") for r in body.limit(100).collect()]
        schema = T.StructType([T.StructField(n, T._parse_datatype_string(k) if hasattr(T, "_parse_datatype_string") else spark.createDataFrame([], f"c {k}").schema[0].dataType, True) for n, k in zip(header, infer(sample, len(header)))])
    if missing := [f.name for f in schema if f.name not in header]:
        raise SchemaMismatch(f"header lacks {missing}")
    cells = F.split("value", "\t", -1)
    out = []
    for f in schema:
        c = F.nullif(cells[header.index(f.name)], F.lit(""))
        text = _unescaped(c)
        value = F.from_json(text, f.dataType) if isinstance(f.dataType, NESTED) else F.unbase64(text) if isinstance(f.dataType, T.BinaryType) else text.cast(f.dataType)
        out.append(value.alias(f.name))
    return body.select(*out)


def write_tsv(df: DataFrame, path: str) -> None:
    """A folder of parts with a header each."""
    cells = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        text = F.to_json(c) if isinstance(f.dataType, NESTED) else F.base64(c) if isinstance(f.dataType, T.BinaryType) else c.cast("string")
        cells.append(F.coalesce(_escaped(text), F.lit("")).alias(f.name))
    df.select(*cells).write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("escape", "").csv(path)
