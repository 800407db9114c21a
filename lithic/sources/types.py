"""The storage type grammar, as Spark types and back."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from ..errors import SchemaMismatch

#: Fixed names of the grammar; unsigned integers are widened, as Spark has none.
PLAIN = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "utf8": T.StringType(), "string": T.StringType(), "large_utf8": T.StringType(),
    "binary": T.BinaryType(), "large_binary": T.BinaryType(), "bool": T.BooleanType(), "timestamp": T.TimestampNTZType(), "timestamp[us]": T.TimestampNTZType(),
}
NAMES = {
    T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64",
    T.StringType: "utf8", T.BinaryType: "binary", T.BooleanType: "bool", T.TimestampNTZType: "timestamp[us]", T.TimestampType: "timestamp[us]",
}


def split_args(text: str) -> list[str]:
    """Parts between top-level commas."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(text[last:i].strip())
            last = i + 1
    return [*out, text[last:].strip()]


def parse_type(text: str) -> T.DataType:
    text = text.strip()
    if text in PLAIN:
        return PLAIN[text]
    if m := re.fullmatch(r"decimal128\((\d+),\s*(-?\d+)\)", text):
        return T.DecimalType(int(m[1]), int(m[2]))
    if re.fullmatch(r"fixed_size_binary\(\d+\)", text):
        return T.BinaryType()
    if m := re.fullmatch(r"(?:large_)?list<(.*)>", text):
        return T.ArrayType(parse_type(m[1]), True)
    if m := re.fullmatch(r"map<(.*)>", text):
        key, value = split_args(m[1])
        return T.MapType(parse_type(key), parse_type(value), True)
    if m := re.fullmatch(r"struct<(.*)>", text):
        return T.StructType([T.StructField(n.strip(), parse_type(t), True) for n, t in (x.split(":", 1) for x in split_args(m[1]))])
    raise SchemaMismatch(f"unknown type {text!r}")


def print_type(kind: T.DataType) -> str:
    if type(kind) in NAMES:
        return NAMES[type(kind)]
    if isinstance(kind, T.DecimalType):
        return f"decimal128({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"list<{print_type(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"map<{print_type(kind.keyType)},{print_type(kind.valueType)}>"
    if isinstance(kind, T.StructType):
        return "struct<" + ",".join(f"{f.name}:{print_type(f.dataType)}" for f in kind) + ">"
    raise SchemaMismatch(f"type {kind.simpleString()} can't be stored")


def schema_to_json(schema: T.StructType, known: dict[str, int] | None = None, first: int = 1) -> list[dict]:
    """Fields with stable positive ids; a known name keeps its id and dropped ids aren't used again."""
    out, used = [], dict(known or {})
    top = max([first - 1, *used.values()])
    for f in schema:
        if f.name not in used:
            top += 1
            used[f.name] = top
        out.append({"id": used[f.name], "name": f.name, "type": print_type(f.dataType), "nullable": f.nullable})
    return out


def schema_from_json(fields: list[dict]) -> T.StructType:
    return T.StructType([T.StructField(f["name"], parse_type(f["type"]), f["nullable"]) for f in fields])
