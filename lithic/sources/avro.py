"""Avro container files of a few records, written and read by the format's definition."""

from __future__ import annotations

import io
import json
import os

MAGIC = b"Obj\x01"


def _long(n: int) -> bytes:
    """Zigzag, then seven bits a byte."""
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n & ~0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode(schema, value) -> bytes:
    if isinstance(schema, list):  # null or one other type
        at = schema.index("null") if value is None else next(i for i, s in enumerate(schema) if s != "null")
        return _long(at) + encode(schema[at], value)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (list, dict)):
        return encode(kind, value)
    if kind == "null":
        return b""
    if kind == "boolean":
        return b"\x01" if value else b"\x00"
    if kind in ("int", "long"):
        return _long(value)
    if kind in ("string", "bytes"):
        raw = value.encode() if isinstance(value, str) else bytes(value)
        return _long(len(raw)) + raw
    if kind == "array":
        body = b"".join(encode(schema["items"], v) for v in value)
        return (_long(len(value)) + body if value else b"") + _long(0)
    if kind == "record":
        return b"".join(encode(f["type"], value.get(f["name"])) for f in schema["fields"])
    raise TypeError(f"no Avro type {kind!r} here")


def write(schema: dict, rows: list[dict], meta: dict[str, str]) -> bytes:
    """A whole container file."""
    head = {"avro.schema": json.dumps(schema), "avro.codec": "null", **meta}
    mark = os.urandom(16)
    out = MAGIC + _long(len(head)) + b"".join(encode("string", k) + encode("bytes", v.encode()) for k, v in head.items()) + _long(0) + mark
    body = b"".join(encode(schema, r) for r in rows)
    return out + (_long(len(rows)) + _long(len(body)) + body + mark if rows else b"")


def _read_long(f: io.BytesIO) -> int:
    n = shift = 0
    while True:
        b = f.read(1)[0]
        n |= (b & 0x7F) << shift
        if not b & 0x80:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def decode(schema, f: io.BytesIO):
    if isinstance(schema, list):
        return decode(schema[_read_long(f)], f)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (list, dict)):
        return decode(kind, f)
    if kind == "null":
        return None
    if kind == "boolean":
        return f.read(1) == b"\x01"
    if kind in ("int", "long"):
        return _read_long(f)
    if kind in ("string", "bytes"):
        raw = f.read(_read_long(f))
        return raw.decode() if kind == "string" else raw
    if kind == "array":
        out = []
        while n := _read_long(f):
            out += [decode(schema["items"], f) for _ in range(n)]
        return out
    if kind == "record":
        return {x["name"]: decode(x["type"], f) for x in schema["fields"]}
    raise TypeError(f"no Avro type {kind!r} here")


def read(data: bytes) -> tuple[dict[str, str], list]:
    """(metadata, records) of a container file without a codec."""
    f = io.BytesIO(data)
    if f.read(4) != MAGIC:
        raise ValueError("not an Avro file")
    meta = {}
    while n := _read_long(f):
        for _ in range(n):
            k = decode("string", f)
            meta[k] = decode("bytes", f).decode()
    mark, schema, out = f.read(16), json.loads(meta["avro.schema"]), []
    while f.tell() < len(data):
        n, _ = _read_long(f), _read_long(f)
        out += [decode(schema, f) for _ in range(n)]
        if f.read(16) != mark:
            raise ValueError("a block has no end mark")
    return meta, out
