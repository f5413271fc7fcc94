"""Table types and their Spark counterparts.

A schema is the JSON of the open table format: ``{"type": "struct", "schema-id": n, "fields":
[{"id", "name", "required", "type", ...}]}``. Field ids travel to Parquet in the metadata of
Spark's struct fields.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import types as T

ID = "parquet.field.id"
MAX_ID = 2147483447  # greater ids are reserved
ROW_ID, LAST_SEQ = 2147483540, 2147483539
ROW_ID_NAME, LAST_SEQ_NAME = "_row_id", "_last_updated_sequence_number"
V3_TYPES = {"unknown", "variant", "timestamp_ns", "timestamptz_ns", "geometry", "geography"}

_SIMPLE = {
    "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(),
    "time": T.LongType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "timestamp_ns": T.LongType(), "timestamptz_ns": T.LongType(),
    "string": T.StringType(), "binary": T.BinaryType(), "uuid": T.BinaryType(), "unknown": T.NullType(), "geometry": T.BinaryType(), "geography": T.BinaryType(), "variant": T.VariantType(),
}


def kind(t) -> str:
    """Name of a type without its parameters."""
    if isinstance(t, dict):
        return t["type"]
    return re.match(r"[a-z_]+", t).group() if re.match(r"[a-z_]+", t) else t


def params(t: str) -> list[int]:
    return [int(x) for x in re.findall(r"\d+", t.partition("(")[2] or t.partition("[")[2])]


def is_primitive(t) -> bool:
    return not isinstance(t, dict)


def to_spark(t) -> T.DataType:
    """Spark type that carries values of a table type."""
    if isinstance(t, dict):
        if t["type"] == "struct":
            return struct(t["fields"])
        if t["type"] == "list":
            return T.ArrayType(to_spark(t["element"]), not t.get("element-required", False))
        if t["type"] == "map":
            return T.MapType(to_spark(t["key"]), to_spark(t["value"]), not t.get("value-required", False))
        raise ValueError(f"unknown type {t['type']}")
    k = kind(t)
    if k == "decimal":
        return T.DecimalType(*params(t))
    if k == "fixed":
        return T.BinaryType()
    if k not in _SIMPLE:
        raise ValueError(f"unknown type {t}")
    return _SIMPLE[k]


def struct(fields: list[dict], ids: bool = True) -> T.StructType:
    """Spark struct of table fields, with their ids for Parquet."""
    return T.StructType([T.StructField(f["name"], to_spark(f["type"]), not f.get("required", False), {ID: f["id"]} if ids else {}) for f in fields])


_FROM = [
    (T.BooleanType, "boolean"), (T.ByteType, "int"), (T.ShortType, "int"), (T.IntegerType, "int"), (T.LongType, "long"), (T.FloatType, "float"), (T.DoubleType, "double"),
    (T.DateType, "date"), (T.TimestampNTZType, "timestamp"), (T.TimestampType, "timestamptz"), (T.StringType, "string"), (T.BinaryType, "binary"), (T.VariantType, "variant"), (T.NullType, "unknown"),
]


def from_spark(t: T.DataType, ids: Iterator[int]):
    """Table type of a Spark type; nested fields take new ids."""
    if isinstance(t, T.DecimalType):
        return f"decimal({t.precision}, {t.scale})"
    if isinstance(t, T.StructType):
        return {"type": "struct", "fields": fields_of(t, ids)}
    if isinstance(t, T.ArrayType):
        i = next(ids)
        return {"type": "list", "element-id": i, "element": from_spark(t.elementType, ids), "element-required": not t.containsNull}
    if isinstance(t, T.MapType):
        k, v = next(ids), next(ids)
        return {"type": "map", "key-id": k, "key": from_spark(t.keyType, ids), "value-id": v, "value": from_spark(t.valueType, ids), "value-required": not t.valueContainsNull}
    for cls, name in _FROM:
        if isinstance(t, cls):
            return name
    raise ValueError(f"no table type for {t.simpleString()}")


def fields_of(s: T.StructType, ids: Iterator[int]) -> list[dict]:
    own = [(f, next(ids)) for f in s.fields]  # a level's own ids come before those below it
    return [{"id": i, "name": f.name, "required": not f.nullable, "type": from_spark(f.dataType, ids)} for f, i in own]


def schema_from(s: T.StructType, schema_id: int = 0) -> dict:
    """A table schema with new ids for a DataFrame's schema; all fields optional unless not nullable."""
    import itertools

    return {"type": "struct", "schema-id": schema_id, "fields": fields_of(s, itertools.count(1))}


def walk(fields: list[dict], path: str = "") -> Iterator[tuple[int, str, object, dict | None]]:
    """``(id, path, type, field)`` of every field, element, key and value."""
    for f in fields:
        here = f"{path}{f['name']}"
        yield f["id"], here, f["type"], f
        yield from _walk_type(f["type"], here)


def _walk_type(t, here: str):
    if isinstance(t, dict):
        if t["type"] == "struct":
            yield from walk(t["fields"], here + ".")
        elif t["type"] == "list":
            yield t["element-id"], here + ".element", t["element"], None
            yield from _walk_type(t["element"], here + ".element")
        elif t["type"] == "map":
            for part in ("key", "value"):
                yield t[f"{part}-id"], f"{here}.{part}", t[part], None
                yield from _walk_type(t[part], f"{here}.{part}")


def max_id(fields: list[dict]) -> int:
    return max((i for i, *_ in walk(fields)), default=0)


def validate(schema: dict, version: int) -> None:
    """Ids are unique and not reserved, names unique, and types allowed in the format version."""
    seen: dict[int, str] = {}
    for i, path, t, f in walk(schema["fields"]):
        if i > MAX_ID:
            raise ValueError(f"field id {i} of {path} is reserved")
        if i in seen:
            raise ValueError(f"field id {i} stands for {seen[i]} and {path}")
        seen[i] = path
        to_spark(t)
        k = kind(t)
        if version < 3 and k in V3_TYPES:
            raise ValueError(f"{path}: type {k} needs format version 3")
        if f is not None:
            for d in ("initial-default", "write-default"):
                if d in f and f[d] is not None:
                    if version < 3:
                        raise ValueError(f"{path}: {d} needs format version 3")
                    if k in ("unknown", "variant", "geometry", "geography"):
                        raise ValueError(f"{path}: {d} of type {k} must be null")
            if k == "unknown" and f.get("required"):
                raise ValueError(f"{path}: type unknown cannot be required")
            if k == "decimal" and not 0 <= params(t)[1] <= params(t)[0] <= 38:
                raise ValueError(f"{path}: bad decimal {t}")
    _unique_names(schema["fields"], "")


def _unique_names(fields: list[dict], path: str) -> None:
    names = [f["name"] for f in fields]
    if len(set(names)) != len(names):
        raise ValueError(f"repeated field name at {path or 'the top'}")


def sanitize(name: str) -> str:
    """Physical name of a column: characters that Avro names lack become ``_x`` and their hex."""
    out = []
    for i, c in enumerate(name):
        if c.isascii() and (c.isalpha() or c == "_" or i and c.isdigit()):
            out.append(c)
        elif c.isascii() and c.isdigit():
            out.append("_" + c)
        else:
            out.append(f"_x{ord(c):X}")
    return "".join(out)
