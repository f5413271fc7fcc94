"""Columns of files without field ids, found by the table's name mapping or by name at every depth."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import serde
from ..functions.types import is_primitive, sanitize, to_spark


def literal(v, t) -> Column:
    """A typed literal; values as manifests or defaults hold them."""
    return F.lit(None).cast(to_spark(t)) if v is None else F.lit(serde.from_json(v, t)).cast(to_spark(t))


def mapping(meta: dict) -> dict[int, list[str]]:
    """Names by field id of the table's name mapping, nested fields among them."""

    def walk(entries: list[dict]) -> Iterator[tuple[int, list[str]]]:
        for x in entries:
            if x.get("field-id") is not None:
                yield x["field-id"], x["names"]
            yield from walk(x.get("fields") or [])

    text = (meta.get("properties") or {}).get("schema.name-mapping.default")
    return dict(walk(json.loads(text))) if text else {}


def stored(f: dict, names: dict[int, list[str]], there) -> str | None:
    """The name of a field among those that a file has."""
    wanted = names[f["id"]] if f["id"] in names else [f["name"], sanitize(f["name"])]
    return next((n for n in wanted if n in there), None)


def reading(t, had: T.DataType | None, names: dict[int, list[str]]) -> T.DataType:
    """What to read of a file's type for a type of the table: its fields under the file's names."""
    if not is_primitive(t):
        if t["type"] == "struct" and isinstance(had, T.StructType):
            by = {x.name: x.dataType for x in had.fields}
            found = [(f, stored(f, names, by)) for f in t["fields"]]
            # Of a struct without any of the fields all is read, to tell which are null.
            return T.StructType([T.StructField(n, reading(f["type"], by[n], names)) for f, n in found if n is not None]) if any(n is not None for _, n in found) else had
        if t["type"] == "list" and isinstance(had, T.ArrayType):
            return T.ArrayType(reading(t["element"], had.elementType, names))
        if t["type"] == "map" and isinstance(had, T.MapType):
            return T.MapType(reading(t["key"], had.keyType, names), reading(t["value"], had.valueType, names))
    return to_spark(t)


def shaped(c: Column, t, had: T.DataType, names: dict[int, list[str]]) -> Column:
    """A column that was read as ``had`` in the table's type; fields that the file lacks are defaults or null."""
    if not is_primitive(t):
        if t["type"] == "struct" and isinstance(had, T.StructType):
            by = {x.name: x.dataType for x in had.fields}
            cols = []
            for f in t["fields"]:
                n = stored(f, names, by)
                cols.append((literal(f.get("initial-default"), f["type"]) if n is None else shaped(c.getField(n), f["type"], by[n], names)).alias(f["name"]))
            return F.when(c.isNotNull(), F.struct(*cols))
        if t["type"] == "list" and isinstance(had, T.ArrayType):
            return F.transform(c, lambda x: shaped(x, t["element"], had.elementType, names))
        if t["type"] == "map" and isinstance(had, T.MapType):
            return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(shaped(e["key"], t["key"], had.keyType, names), shaped(e["value"], t["value"], had.valueType, names))))
    return c.cast(to_spark(t))
