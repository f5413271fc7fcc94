"""Bounding boxes of WKB geometries, for the bounds of geometry and geography columns."""

from __future__ import annotations

import json
import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7}


def positions(g: dict) -> list[list[float]]:
    """All positions of a GeoJSON geometry, collections included."""
    if g is None:
        return []
    if g["type"] == "GeometryCollection":
        return [p for x in g["geometries"] for p in positions(x)]
    out: list[list[float]] = []

    def go(c):
        if c and isinstance(c[0], (int, float)):
            out.append(list(c))
        else:
            for x in c:
                go(x)

    go(g["coordinates"])
    return out


def bbox(points: list[list[float]]) -> tuple[list[float], list[float]] | None:
    """Least and greatest of each axis, NaN left out axis by axis; None without x and y."""
    axes = max((len(p) for p in points), default=0)
    low, high = [], []
    for k in range(axes):
        v = [p[k] for p in points if len(p) > k and not math.isnan(p[k])]
        low.append(min(v, default=math.nan))
        high.append(max(v, default=math.nan))
    if axes < 2 or math.isnan(low[0]) or math.isnan(low[1]):
        return None
    return low, high


def to_wkb(g: dict) -> bytes:
    """Little-endian ISO WKB of a GeoJSON geometry."""
    dims = max((len(p) for p in positions(g)), default=2)

    def head(kind: str) -> bytes:
        return b"\x01" + struct.pack("<I", _KINDS[kind] + {2: 0, 3: 1000, 4: 3000}[dims])

    point = lambda p: struct.pack(f"<{dims}d", *(list(p) + [math.nan] * dims)[:dims])
    line = lambda c: struct.pack("<I", len(c)) + b"".join(map(point, c))
    rings = lambda c: struct.pack("<I", len(c)) + b"".join(map(line, c))
    t = g["type"]
    if t == "GeometryCollection":
        return head(t) + struct.pack("<I", len(g["geometries"])) + b"".join(map(to_wkb, g["geometries"]))
    c = g["coordinates"]
    if t == "Point":
        return head(t) + point(c or [math.nan] * dims)
    if t in ("LineString", "Polygon"):
        return head(t) + (line(c) if t == "LineString" else rings(c))
    single = t[5:]
    return head(t) + struct.pack("<I", len(c)) + b"".join(to_wkb({"type": single, "coordinates": x}) for x in c)


def wkb_positions(data: bytes) -> list[list[float]]:
    """Positions of a WKB geometry; M coordinates come fourth, with NaN for a missing Z."""
    out: list[list[float]] = []
    at = 0

    def geometry() -> None:
        nonlocal at
        end = "<" if data[at] == 1 else ">"
        (code,) = struct.unpack_from(end + "I", data, at + 1)
        at += 5
        flags, kind = divmod(code & 0xFFFF, 1000)
        z, m = flags in (1, 3) or bool(code & 0x80000000), flags in (2, 3) or bool(code & 0x40000000)
        dims = 2 + z + m

        def point() -> None:
            nonlocal at
            p = list(struct.unpack_from(f"{end}{dims}d", data, at))
            at += 8 * dims
            out.append([p[0], p[1], math.nan, p[2]] if m and not z else p)

        def count() -> int:
            nonlocal at
            (n,) = struct.unpack_from(end + "I", data, at)
            at += 4
            return n

        if kind == 1:
            point()
        elif kind == 2:
            for _ in range(count()):
                point()
        elif kind == 3:
            for _ in range(count()):
                for _ in range(count()):
                    point()
        else:
            for _ in range(count()):
                geometry()

    geometry()
    return out


def point_bytes(p: list[float]) -> bytes:
    """Bound of a geometry column: x, y, then z and m as far as they are there."""
    while len(p) > 2 and math.isnan(p[-1]):
        p = p[:-1]
    return struct.pack(f"<{len(p)}d", *p)


_BOX = T.ArrayType(T.DoubleType())


def _box(data):
    import pandas as pd

    def one(b):
        box = bbox(wkb_positions(bytes(b))) if b is not None else None
        return None if box is None else [x for side in box for x in (side + [math.nan] * 4)[:4]]

    return pd.Series([one(b) for b in data])


def bound_aggregates(c: Column) -> list[tuple[str, Column]]:
    """Aggregates of one geometry column: least and greatest of four axes."""
    box = F.pandas_udf(_box, _BOX)(c)
    out = []
    for k in range(4):
        out.append((f"gl{k}_", F.min(F.when(~F.isnan(box[k]), box[k]))))
        out.append((f"gu{k}_", F.max(F.when(~F.isnan(box[4 + k]), box[4 + k]))))
    return out


def bounds_of(row, i: int) -> tuple[bytes | None, bytes | None]:
    sides = [[math.nan if row[f"g{s}{k}_{i}"] is None else row[f"g{s}{k}_{i}"] for k in range(4)] for s in "lu"]
    if math.isnan(sides[0][0]) or math.isnan(sides[0][1]):
        return None, None
    return point_bytes(sides[0]), point_bytes(sides[1])


def from_geojson(text: str) -> bytes:
    return to_wkb(json.loads(text))
