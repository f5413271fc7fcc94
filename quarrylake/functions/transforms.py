"""Partition and sort transforms: parsing, on Python values, and as Spark columns."""

from __future__ import annotations

import re
import struct
from decimal import Decimal
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .serde import days, decimal_bytes, micros, unscaled
from .types import kind, params, to_spark

_TIMES = ("timestamp", "timestamptz", "timestamp_ns", "timestamptz_ns")
_SOURCES = {
    "year": ("date", *_TIMES), "month": ("date", *_TIMES), "day": ("date", *_TIMES), "hour": _TIMES,
    "bucket": ("int", "long", "decimal", "date", "time", *_TIMES, "string", "uuid", "fixed", "binary"),
    "truncate": ("int", "long", "decimal", "string", "binary"),
}
MASK = 0xFFFFFFFF
#: Values that are hashed one by one rather than together.
FEW = 16


def parse(name: str) -> tuple[str, int | None]:
    """``bucket[16]`` as ("bucket", 16)."""
    m = re.fullmatch(r"(bucket|truncate)\[(\d+)\]", name)
    if m:
        if int(m[2]) <= 0:
            raise ValueError(f"{name}: the parameter must be positive")
        return m[1], int(m[2])
    if name in ("identity", "void", "year", "month", "day", "hour"):
        return name, None
    return "unknown", None


def validate(name: str, source) -> None:
    """Whether the transform can write values of the source type."""
    k, t = parse(name)[0], kind(source)
    if k == "unknown":
        raise ValueError(f"transform {name} cannot be written")
    if isinstance(source, dict) or k == "identity" and t in ("variant", "geometry", "geography"):
        raise ValueError(f"{name} cannot take {t}")
    if k in _SOURCES and t not in _SOURCES[k]:
        raise ValueError(f"{name} cannot take {t}")


def result_type(name: str, source: str) -> str:
    k = parse(name)[0]
    if k in ("identity", "truncate"):
        return source
    return "date" if k == "day" else "int"


def murmur3(data: bytes, h: int = 0, start: int = 0) -> int:
    """32-bit Murmur3 (x86, seed 0) as a signed integer; ``h`` is the state after the first
    ``start`` bytes, a multiple of four."""
    n = len(data)

    def scramble(k: int) -> int:
        k = k * 0xCC9E2D51 & MASK
        k = (k << 15 | k >> 17) & MASK
        return k * 0x1B873593 & MASK

    for i in range(start, n - n % 4, 4):
        h ^= scramble(int.from_bytes(data[i : i + 4], "little"))
        h = (h << 13 | h >> 19) & MASK
        h = (h * 5 + 0xE6546B64) & MASK
    if n % 4:
        h ^= scramble(int.from_bytes(data[n - n % 4 :], "little"))
    h ^= n
    for shift, mult in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> shift
        h = h * mult & MASK
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def murmur3_many(values: list[bytes]) -> np.ndarray:
    """Murmur3 of many values, signed; each step takes the next word of all that have one.

    Values run by length, so those still going are a front part of the arrays. Once they are
    fewer than FEW, each is finished alone, as a step over few values costs more than it saves.
    """
    length = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(-length, kind="stable")
    length = length[order]
    words = np.frombuffer(b"".join(values[i] + bytes(-len(values[i]) % 4) for i in order), "<u4")
    whole, start = length // 4, np.cumsum((length + 3) // 4) - (length + 3) // 4
    h = np.zeros(len(values), np.uint32)

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return x << np.uint32(n) | x >> np.uint32(32 - n)

    def scrambled(k: np.ndarray) -> np.ndarray:
        return turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    at = 0
    while (going := int(np.searchsorted(-whole, -at))) >= FEW:
        mixed = h[:going] ^ scrambled(words[start[:going] + at])
        h[:going] = turned(mixed, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        at += 1
    long = [murmur3(values[i], int(h[k]), 4 * at) for k, i in enumerate(order[:going])]
    tail = np.flatnonzero(length % 4)
    h[tail] ^= scrambled(words[start[tail] + whole[tail]])
    h ^= length.astype(np.uint32)
    for shift, mult in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(mult)
    h ^= h >> np.uint32(16)
    out = np.empty(len(values), np.int32)
    out[order] = h.view(np.int32)
    out[order[:going]] = long
    return out


def hash_bytes(v, t: str) -> bytes:
    k = kind(t)
    if k in ("int", "long", "time"):
        return struct.pack("<q", v)
    if k == "date":
        return struct.pack("<q", days(v))
    if k in ("timestamp", "timestamptz"):
        return struct.pack("<q", micros(v))
    if k.endswith("_ns"):
        return struct.pack("<q", v // 1000)
    if k == "decimal":
        return decimal_bytes(unscaled(v, params(t)[1]))
    if k == "uuid" and isinstance(v, str):
        import uuid

        return uuid.UUID(v).bytes
    return v.encode() if isinstance(v, str) else bytes(v)


def apply(name: str, v, t: str):
    """The transform of a Python value; day gives days since 1970."""
    k, p = parse(name)
    if v is None or k == "void":
        return None
    if k == "identity":
        return v
    if k == "bucket":
        return (murmur3(hash_bytes(v, t)) & 0x7FFFFFFF) % p
    if k == "truncate":
        if kind(t) == "decimal":
            n, scale = unscaled(v, params(t)[1]), params(t)[1]
            return Decimal(n - n % p).scaleb(-scale)
        return v - v % p if isinstance(v, int) else v[:p]
    if k == "unknown":
        raise ValueError(f"unknown transform {name}")
    us = None if kind(t) == "date" else (v // 1000 if kind(t).endswith("_ns") else micros(v))
    day = days(v) if us is None else us // 86_400_000_000
    if k == "day":
        return day
    if k == "hour":
        return us // 3_600_000_000
    import datetime as dt

    y, m = _civil(day) if not -719162 <= day <= 2932896 else ((dt.date(1970, 1, 1) + dt.timedelta(day)).year, (dt.date(1970, 1, 1) + dt.timedelta(day)).month)
    return y - 1970 if k == "year" else (y - 1970) * 12 + m - 1


def _civil(day: int) -> tuple[int, int]:
    """Proleptic Gregorian (year, month) of days since 1970, beyond Python's calendar."""
    z = day + 719468
    era, doe = divmod(z, 146097)
    yoe = (doe - doe // 1460 + doe // 36524 - doe // 146096) // 365
    mp = (5 * (doe - (365 * yoe + yoe // 4 - yoe // 100)) + 2) // 153
    m = mp + 3 if mp < 10 else mp - 9
    return yoe + era * 400 + (m <= 2), m


def _mul32(a: Column, b: int) -> Column:
    """Product of unsigned 32-bit values without a 64-bit overflow."""
    high = (a * F.lit(b >> 16)).bitwiseAND(F.lit(0xFFFF))
    return (F.shiftleft(high, 16) + a * F.lit(b & 0xFFFF)).bitwiseAND(F.lit(MASK))


def _rot32(a: Column, n: int) -> Column:
    return (F.shiftleft(a, n).bitwiseOR(F.shiftrightunsigned(a, 32 - n))).bitwiseAND(F.lit(MASK))


def _once(value: Column, body) -> Column:
    """``body`` of a value that the plan holds once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def murmur3_long(c: Column) -> Column:
    """Murmur3 of a long's eight bytes, unsigned, in built-in arithmetic.

    Each value that is used twice is bound once; spelled out, the expression would double with
    every step and take far longer to compile than to run.
    """

    def times(a: Column, b: int) -> Column:
        return _once(a, lambda x: _mul32(x, b))

    def turned(a: Column, n: int) -> Column:
        return _once(a, lambda x: _rot32(x, n))

    def step(h: Column, word: Column) -> Column:
        k = times(turned(times(word, 0xCC9E2D51), 15), 0x1B873593)
        return (turned(h.bitwiseXOR(k), 13) * 5 + F.lit(0xE6546B64)).bitwiseAND(F.lit(MASK))

    def folded(a: Column, n: int) -> Column:
        return _once(a, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, n)))

    def whole(x: Column) -> Column:
        h = reduce(step, (x.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(x, 32)), F.lit(0).cast("long"))
        h = h.bitwiseXOR(F.lit(8).cast("long"))
        for shift, mult in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = times(folded(h, shift), mult)
        return folded(h, 16)

    return _once(c.cast("long"), whole)


@F.pandas_udf(T.IntegerType())
def _murmur3_bytes(data):
    import pandas as pd

    out = pd.Series(pd.NA, index=data.index, dtype="Int32")
    held = data.notna()
    out[held] = murmur3_many(data[held].tolist()) & 0x7FFFFFFF
    return out


def column(name: str, c: Column, t: str) -> Column:
    """The transform as a Spark column: built-in expressions but for buckets of bytes."""
    k, p = parse(name)
    s = kind(t)
    if k == "void":
        return F.lit(None).cast("int")
    if k == "identity":
        return c
    if k == "bucket":
        if s in ("int", "long", "time"):
            h = murmur3_long(c)
        elif s == "date":
            h = murmur3_long(F.unix_date(c))
        elif s in ("timestamp", "timestamptz"):
            h = murmur3_long(_micros(c, s))
        elif s.endswith("_ns"):
            h = murmur3_long(_floordiv(c, 1000))
        elif s == "decimal":
            h = _murmur3_bytes(_decimal_bytes(c, t)).cast("long")
        else:
            h = _murmur3_bytes(c.cast("binary")).cast("long")
        return (h.bitwiseAND(F.lit(0x7FFFFFFF)) % p).cast("int")
    if k == "truncate":
        if s in ("int", "long"):
            return c - F.pmod(c, F.lit(p).cast(to_spark(t)))
        if s == "decimal":
            step = F.lit(Decimal(p).scaleb(-params(t)[1])).cast("decimal(38,%d)" % params(t)[1])
            return (c - F.pmod(c.cast("decimal(38,%d)" % params(t)[1]), step)).cast(to_spark(t))
        return F.substring(c, 1, p)
    us = None if s == "date" else (_floordiv(c, 1000) if s.endswith("_ns") else _micros(c, s))
    if k == "hour":
        return _floordiv(us, 3_600_000_000).cast("int")
    day = F.unix_date(c) if s == "date" else _floordiv(us, 86_400_000_000).cast("int")
    if k == "day":
        return F.date_from_unix_date(day)
    date = F.date_from_unix_date(day)
    year = F.year(date) - 1970
    return year if k == "year" else year * 12 + F.month(date) - 1


def _micros(c: Column, s: str) -> Column:
    """Microseconds since 1970 whatever the session's zone."""
    return F.unix_micros(c) if s == "timestamptz" else F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()))


def _floordiv(c: Column, n: int) -> Column:
    n = F.lit(n).cast("long")
    return ((c.cast("long") - F.pmod(c.cast("long"), n)) / n).cast("long")


@F.pandas_udf(T.BinaryType())
def _unscaled_bytes(text):
    import pandas as pd

    return pd.Series([None if x is None else decimal_bytes(int(x)) for x in text])


def _decimal_bytes(c: Column, t: str) -> Column:
    return _unscaled_bytes(F.regexp_replace(c.cast(to_spark(t)).cast("string"), r"\.", ""))
