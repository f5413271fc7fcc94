"""Single values as bytes, as bounds and manifests hold them, and their order."""

from __future__ import annotations

import datetime as dt
import json
import math
import struct
import uuid
from decimal import Decimal

from .types import kind, params

EPOCH = dt.datetime(1970, 1, 1)
EPOCH_DAY = dt.date(1970, 1, 1)


def micros(v) -> int:
    """Microseconds since 1970 of a datetime (UTC if it has no zone) or an integer."""
    if isinstance(v, int):
        return v
    if v.tzinfo is not None:
        v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    d = v - EPOCH
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def days(v) -> int:
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return micros(v) // 86_400_000_000
    return (v - EPOCH_DAY).days


def unscaled(v: Decimal, scale: int) -> int:
    return int(Decimal(v).scaleb(scale).to_integral_exact())


def decimal_bytes(n: int) -> bytes:
    """Least big-endian two's complement of an integer."""
    return n.to_bytes(max(1, (n.bit_length() + 8) // 8 if n >= 0 else ((n + 1).bit_length() + 8) // 8), "big", signed=True)


def to_bytes(v, t: str) -> bytes | None:
    """Binary form of a value, little-endian where the format says so."""
    if v is None:
        return None
    k = kind(t)
    if k == "boolean":
        return b"\x01" if v else b"\x00"
    if k in ("int", "date"):
        return struct.pack("<i", days(v) if k == "date" else v)
    if k in ("long", "time", "timestamp_ns", "timestamptz_ns"):
        return struct.pack("<q", v)
    if k in ("timestamp", "timestamptz"):
        return struct.pack("<q", micros(v))
    if k == "float":
        return struct.pack("<f", v)
    if k == "double":
        return struct.pack("<d", v)
    if k == "string":
        return v.encode()
    if k == "decimal":
        return decimal_bytes(unscaled(v, params(t)[1]))
    if k == "uuid":
        return uuid.UUID(v).bytes if isinstance(v, str) else bytes(v)
    if k in ("binary", "fixed", "geometry", "geography"):
        return bytes(v)
    raise ValueError(f"no single-value form of {t}")


def from_bytes(b: bytes | None, t: str):
    """Value of a binary form; dates are days, timestamps microseconds. Shorter int and float
    forms, from before a promotion, are understood."""
    if b is None:
        return None
    k = kind(t)
    if k == "boolean":
        return b != b"\x00"
    if k in ("int", "date", "long", "time", "timestamp", "timestamptz", "timestamp_ns", "timestamptz_ns"):
        if k.startswith("timestamp") and len(b) == 4:
            return struct.unpack("<i", b)[0] * 86_400_000_000
        return struct.unpack("<i" if len(b) == 4 else "<q", b)[0]
    if k in ("float", "double"):
        return struct.unpack("<f" if len(b) == 4 else "<d", b)[0]
    if k == "string":
        return b.decode()
    if k == "decimal":
        return Decimal(int.from_bytes(b, "big", signed=True)).scaleb(-params(t)[1])
    return bytes(b)


def canonical(v, t: str):
    """A value in the domain that from_bytes() gives, so that the two compare."""
    if v is None:
        return None
    k = kind(t)
    if k == "date":
        return days(v)
    if k in ("timestamp", "timestamptz"):
        return micros(v)
    if k == "uuid":
        return uuid.UUID(v).bytes if isinstance(v, str) else bytes(v)
    if k == "decimal":
        return Decimal(v)
    if k in ("binary", "fixed"):
        return bytes(v)
    return v


def order_key(v, t: str):
    """Sort key: strings by code point, -0 before +0, NaN last."""
    k = kind(t)
    if k in ("float", "double"):
        return (1, 0.0, 0) if math.isnan(v) else (0, v, 0 if v == 0 and math.copysign(1, v) < 0 else 1)
    return canonical(v, t)


def to_json(v, t: str):
    """JSON single value, as defaults hold it."""
    if v is None:
        return None
    k = kind(t)
    if k == "date":
        return v if isinstance(v, str) else (EPOCH_DAY + dt.timedelta(days(v))).isoformat()
    if k in ("timestamp", "timestamptz") and not isinstance(v, str):
        return (EPOCH + dt.timedelta(microseconds=micros(v))).isoformat() + ("+00:00" if k == "timestamptz" else "")
    if k in ("binary", "fixed") and not isinstance(v, str):
        return bytes(v).hex()
    if k == "decimal":
        return str(v)
    return v


def from_json(v, t):
    """Python value that Spark takes as a literal of the type."""
    if v is None:
        return None
    k = kind(t)
    if k == "date":
        return dt.date.fromisoformat(v) if isinstance(v, str) else v if isinstance(v, dt.date) else EPOCH_DAY + dt.timedelta(v)
    if k in ("timestamp", "timestamptz"):
        out = dt.datetime.fromisoformat(v) if isinstance(v, str) else v if isinstance(v, dt.datetime) else EPOCH + dt.timedelta(microseconds=v)
        return out.replace(tzinfo=dt.timezone.utc) if k == "timestamptz" and out.tzinfo is None else out
    if k in ("binary", "fixed"):
        return bytes.fromhex(v) if isinstance(v, str) else bytes(v)
    if k == "uuid":
        return uuid.UUID(v).bytes if isinstance(v, str) else bytes(v)
    if k == "decimal":
        return Decimal(str(v))
    return v


def loads(text: str | bytes):
    """JSON with whole integers (Python keeps them exact)."""
    return json.loads(text)


def truncate_lower(v, t: str, width: int = 16):
    """A lower bound of at most ``width`` code points or bytes."""
    return v[:width] if kind(t) in ("string", "binary", "fixed") else v


def truncate_upper(v, t: str, width: int = 16):
    """An upper bound of at most ``width`` code points or bytes; None if there is none."""
    if kind(t) not in ("string", "binary", "fixed") or len(v) <= width:
        return v
    head = list(v[:width])
    while head:
        last = head.pop()
        if isinstance(last, int):
            if last < 255:
                return bytes([*head, last + 1])
        elif ord(last) < 0x10FFFF:
            up = ord(last) + 1
            return "".join(head) + chr(0xE000 if 0xD800 <= up <= 0xDFFF else up)
    return None
