"""Table metadata: finding the current version, reading it, and its parts."""

from __future__ import annotations

import json
import re

from . import fileio
from .fileio import text

_VERSION = re.compile(r"^(?:v(\d+)|(\d+)-[0-9a-fA-F-]+)(?:\.gz)?\.metadata\.json(?:\.gz)?$")
PROBE = 64


def version_of(name: str) -> int | None:
    """Version number in a metadata file name, either convention."""
    m = _VERSION.match(name.rpartition("/")[2])
    return int(m[1] or m[2]) if m else None


def listed(io, location: str) -> dict[int, str]:
    """Metadata files by version; of several, plain ``vN`` names come before others."""
    out: dict[int, str] = {}
    for name in io.list(f"{location}/metadata"):
        v = version_of(name)
        if v is not None and (v not in out or (not name.startswith("v"), ".gz" in name, name) < (not out[v].startswith("v"), ".gz" in out[v], out[v])):
            out[v] = name
    return out


def hint(io, location: str) -> str | None:
    try:
        return text(io.read(f"{location}/metadata/version-hint.text")).strip()
    except (OSError, Exception) as e:  # noqa: BLE001  a hint is only a cache, whatever stops its reading
        if isinstance(e, (KeyboardInterrupt, SystemExit)):
            raise
        return None


def latest_name(io, location: str) -> str:
    """File name of the current metadata: by listing, else by the hint and a probe forward."""
    names = listed(io, location)
    if names:
        return names[max(names)]
    told = hint(io, location)
    if told is None or not told.isdigit():
        raise FileNotFoundError(f"no table metadata at {location}")
    n = int(told)
    while io.exists(f"{location}/metadata/v{n + 1}.metadata.json"):
        n += 1
        if n - int(told) >= PROBE:
            raise RuntimeError(f"version hint of {location} lies more than {PROBE} versions back")
    return f"v{n}.metadata.json"


def load(io, location: str, name: str | None = None) -> tuple[dict, str]:
    """``(metadata, file name)``; ``name`` picks an earlier version."""
    name = name or latest_name(io, location)
    return json.loads(text(io.read(f"{location}/metadata/{name}"))), name


def versions(io, location: str) -> list[str]:
    names = listed(io, location)
    return [names[v] for v in sorted(names)]


def current_snapshot_id(meta: dict) -> int | None:
    s = meta.get("current-snapshot-id")
    return None if s in (None, -1) else s


def snapshot(meta: dict, snapshot_id: int | None = None) -> dict | None:
    """A snapshot by id, by default the current one; None if the table has none."""
    wanted = current_snapshot_id(meta) if snapshot_id is None else snapshot_id
    if wanted is None:
        return None
    for s in meta.get("snapshots") or []:
        if s["snapshot-id"] == wanted:
            return s
    raise ValueError(f"snapshot {wanted} not found")


def resolve_ref(meta: dict, ref: str) -> int:
    """Snapshot id of a branch or tag."""
    refs = meta.get("refs") or {}
    if ref in refs:
        return refs[ref]["snapshot-id"]
    if ref == "main" and current_snapshot_id(meta) is not None:
        return current_snapshot_id(meta)
    raise ValueError(f"ref {ref} not found")


def as_of(meta: dict, timestamp_ms: int) -> int:
    """Snapshot that was current at a time, by the snapshot log."""
    log = [e for e in meta.get("snapshot-log") or [] if e["timestamp-ms"] <= timestamp_ms]
    if not log:
        raise ValueError(f"no snapshot at {timestamp_ms}")
    return log[-1]["snapshot-id"]


def schema(meta: dict, schema_id: int | None = None) -> dict:
    if "schemas" not in meta:
        return meta["schema"]
    wanted = meta["current-schema-id"] if schema_id is None else schema_id
    for s in meta["schemas"]:
        if s.get("schema-id", 0) == wanted:
            return s
    raise ValueError(f"schema {wanted} not found")


def snapshot_schema(meta: dict, snap: dict | None) -> dict:
    """The schema that a snapshot was written with; the current one if it names none."""
    own = snap.get("schema-id") if snap else None
    return schema(meta, own if own is not None and any(s.get("schema-id") == own for s in meta.get("schemas", [])) else None)


def spec(meta: dict, spec_id: int | None = None) -> dict:
    wanted = meta.get("default-spec-id", 0) if spec_id is None else spec_id
    for s in meta.get("partition-specs") or []:
        if s["spec-id"] == wanted:
            return s
    if wanted == 0:
        return {"spec-id": 0, "fields": meta.get("partition-spec") or []}
    raise ValueError(f"partition spec {wanted} not found")


def sort_order(meta: dict) -> dict:
    wanted = meta.get("default-sort-order-id", 0)
    for s in meta.get("sort-orders") or []:
        if s["order-id"] == wanted:
            return s
    return {"order-id": 0, "fields": []}


def field_types(meta: dict) -> dict[int, object]:
    """Type of every field id in any schema, the newest winning."""
    from ..functions.types import walk

    out: dict[int, object] = {}
    for s in [*(meta.get("schemas") or [meta["schema"]]), schema(meta)]:
        for i, _, t, _ in walk(s["fields"]):
            out[i] = t
    return out


def dumps(meta: dict) -> bytes:
    return json.dumps(meta, indent=2).encode()


def canonical(path: str) -> str:
    return fileio.canonical(path)
