"""Appends since a snapshot, for jobs that follow a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import scan
from ..sources import manifests, metadata as md
from ..table import Table


def ancestors(meta: dict, snapshot_id: int | None) -> list[dict]:
    """Snapshots from one back to the first, newest first."""
    by = {s["snapshot-id"]: s for s in meta.get("snapshots") or []}
    out = []
    while snapshot_id in by:
        out.append(by[snapshot_id])
        snapshot_id = by[snapshot_id].get("parent-snapshot-id")
    return out


def appended(table: Table, after: int | None, until: int | None = None) -> DataFrame:
    """Rows that append snapshots after ``after`` (None: all) up to ``until`` added, as written.

    Deletes and rewrites in between are left out; ``after`` must be an ancestor.
    """
    last = until if until is not None else md.current_snapshot_id(table.meta)
    chain = ancestors(table.meta, last)
    ids = [s["snapshot-id"] for s in chain]
    if after is not None and after not in ids:
        raise ValueError(f"snapshot {after} is no ancestor of {last}")
    new = {s["snapshot-id"] for s in chain[: ids.index(after) if after is not None else None] if s["summary"].get("operation") == "append"}
    rows = [r for r in manifests.read_list(table.io, md.snapshot(table.meta, last)) if r["content"] == 0 and r["added_snapshot_id"] in new] if last is not None else []
    entries = [e for r in rows for e in manifests.read_entries(table.io, r) if e["status"] == manifests.ADDED and e["snapshot_id"] in new]
    return scan.frame(table.spark, scan.Plan(table.meta, table.schema, entries, [], len(entries)), table.io)
