"""Writing data and delete files: staging by Spark, statistics in one aggregate, entries.

Rows are dealt by partition tuple with a rebalance, which splits tuples that many rows share,
sorted within tasks, and written to a folder of their own below ``data/``, where they stay.
Statistics and tuple values of every file come from one aggregate over them. Delete files are
staged and then move into ``data/``.
"""

from __future__ import annotations

import secrets
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, serde, transforms
from ..functions.types import LAST_SEQ, LAST_SEQ_NAME, ROW_ID, ROW_ID_NAME, kind, struct, to_spark
from ..sources import manifests, metadata as md
from ..sources.fileio import canonical
from .naming import literal
from .scan import OWN, PATH_FIELD, configure

NO_BOUNDS = {"variant", "unknown", "geometry", "geography"}
CODECS = ("snappy", "uncompressed", "zstd", "gzip")
#: Files that are moved at a time.
MOVES = 16
#: Rows of a range at most, about, where rows are dealt by the declared order.
RANGE_ROWS = 500_000


@dataclass
class Staged:
    """Files that are written but not yet part of the table."""

    entries: list[dict]
    paths: list[str] = field(default_factory=list)  # what goes if they are not wanted: their folder
    rows: int = 0
    first_id: int | None = None  # the least stored row id, if every row has one


def aligned(df: DataFrame, schema: dict) -> DataFrame:
    """Columns of a schema in its order: missing ones get their write default, explicit nulls
    stay; unknown columns and missing required ones raise ValueError."""
    have = {n: n for n in df.columns}
    extra = set(have) - {f["name"] for f in schema["fields"]} - {ROW_ID_NAME, LAST_SEQ_NAME}
    if extra:
        raise ValueError(f"columns {sorted(extra)} are not in the schema")
    cols = []
    for f in schema["fields"]:
        if kind(f["type"]) == "unknown":
            continue
        if f["name"] in have:
            c = F.col(f"`{f['name']}`")
            c = _filled(c, df.schema[f["name"]].dataType, f["type"])
            if kind(f["type"]) == "fixed":
                n = int(f["type"][6:-1])
                c = F.when(c.isNull() | (F.length(c) == n), c).otherwise(F.raise_error(F.lit(f"{f['name']}: not {n} bytes")).cast("binary"))
        elif f.get("write-default") is not None:
            c = literal(f["write-default"], f["type"])
        elif f.get("required"):
            raise ValueError(f"required column {f['name']} is missing")
        else:
            c = F.lit(None).cast(to_spark(f["type"]))
        if f.get("required") and f["name"] in have and df.schema[f["name"]].nullable:
            c = F.coalesce(c, F.raise_error(F.lit(f"{f['name']}: null in a required column")).cast(to_spark(f["type"])))
        cols.append(c.alias(f["name"]))
    cols += [F.col(n) for n in (ROW_ID_NAME, LAST_SEQ_NAME) if n in have]
    return df.select(*cols)


def _filled(c: Column, have: T.DataType, t) -> Column:
    """A value cast to a table type, with write defaults of struct fields that it lacks."""
    if isinstance(t, dict) and t["type"] == "struct" and isinstance(have, T.StructType):
        names = {f.name: f.dataType for f in have.fields}
        parts = [(_filled(c[f["name"]], names[f["name"]], f["type"]) if f["name"] in names else literal(f.get("write-default"), f["type"]) if not isinstance(f["type"], dict) else F.lit(None).cast(to_spark(f["type"]))).alias(f["name"]) for f in t["fields"]]
        return F.when(c.isNotNull(), F.struct(*parts)).cast(to_spark(t))
    return c if have == to_spark(t) else c.cast(to_spark(t))


def sort_columns(order: dict, by_id: dict[int, dict]) -> list[Column]:
    """Spark sort columns of a declared order; null order is independent of direction."""
    out = []
    for f in order.get("fields", []):
        source = by_id[f.get("source-id", (f.get("source-ids") or [None])[0])]
        c = transforms.column(f["transform"], F.col(f"`{source['name']}`"), source["type"])
        first = f["null-order"] == "nulls-first"
        if f["direction"] == "desc":
            out.append(c.desc_nulls_first() if first else c.desc_nulls_last())
        else:
            out.append(c.asc_nulls_first() if first else c.asc_nulls_last())
    return out


def _tuple_columns(schema: dict, own_spec: dict) -> list[tuple[dict, Column, str]]:
    by_id = {f["id"]: f for f in schema["fields"]}
    out = []
    for f in own_spec["fields"]:
        source = by_id[f["source-id"]]
        t = source["type"]
        out.append((f, transforms.column(f["transform"], F.col(f"`{source['name']}`"), t), transforms.result_type(f["transform"], t)))
    return out


def _key(c: Column, t: str) -> Column:
    """Text that tells tuple values apart: zeros by their sign, bytes by hex, null by a mark."""
    text = F.hex(c) if kind(t) in ("binary", "fixed", "uuid") else c.cast("string")
    return F.coalesce(F.concat(F.lit("="), text), F.lit("null"))


def stage_data(spark: SparkSession, io, location: str, meta: dict, df: DataFrame, *, codec: str = "snappy", sort: bool = True, max_rows: int = 0, ranged: int | None = None) -> Staged:
    """Write rows under the table's default spec and sort order; returns ADDED entries. ``ranged``,
    about the number of rows, deals them by ranges of the order, so that files follow each other in it."""
    if codec not in CODECS:
        raise ValueError(f"codec {codec} is not supported")
    configure(spark)
    schema, own_spec, order = md.schema(meta), md.spec(meta), md.sort_order(meta)
    by_id = {f["id"]: f for f in schema["fields"]}
    df = aligned(df, schema)
    lineage = [n for n in (ROW_ID_NAME, LAST_SEQ_NAME) if n in df.columns]
    fields = [f for f in schema["fields"] if kind(f["type"]) != "unknown"]
    tuple_cols = _tuple_columns(schema, own_spec)
    sorts = sort_columns(order, by_id) if sort else []
    if tuple_cols:
        key = F.lower(F.hex(F.xxhash64(F.concat_ws("/", *[_key(c, t) for _, c, t in tuple_cols]))))
        df = df.withColumn("__pt", key)
    if ranged is not None and sorts:
        n = -(-ranged // RANGE_ROWS)  # beyond the session's own number, which Spark merges again
        df = df.repartitionByRange(*([n] if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else []), *(["__pt"] if tuple_cols else []), *sorts)
    elif tuple_cols:
        df = df.hint("rebalance", "__pt")
    if tuple_cols or sorts:
        df = df.sortWithinPartitions(*(["__pt"] if tuple_cols else []), *sorts)
    reserved = [{"id": ROW_ID, "name": ROW_ID_NAME, "type": "long"}, {"id": LAST_SEQ, "name": LAST_SEQ_NAME, "type": "long"}]
    target = struct([f | {"required": False} for f in fields] + [r for r in reserved if r["name"] in lineage])
    with_ids = df.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in target.fields], *(["__pt"] if tuple_cols else []))
    folder = f"{location}/data/{uuid.uuid4().hex}{OWN}"
    writer = with_ids.write.option("compression", codec).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    if tuple_cols:
        writer = writer.partitionBy("__pt")
    try:
        writer.parquet(canonical(folder))
        entries, first_id = _collect(spark, folder, meta, fields, tuple_cols, target, order["order-id"] if sorts else 0)
    except BaseException:
        io.delete(folder)
        raise
    if not entries:
        io.delete(folder)
    return Staged(entries, [folder] if entries else [], sum(e["data_file"]["record_count"] for e in entries), first_id)


def _move(io, location: str, pairs: list[tuple[str, str]]) -> None:
    """Move staged files, as Spark names them, to their places; the first failure is raised."""
    with ThreadPoolExecutor(MOVES) as pool:
        list(pool.map(lambda x: io.rename(x[0] if "://" in location else x[0].removeprefix("file://"), x[1]), pairs))


def _bounded(f: dict) -> bool:
    return not isinstance(f["type"], dict) and kind(f["type"]) not in NO_BOUNDS


def per_file(staged: DataFrame, aggs: list[Column], *by: str) -> DataFrame:
    """A row for each staged file, its path ``p`` and ``size``, with aggregates of its rows.

    Spark would sort all rows of a task for the least of texts, as texts have no fixed width; beside
    an aggregate that keeps objects (``__held``, always empty) it holds a buffer a file instead."""
    held = F.collect_set(F.lit(None).cast("int")).alias("__held")
    return staged.groupBy(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("size"), *by).agg(*aggs, held)


def _collect(spark, folder: str, meta: dict, fields: list[dict], tuple_cols: list, target: T.StructType, order_id: int) -> tuple[list[dict], int | None]:
    """Entries of a folder's files with statistics and tuples, one row a file. The least stored row
    id comes second, if every row has one."""
    staged = spark.read.schema(target).parquet(canonical(folder))
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in fields:
        c, i = F.col(f"`{f['name']}`"), f["id"]
        if isinstance(f["type"], dict):
            continue
        k = kind(f["type"])
        aggs.append(F.count(c).alias(f"c{i}"))
        if k in ("geometry", "geography"):
            aggs += [x.alias(f"{s}{i}") for s, x in geo.bound_aggregates(c)]
            continue
        if not _bounded(f):
            continue
        v = c
        if k in ("float", "double"):
            aggs.append(F.count_if(F.isnan(c)).alias(f"a{i}"))
            v = F.when(~F.isnan(c), c)
        if k in ("string", "binary", "fixed"):
            v = F.substring(c, 1, 17)
        aggs += [F.min(v).alias(f"l{i}"), F.max(v).alias(f"u{i}")]
    for k, (_, c, t) in enumerate(tuple_cols):
        aggs += [F.min(c).alias(f"t{k}"), F.max(c).alias(f"x{k}"), F.count(c).alias(f"tc{k}")]
    lineage = ROW_ID_NAME in target.names
    if lineage:
        aggs += [F.count(ROW_ID_NAME).alias("ids"), F.min(ROW_ID_NAME).alias("first_id")]
    rows = per_file(staged, aggs).collect()
    out, name = [], folder.rpartition("/")[2]
    for r in sorted(rows, key=lambda r: r["p"]):
        n = r["n"]
        tuple_ = {}
        for k, (f, _, t) in enumerate(tuple_cols):
            if r[f"tc{k}"] not in (0, n) or r[f"t{k}"] != r[f"x{k}"] and not (r[f"t{k}"] != r[f"t{k}"]):
                raise RuntimeError("rows of different partition tuples in one file")
            v = r[f"t{k}"]
            tuple_[f["name"]] = bytes(v) if isinstance(v, bytearray) else v
        counts = {f["id"]: n for f in fields if not isinstance(f["type"], dict)}
        nulls = {i: n - r[f"c{i}"] for i in counts}
        nans = {f["id"]: r[f"a{f['id']}"] for f in fields if kind(f["type"]) in ("float", "double")}
        low, high = {}, {}
        for f in fields:
            i, t = f["id"], f["type"]
            if kind(t) in ("geometry", "geography"):
                a, b = geo.bounds_of(r, i)
                if a is not None:
                    low[i], high[i] = a, b
            elif _bounded(f) and r[f"l{i}"] is not None:
                a, b = _bound(r[f"l{i}"], t, False), _bound(r[f"u{i}"], t, True)
                low[i] = serde.to_bytes(a, t)
                if b is not None:
                    high[i] = serde.to_bytes(b, t)
        path = f"{folder}/{r['p'].rpartition(f'/{name}/')[2]}"
        out.append(
            {
                "status": manifests.ADDED,
                "spec_id": md.spec(meta)["spec-id"],
                "data_file": {
                    "content": 0, "file_path": path, "file_format": "PARQUET", "partition": tuple_, "record_count": n, "file_size_in_bytes": r["size"],
                    "value_counts": counts, "null_value_counts": nulls, "nan_value_counts": nans, "lower_bounds": low, "upper_bounds": high, "sort_order_id": order_id,
                },
            }
        )
    whole = lineage and rows and all(r["ids"] == r["n"] for r in rows)
    return out, min(r["first_id"] for r in rows) if whole else None


def _bound(v, t: str, upper: bool):
    if kind(t) in ("float", "double") and v == 0:
        return 0.0 if upper else -0.0  # Spark merges the zeros, so the bounds take both in
    if isinstance(v, bytearray):
        v = bytes(v)
    return serde.truncate_upper(v, t) if upper else serde.truncate_lower(v, t)


def new_snapshot_id(meta: dict) -> int:
    taken = {s["snapshot-id"] for s in meta.get("snapshots") or []}
    while True:
        i = secrets.randbits(62) + 1
        if i not in taken:
            return i


def delete_file(path: str, fmt: str, size: int, partition: dict, spec_id: int, rows: int, **more) -> dict:
    return {
        "status": manifests.ADDED,
        "spec_id": spec_id,
        "data_file": {"content": 1, "file_path": path, "file_format": fmt, "partition": partition, "record_count": rows, "file_size_in_bytes": size, **more},
    }


def stage_position_deletes(spark: SparkSession, io, location: str, positions: DataFrame, targets: dict[str, dict]) -> list[dict]:
    """Parquet position deletes of ``positions(file_path, pos)``, a group of files for each spec
    and tuple, sorted by path and position. ``targets`` has the data entry of each known path."""
    configure(spark)
    groups: dict[str, dict] = {}
    rows = []
    for path, e in targets.items():
        key = repr(manifests.tuple_key(e))
        mark = f"{abs(hash_text(key)):x}"
        groups[mark] = e
        rows.append((canonical(path), e["data_file"]["file_path"], mark))
    known = spark.createDataFrame(rows or [("", "", "")], "__c string, __told string, __pt string")
    held = positions.select(F.regexp_replace(F.col("file_path"), "^(file:/+|/)", "file:///").alias("__c"), F.col("pos").cast("long").alias("pos")).distinct()
    joined = held.join(known, "__c", "left")
    meta = {"file_path": {"parquet.field.id": 2147483546}, "pos": {"parquet.field.id": 2147483545}}
    out = joined.select(F.coalesce("__told", F.raise_error(F.concat(F.lit("not a data file of the table: "), "__c")).cast("string")).alias("file_path", metadata=meta["file_path"]), F.col("pos").alias("pos", metadata=meta["pos"]), "__pt")
    staging = f"{location}/data/_staging-{uuid.uuid4().hex}"
    try:
        out.hint("rebalance", "__pt", "file_path").sortWithinPartitions("__pt", "file_path", "pos").write.option("compression", "snappy").partitionBy("__pt").parquet(canonical(staging))
        aggs = [F.count(F.lit(1)).alias("n"), F.min("file_path").alias("low"), F.max("file_path").alias("high")]
        staged = spark.read.schema("file_path string, pos long, __pt string").parquet(canonical(staging))
        found = per_file(staged, aggs, "__pt").collect() if held.limit(1).count() else []
        entries, moves = [], []
        for r in found:
            e = groups[r["__pt"]]
            path = f"{location}/data/{uuid.uuid4().hex}-del{OWN}"
            moves.append((canonical(r["p"]), path))
            bounds = {"lower_bounds": {PATH_FIELD: r["low"].encode()}, "upper_bounds": {PATH_FIELD: r["high"].encode()}}
            one = {"referenced_data_file": r["low"]} if r["low"] == r["high"] else {}
            entries.append(delete_file(path, "PARQUET", r["size"], e["data_file"]["partition"], e["spec_id"], r["n"], **bounds, **one))
        _move(io, location, moves)
        return entries
    finally:
        io.delete(staging)


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


def stage_equality_deletes(spark: SparkSession, io, location: str, meta: dict, keys: DataFrame) -> list[dict]:
    """Equality deletes of the key rows, global to the table."""
    configure(spark)
    by_name = {f["name"]: f for f in md.schema(meta)["fields"]}
    fields = [by_name[c] for c in keys.columns]
    target = struct([f | {"required": False} for f in fields])
    staging = f"{location}/data/_staging-{uuid.uuid4().hex}"
    try:
        keys.distinct().select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in target.fields]).write.parquet(canonical(staging))
        found = spark.read.schema(target).parquet(canonical(staging)).groupBy(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
        entries, moves = [], []
        unpartitioned = next((s["spec-id"] for s in meta["partition-specs"] if not s["fields"]), None)
        if unpartitioned is None:
            raise ValueError("global equality deletes need an unpartitioned spec")
        for r in found:
            path = f"{location}/data/{uuid.uuid4().hex}-del{OWN}"
            moves.append((canonical(r["p"]), path))
            e = delete_file(path, "PARQUET", r["size"], {}, unpartitioned, r["n"], equality_ids=[f["id"] for f in fields])
            e["data_file"]["content"] = 2
            entries.append(e)
        _move(io, location, moves)
        return entries
    finally:
        io.delete(staging)


def vector_blobs(positions: DataFrame, prior: DataFrame | None) -> DataFrame:
    """``(__c, blob, n)``: a deletion vector for each file of ``positions(file_path, pos)``,
    with the positions ``prior(__dpath, __dpos)`` that are deleted there already."""
    every = positions.select(F.regexp_replace(F.col("file_path"), "^(file:/+|/)", "file:///").alias("__c"), F.col("pos").cast("long").alias("pos"))
    if prior is not None:
        touched = every.select("__c").distinct()
        every = every.unionByName(prior.select(F.col("__dpath").alias("__c"), F.col("__dpos").alias("pos")).join(touched, "__c", "left_semi"))

    def run(pdf):
        import pandas as pd

        from quarrylake.sources import puffin

        pos = pdf["pos"].unique()
        return pd.DataFrame({"__c": [pdf["__c"].iloc[0]], "blob": [puffin.encode_vector(pos)], "n": [len(pos)], "top": [int(pos.max())], "low": [int(pos.min())]})

    return every.distinct().groupBy("__c").applyInPandas(run, "__c string, blob binary, n long, top long, low long")
