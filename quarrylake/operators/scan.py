"""Snapshots as DataFrames: files by id or name, absent columns, deletes, row lineage, ranges."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import LAST_SEQ, LAST_SEQ_NAME, ROW_ID, ROW_ID_NAME, struct, to_spark
from ..sources import manifests, metadata as md
from ..sources.fileio import canonical
from ..sources.fileio import spark_path as _clean_path
from . import naming
from .prune import Pruner

PATH, POS, SEQ, FIRST, ORDINAL, TUPLE = "__path", "__pos", "__seq", "__first", "__ordinal", "__tuple"
PATH_FIELD = 2147483546
#: What names of our own files, or of the folder that they are in, end with.
OWN = "-ql.parquet"
#: Per-file constants of more files than this are joined by a shuffle.
BROADCAST_FILES = 50_000
LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def configure(spark: SparkSession) -> None:
    """What tables need of a session: ids in Parquet, microsecond timestamps, nanoseconds as longs,
    and folders listed by no more tasks than keep the cores busy (by default a task a folder)."""
    spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
    spark.conf.set("spark.sql.parquet.fieldId.write.enabled", "true")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    if spark.conf.get(LISTERS) == "10000":
        spark.conf.set(LISTERS, str(max(32, 4 * spark.sparkContext.defaultParallelism)))


@dataclass
class Plan:
    """Files of a scan after pruning, and what they need."""

    meta: dict
    schema: dict
    data: list[dict]
    deletes: list[dict]
    total: int
    groups: dict = field(default_factory=dict)

    @property
    def paths(self) -> list[str]:
        return [e["data_file"]["file_path"] for e in self.data]


def plan(io, meta: dict, snapshot_id: int | None = None, predicate=True, schema: dict | None = None, spark: SparkSession | None = None) -> Plan:
    """Files of a snapshot that can hold rows for which the predicate is true. Manifests whose
    summaries rule them out are not read; ``total`` counts the files of the others too, as far as
    the list tells."""
    snap = md.snapshot(meta, snapshot_id)
    schema = schema or md.snapshot_schema(meta, snap if snapshot_id is not None else None)
    if predicate is True:
        data, deletes = manifests.live(io, snap, spark)
        return Plan(meta, schema, data, deletes, len(data))
    pruner = Pruner(meta, schema)
    total = sum((r.get("added_files_count") or 0) + (r.get("existing_files_count") or 0) for r in manifests.read_list(io, snap) if not r["content"])
    data, deletes = manifests.live(io, snap, spark, lambda row: pruner.keeps_manifest(row, predicate), lambda e: pruner.keeps(e, predicate))
    return Plan(meta, schema, data, deletes, max(total, len(data)))


def count_from_metadata(io, meta: dict, snapshot_id: int | None = None) -> int | None:
    """Rows of a snapshot by its manifests; None where deletes leave it open."""
    data, deletes = manifests.live(io, md.snapshot(meta, snapshot_id))
    return None if deletes else sum(e["data_file"]["record_count"] for e in data)


def applies(delete: dict, data: dict) -> bool:
    """Whether a delete file can touch a data file: sequence numbers, then spec and tuple."""
    d = delete["data_file"]
    seq, own = delete["sequence_number"], data["sequence_number"]
    if d["content"] == manifests.EQUALITY_DELETES:
        if not seq > own:
            return False
        return not d["partition"] or manifests.tuple_key(delete) == manifests.tuple_key(data)
    if not seq >= own:
        return False
    target = target_of(delete)
    if target is not None:
        return canonical(target) == canonical(data["data_file"]["file_path"])
    return manifests.tuple_key(delete) == manifests.tuple_key(data)


def target_of(delete: dict) -> str | None:
    """The one data file that a position delete file is about, if it is one."""
    d = delete["data_file"]
    if d.get("referenced_data_file"):
        return d["referenced_data_file"]
    low, high = ((d.get(k) or {}).get(PATH_FIELD) for k in ("lower_bounds", "upper_bounds"))
    return low.decode() if low is not None and low == high and len(low) != 16 else None


def is_vector(delete: dict) -> bool:
    d = delete["data_file"]
    return d["content"] == manifests.POSITION_DELETES and d["file_format"].lower() == "puffin"


class Footers:
    """Columns of data files: from the schema of the snapshot that wrote them, else from footers."""

    def __init__(self, spark: SparkSession, meta: dict):
        self.spark, self.meta = spark, meta
        self.snapshots = {s["snapshot-id"]: s for s in meta.get("snapshots") or []}

    def columns(self, entry: dict) -> tuple[bool, dict[int, str], dict[str, T.DataType | None]]:
        """``(has ids, name by top-level id, all names)``; names of nested columns in files without
        ids come with the file's type."""
        path = entry["data_file"]["file_path"]
        snap = self.snapshots.get(entry["snapshot_id"])
        if (path.endswith(OWN) or f"{OWN}/" in path) and snap and snap.get("schema-id") is not None:
            by = {f["id"]: f["name"] for f in md.schema(self.meta, snap["schema-id"])["fields"] if f["type"] != "unknown"}
            if snap["summary"].get("operation") == "replace" and self.meta["format-version"] >= 3:
                by |= {ROW_ID: ROW_ID_NAME, LAST_SEQ: LAST_SEQ_NAME}
            if "-del-" not in path:
                return True, by, dict.fromkeys(by.values())
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(canonical(path))
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(p, conf))
        try:
            message = reader.getFileMetaData().getSchema()
            fields = message.getFields()
            by, names, nested = {}, {}, False
            for k in range(fields.size()):
                f = fields.get(k)
                names[f.getName()] = None
                nested = nested or not f.isPrimitive()
                if f.getId() is not None:
                    by[f.getId().intValue()] = f.getName()
            if nested and not by:
                converter = jvm.org.apache.spark.sql.execution.datasources.parquet.ParquetToSparkSchemaConverter(self.spark._jsparkSession.sessionState().conf())
                names = {x.name: x.dataType for x in T.StructType.fromJson(json.loads(converter.convert(message).json())).fields}
            return bool(by), by, names
        finally:
            reader.close()


def _group_key(entry: dict, footers: Footers, fields: list[dict], mapping: dict, meta: dict) -> tuple:
    """What reading a file needs: ids or names, and values of columns that it lacks."""
    has_ids, by, names = footers.columns(entry)
    parts = {f.get("source-id", (f.get("source-ids") or [None])[0]): f["name"] for f in md.spec(meta, entry["spec_id"])["fields"] if f["transform"] == "identity"}
    out = []
    for f in fields:
        i = f["id"]
        if i in by if has_ids else False:
            out.append((i, "id", None))
            continue
        tuple_ = entry["data_file"]["partition"]
        name = None
        if not has_ids:
            name = naming.stored(f, mapping, names)
        if i in parts and parts[i] in tuple_ and (has_ids or name is None):
            out.append((i, "const", repr(tuple_[parts[i]])))
        elif name is not None:
            held = T.StructType([T.StructField(name, naming.reading(f["type"], names[name], mapping))])
            out.append((i, "name", held.json()))
        elif f.get("initial-default") is not None:
            out.append((i, "default", None))
        else:
            out.append((i, "null", None))
    return has_ids, tuple(out)


def frame(spark: SparkSession, p: Plan, io=None, lineage: bool = False, positions: bool = False, delete_rows: bool = True) -> DataFrame:
    """The rows of a plan. ``lineage`` adds row ids and last-change numbers, ``positions`` the
    file path, row index and file ordinal of each row."""
    configure(spark)
    fields = p.schema["fields"]
    if not p.data:
        empty = spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType, f.nullable) for f in struct(fields).fields]))
        return _extra(empty, lineage, positions)
    mapping, footers = naming.mapping(p.meta), Footers(spark, p.meta)
    reserved = [{"id": ROW_ID, "name": ROW_ID_NAME, "type": "long"}, {"id": LAST_SEQ, "name": LAST_SEQ_NAME, "type": "long"}] if lineage else []
    groups: dict[tuple, list[tuple[int, dict]]] = {}
    touched = _touched(p) if delete_rows else {}
    for n, e in enumerate(p.data):
        key = _group_key(e, footers, [*fields, *reserved], mapping, p.meta)
        groups.setdefault((key, bool(touched.get(n))), []).append((n, e))
    parts = []
    for ((has_ids, columns), dirty), own in groups.items():
        parts.append(_read_group(spark, p, has_ids, columns, own, [*fields, *reserved], touched if dirty else {}, lineage, positions))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _extra(df: DataFrame, lineage: bool, positions: bool) -> DataFrame:
    for on, names in ((lineage, (ROW_ID_NAME, LAST_SEQ_NAME)), (positions, (POS, ORDINAL))):
        for n in names if on else ():
            df = df.withColumn(n, F.lit(None).cast("long"))
    return df.withColumn(PATH, F.lit(None).cast("string")) if positions else df


def _touched(p: Plan) -> dict[int, list[dict]]:
    """Deletes that can apply to each file of the plan; a vector replaces position deletes."""
    if not p.deletes:
        return {}
    by_target: dict[str, list[dict]] = {}
    rest: dict[object, list[dict]] = {}
    for d in p.deletes:
        t = target_of(d) if d["data_file"]["content"] == manifests.POSITION_DELETES else None
        if t is not None:
            by_target.setdefault(canonical(t), []).append(d)
        elif d["data_file"]["content"] == manifests.EQUALITY_DELETES and not d["data_file"]["partition"]:
            rest.setdefault(None, []).append(d)
        else:
            rest.setdefault(manifests.tuple_key(d), []).append(d)
    out = {}
    for n, e in enumerate(p.data):
        near = [*by_target.get(canonical(e["data_file"]["file_path"]), []), *rest.get(None, []), *rest.get(manifests.tuple_key(e), [])]
        own = [d for d in near if applies(d, e)]
        if any(is_vector(d) for d in own):
            own = [d for d in own if is_vector(d) or d["data_file"]["content"] == manifests.EQUALITY_DELETES]
        if own:
            out[n] = own
    return out


def _read_group(spark, p: Plan, has_ids: bool, columns: tuple, own: list, fields: list[dict], touched: dict, lineage: bool, positions: bool) -> DataFrame:
    paths = [canonical(e["data_file"]["file_path"]) for _, e in own]
    by_id = {f["id"]: f for f in fields}
    held = {i: T.StructType.fromJson(json.loads(x)).fields[0] for i, how, x in columns if how == "name"}
    if has_ids:
        schema = struct([by_id[i] for i, how, _ in columns if how == "id"])
    else:
        schema = T.StructType(list(held.values()))
    need_file = bool(touched) or lineage or positions
    if not schema.fields:  # nothing to read but the number of rows
        schema = T.StructType([T.StructField("__none", T.StringType())])
        spark_conf = spark.read.option("mergeSchema", "false")
        df = spark_conf.schema(schema).parquet(*paths)
    else:
        df = spark.read.schema(schema).parquet(*paths)
    cols = []
    for i, how, x in columns:
        f = by_id[i]
        if how == "id":
            c = F.col(f"`{f['name']}`")
        elif how == "name":
            c = naming.shaped(F.col(f"`{held[i].name}`"), f["type"], held[i].dataType, naming.mapping(p.meta))
        elif how == "const":
            names = {s.get("source-id", (s.get("source-ids") or [None])[0]): s["name"] for s in md.spec(p.meta, own[0][1]["spec_id"])["fields"] if s["transform"] == "identity"}
            c = naming.literal(own[0][1]["data_file"]["partition"][names[i]], f["type"])
        else:
            c = naming.literal(f.get("initial-default") if how == "default" else None, f["type"])
        cols.append(c.cast(to_spark(f["type"])).alias(f["name"]) if how != "id" else c)
    if need_file:
        cols += [_clean_path(F.col("_metadata.file_path")).alias(PATH), F.col("_metadata.row_index").alias(POS)]
    df = df.select(*cols)
    if need_file:
        rows = [(canonical(e["data_file"]["file_path"]), n, e["sequence_number"], e["data_file"].get("first_row_id"), repr(manifests.tuple_key(e))) for n, e in own]
        consts = spark.createDataFrame(rows, f"{PATH} string, {ORDINAL} long, {SEQ} long, {FIRST} long, {TUPLE} string")
        df = df.join(F.broadcast(consts) if len(rows) <= BROADCAST_FILES else consts, PATH)
    if touched:
        df = _without_deleted(spark, p, df, [touched[n] for n, _ in own if n in touched], consts)
    names = [f"`{f['name']}`" for f in p.schema["fields"]]
    if lineage:
        seq = F.when(F.col(FIRST).isNotNull(), F.col(SEQ))
        df = df.withColumn(ROW_ID_NAME, F.coalesce(ROW_ID_NAME, F.col(FIRST) + F.col(POS))).withColumn(LAST_SEQ_NAME, F.coalesce(LAST_SEQ_NAME, seq))
        names += [ROW_ID_NAME, LAST_SEQ_NAME]
    return df.select(*names, *((POS, ORDINAL, PATH) if positions else ()))


def _without_deleted(spark, p: Plan, df: DataFrame, lists: list[list[dict]], consts: DataFrame) -> DataFrame:
    """Anti joins with positions, vectors and equality keys. Positions are matched by the files'
    ordinals in ``consts``, so no row carries its path through a shuffle."""
    every = {(d["data_file"]["file_path"], d["data_file"].get("content_offset")): d for own in lists for d in own}.values()
    vectors = [d for d in every if is_vector(d)]
    files = [d for d in every if d["data_file"]["content"] == manifests.POSITION_DELETES and not is_vector(d)]
    equal: dict[tuple, list[dict]] = {}
    for d in every:
        if d["data_file"]["content"] == manifests.EQUALITY_DELETES:
            equal.setdefault(tuple(sorted(d["data_file"]["equality_ids"])), []).append(d)
    place = consts.select(F.col(PATH).alias("__dpath"), F.col(ORDINAL).alias("__dn"), F.col(SEQ).alias("__own"), F.col(TUPLE).alias("__at"))
    place = F.broadcast(place) if len(p.data) <= BROADCAST_FILES else place
    if vectors:
        gone = vector_rows(spark, vectors).join(place, "__dpath").select("__dn", "__dpos")
        df = df.join(gone, (df[ORDINAL] == gone["__dn"]) & (df[POS] == gone["__dpos"]), "left_anti")
    if files:
        covered = {canonical(target_of(d)) for d in vectors}
        gone = position_rows(spark, files)
        if covered:
            gone = gone.where(~F.col("__dpath").isin(list(covered)))
        reached = (F.col("__dseq") >= F.col("__own")) & (F.col("__dtuple").isNull() | (F.col("__dtuple") == F.col("__at")))
        gone = gone.join(place, "__dpath").where(reached).select("__dn", "__dpos")
        df = df.join(gone, (df[ORDINAL] == gone["__dn"]) & (df[POS] == gone["__dpos"]), "left_anti")
    known = {f["id"]: f for s in [*p.meta.get("schemas", []), p.schema] for f in s["fields"]}
    for ids, own in equal.items():
        names = [known[i]["name"] for i in ids]
        there = {f["id"]: f["name"] for f in p.schema["fields"]}
        own_schema = struct([known[i] | {"name": f"__e{i}", "required": False} for i in ids])
        part = spark.read.schema(own_schema).parquet(*[canonical(d["data_file"]["file_path"]) for d in own])
        part = part.select(*[f"__e{i}" for i in ids], _clean_path(F.col("_metadata.file_path")).alias("__dfile"))
        rows = [(canonical(d["data_file"]["file_path"]), d["sequence_number"], repr(manifests.tuple_key(d)) if d["data_file"]["partition"] else None) for d in own]
        consts = spark.createDataFrame(rows, "__dfile string, __dseq long, __dtuple string")
        gone = part.join(F.broadcast(consts) if len(rows) <= BROADCAST_FILES else consts, "__dfile").drop("__dfile")
        if any(i not in there for i in ids):
            raise ValueError(f"equality delete on columns {names} that the schema no longer has")
        match = (df[SEQ] < gone["__dseq"]) & (gone["__dtuple"].isNull() | (gone["__dtuple"] == df[TUPLE]))
        for i in ids:
            match = match & df[f"`{there[i]}`"].eqNullSafe(gone[f"__e{i}"])
        df = df.join(gone, match, "left_anti")
    return df


def position_rows(spark, files: list[dict]) -> DataFrame:
    """(__dpath, __dpos, __dseq, __dtuple) of position delete files; tuple null where a file
    names its only target."""
    df = spark.read.schema("file_path string, pos long").parquet(*[canonical(d["data_file"]["file_path"]) for d in files])
    rows = [(canonical(d["data_file"]["file_path"]), d["sequence_number"], None if target_of(d) else repr(manifests.tuple_key(d))) for d in files]
    consts = spark.createDataFrame(rows, "__dfile string, __dseq long, __dtuple string")
    df = df.select(_clean_path(F.regexp_replace("file_path", "^/", "file:///")).alias("__dpath"), F.col("pos").alias("__dpos"), _clean_path(F.col("_metadata.file_path")).alias("__dfile"))
    return df.join(F.broadcast(consts) if len(rows) <= BROADCAST_FILES else consts, "__dfile").drop("__dfile")


def vector_rows(spark, vectors: list[dict]) -> DataFrame:
    """(__dpath, __dpos) of deletion vectors, decoded on the executors."""
    rows = [(canonical(d["data_file"]["file_path"]), canonical(target_of(d)), target_of(d), d["data_file"]["content_offset"], d["data_file"]["content_size_in_bytes"]) for d in vectors]
    refs = spark.createDataFrame(rows, "__vfile string, __dpath string, told string, at long, size long")
    blobs = spark.read.format("binaryFile").load(sorted({r[0] for r in rows})).select(_clean_path(F.col("path")).alias("__vfile"), "content")

    def run(batches):
        import pyarrow as pa

        from quarrylake.sources import puffin

        for batch in batches:
            for path, told, at, size, data in zip(*(batch.column(c).to_pylist() for c in ("__dpath", "told", "at", "size", "content"))):
                pos = puffin.read_vector(data, at, size, told)
                for k in range(0, len(pos), 100_000):
                    part = pos[k : k + 100_000]
                    yield pa.RecordBatch.from_pydict({"__dpath": [path] * len(part), "__dpos": part.astype("int64")})

    return blobs.join(F.broadcast(refs) if len(rows) <= BROADCAST_FILES else refs, "__vfile").mapInArrow(run, "__dpath string, __dpos long")


def row_range(spark, p: Plan, start: int, end: int | None) -> DataFrame:
    """Rows ``start <= n < end`` by manifest order, then file order, counted after deletes.

    Without deletes a row's number is arithmetic and other files are not opened; with them the
    rows left in each file are counted first, and only a file's rows are numbered together.
    """
    if start < 0 or end is not None and end < start:
        raise ValueError("a row range needs 0 <= start <= end")
    counts = [e["data_file"]["record_count"] for e in p.data]
    touched = _touched(p)
    if touched:
        left = {r[ORDINAL]: r["n"] for r in frame(spark, p, positions=True).groupBy(ORDINAL).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a file
        counts = [left.get(n, 0) for n in range(len(counts))]
    base, at = [], 0
    for n in counts:
        base.append(at)
        at += n
    stop = at if end is None else min(end, at)
    keep = [n for n in range(len(counts)) if base[n] < stop and base[n] + counts[n] > start]
    part = Plan(p.meta, p.schema, [p.data[n] for n in keep], p.deletes, p.total)
    df = frame(spark, part, positions=True)
    offsets = spark.createDataFrame([(k, base[n]) for k, n in enumerate(keep)] or [(-1, 0)], f"{ORDINAL} long, __base long")
    df = df.join(F.broadcast(offsets) if len(keep) <= BROADCAST_FILES else offsets, ORDINAL)
    number = F.col(POS) if not touched else F.row_number().over(Window.partitionBy(ORDINAL).orderBy(POS)) - 1
    df = df.withColumn("__n", F.col("__base") + number).where((F.col("__n") >= start) & (F.col("__n") < stop))
    return df.select(*[f"`{f['name']}`" for f in p.schema["fields"]])
