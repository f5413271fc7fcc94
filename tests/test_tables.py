"""Tables end to end: writes, deletes, evolution, commits, catalogs and SQL."""

import datetime as dt
import http.server
import json
import math
import threading
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarrylake.functions.types import schema_from
from quarrylake.operators import scan, write
from quarrylake.plans import commit
from quarrylake.plans.sql import query, references
from quarrylake.sources import credentials, manifests
from quarrylake.sources import metadata as md
from quarrylake.sources.catalog import FileCatalog, RestCatalog, RestError
from quarrylake.sources.fileio import AlreadyExists
from quarrylake.streaming.incremental import appended
from quarrylake.table import FileStore, Table


@pytest.fixture
def catalog(spark, tmp_path):
    return FileCatalog(spark, str(tmp_path / "w"))


def make(catalog, spark, rows, ddl, name="t", version=2, append=True, **more):
    df = spark.createDataFrame(rows, ddl).coalesce(1)
    t = catalog.create_table(name, schema_from(df.schema), version=version, **more)
    return t.append(df) if append else t


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_types_round_trip(spark, catalog):
    rows = [
        (1, 1 << 40, 1.5, 2.5, True, "é🙂", bytearray(b"\0\xff"), dt.date(1960, 2, 3), Decimal("1.25"), [1, None], {"a": 1}, (1, "x")),
        (None,) * 12,
        (2, -1, math.nan, -0.0, False, "", bytearray(b""), dt.date(2100, 1, 1), Decimal("-9.99"), [], {}, (None, None)),
    ]
    ddl = "i int, l long, f float, d double, b boolean, s string, y binary, dt date, p decimal(5,2), a array<int>, m map<string,int>, st struct<x:int,y:string>"
    t = make(catalog, spark, rows, ddl)
    df = spark.createDataFrame(rows, ddl).withColumn("ts", F.timestamp_micros(F.lit(-1234567)))
    assert list(map(str, values(t.read()))) == list(map(str, values(df.drop("ts"))))
    u = catalog.create_table("u", schema_from(df.schema)).append(df)
    assert u.read().where("ts = timestamp_micros(-1234567)").count() == 3
    e = t.plan().data
    nan = {k: sum((x["data_file"]["nan_value_counts"] or {}).get(k, 0) for x in e) for k in (3, 4)}
    assert nan == {3: 1, 4: 0} and sum(x["data_file"]["null_value_counts"][1] for x in e) == 1


def test_empty_tables(spark, catalog):
    t = make(catalog, spark, [], "id long, s string", append=False)
    assert t.read().count() == 0 and t.count() == 0 and t.read(where="id = 1").count() == 0 and t.read_range(0, 5).count() == 0
    assert query(spark, "SELECT count(*) n FROM t", catalog=catalog).first()["n"] == 0
    t.append(spark.createDataFrame([], "id long, s string"))
    assert t.count() == 0 and t.delete_where("id = 1").count() == 0
    with pytest.raises(ValueError):
        t.read(snapshot_id=99)


def test_alignment(spark, catalog):
    t = make(catalog, spark, [(1, "a")], "id long, s string", version=3)
    t.add_column("tag", "string", initial_default="old", write_default="new")
    t.append(spark.createDataFrame([(2,)], "id long")).append(spark.createDataFrame([(3, None)], "id long, tag string"))
    assert values(t.read()) == [(1, "a", "old"), (2, None, "new"), (3, None, None)]
    assert values(t.read(where="tag = 'old'")) == [(1, "a", "old")]
    with pytest.raises(ValueError, match="not in the schema"):
        t.append(spark.createDataFrame([(1, 2)], "id long, other int"))
    schema = {"type": "struct", "fields": [{"id": 1, "name": "id", "required": True, "type": "long"}, {"id": 2, "name": "x", "required": False, "type": "fixed[2]"}]}
    r = catalog.create_table("r", schema)
    with pytest.raises(ValueError, match="missing"):
        r.append(spark.createDataFrame([(bytearray(b"ab"),)], "x binary"))
    with pytest.raises(Exception, match="required column"):
        r.append(spark.createDataFrame([(None,)], "id long"))
    with pytest.raises(Exception, match="not 2 bytes"):
        r.append(spark.createDataFrame([(1, bytearray(b"abc"))], "id long, x binary"))
    assert r.append(spark.createDataFrame([(1, bytearray(b"ab"))], "id long, x binary")).count() == 1
    assert not [n for n in r.io.list(f"{r.location}/data") if n.startswith("_staging")]


def test_partition_tuples(spark, catalog):
    rows = [(1, 0.0, "a"), (2, -0.0, "a"), (3, math.nan, "a/b=c"), (4, None, None), (5, math.nan, "a/b=c"), (6, 0.0, "a")]
    t = make(catalog, spark, rows, "id long, x double, s string", spec=[{"source": "x", "transform": "identity"}, {"source": "s", "transform": "identity"}])
    assert len({manifests.tuple_key(e) for e in t.plan().data}) == 4
    assert values(t.read().select("id")) == [(i,) for i in range(1, 7)]
    assert values(t.read(where="x = 0", columns=["id"])) == [(1,), (2,), (6,)]
    assert values(t.read(where="x > 1", columns=["id"])) == [(3,), (5,)]
    assert values(t.read(where="s is null", columns=["id"])) == [(4,)] and len(t.plan("s is null").data) == 1


PREDICATES = [
    "n = 5", "n != 5", "n < 9", "n >= 5 and s = 'a'", "n > 5 or s = 'a'", "not (n = 5)", "not (n < 9 or s = 'b')", "n is null", "n is not null", "n in (5, 9)", "n in (5, null)",
    "n not in (5)", "n not in (5, null)", "5 < n", "s like 'a%'", "n + 0 = 5", "n <=> null", "ts >= timestamp'2026-08-12 00:00:00'", "s > 'a'", "not (s is null)", "id between 2 and 3",
    "n = cast('5' as int)", "n between 5 and 6 or id = 2", "s in ('a', 'zz')", "true", "false", "s != cast(n as string)", "coalesce(n, 9) = 9",
]


def test_pruned_equals_unpruned(spark, catalog):
    rows = [(1, 5, "a", dt.datetime(2026, 8, 11)), (2, None, None, None), (3, 9, "b", dt.datetime(2026, 8, 13))]
    ddl = "id long, n int, s string, ts timestamp"
    tables = [
        make(catalog, spark, rows, ddl, f"t{k}", append=False, spec=s)
        for k, s in enumerate([None, [{"source": "n", "transform": "identity"}], [{"source": "ts", "transform": "day"}, {"source": "s", "transform": "truncate[1]"}], [{"source": "n", "transform": "bucket[4]"}, {"source": "id", "transform": "void"}]])
    ]
    for t in tables:
        for r in rows:
            t.append(spark.createDataFrame([r], ddl).coalesce(1))
    whole = spark.createDataFrame(rows, ddl)
    for p in PREDICATES:
        want = [r["id"] for r in whole.where(p).orderBy("id").collect()]
        for t in tables:
            plan = t.plan(p)
            held = [r["id"] for r in scan.frame(spark, plan).where(p).orderBy("id").collect()]
            assert held == want, (p, t.location)
    assert len(tables[0].plan("id = 3").data) == 1 and len(tables[1].plan("n = 5").data) == 1 and len(tables[2].plan("ts >= timestamp'2026-08-13'").data) == 1


@pytest.mark.parametrize("version", [2, 3])
def test_deletes(spark, catalog, version):
    t = make(catalog, spark, [(i, f"n{i % 3}") for i in range(30)], "id long, name string", version=version, spec=[{"source": "name", "transform": "identity"}])
    first = t.meta["current-snapshot-id"]
    t.delete_where("id < 5").delete_where("id in (4, 10, 11)")
    assert [r["id"] for r in t.read().orderBy("id").collect()] == [5, 6, 7, 8, 9, *range(12, 30)]
    assert scan.count_from_metadata(t.io, t.meta) is None and t.count() == 23 and t.read(snapshot_id=first).count() == 30
    deletes = manifests.live(t.io, md.snapshot(t.meta))[1]
    if version == 3:
        targets = [scan.target_of(d) for d in deletes]
        assert all(map(scan.is_vector, deletes)) and len(targets) == len(set(targets))
    t.append(spark.createDataFrame([(0, "n0")], "id long, name string"))
    assert t.read(where="id = 0").count() == 1  # later rows are not touched
    t.rewrite(target_rows=7)
    data, left = manifests.live(t.io, md.snapshot(t.meta))
    assert not left and t.count() == 24 and max(e["data_file"]["record_count"] for e in data) <= 7
    with pytest.raises(Exception, match="not a data file"):
        t.delete(spark.createDataFrame([("/no/such", 0)], "file_path string, pos long"))
    with pytest.raises(ValueError):
        t.delete(spark.createDataFrame([("/x", 0)], "file_path string, pos long"), mode="parquet" if version == 3 else "puffin")
    if version == 3:
        path = data[0]["data_file"]["file_path"]
        with pytest.raises(ValueError, match="beyond"):
            t.delete(spark.createDataFrame([(path, 10_000)], "file_path string, pos long"))


def test_equality_deletes(spark, catalog):
    rows = [(1, math.nan, "a"), (2, None, "b"), (3, 0.0, None), (4, 1.0, "d")]
    t = make(catalog, spark, rows, "id long, x double, s string")
    t.delete_equal(spark.createDataFrame([(math.nan,), (None,)], "x double"))
    assert values(t.read().select("id")) == [(3,), (4,)]
    t.append(spark.createDataFrame([(5, None, "b")], "id long, x double, s string"))
    t.delete_equal(spark.createDataFrame([(0.0, None)], "x double, s string"))
    assert values(t.read().select("id")) == [(4,), (5,)]


def test_same_commit_sequences():
    data = {"sequence_number": 3, "spec_id": 0, "data_file": {"content": 0, "partition": {}, "file_path": "/a"}}
    at = lambda seq, content: {"sequence_number": seq, "spec_id": 0, "data_file": {"content": content, "partition": {}, "file_path": "/d", "file_format": "PARQUET"}}
    assert scan.applies(at(3, 1), data) and not scan.applies(at(3, 2), data) and scan.applies(at(4, 2), data) and not scan.applies(at(2, 1), data)
    other = at(4, 1) | {"spec_id": 1}
    assert not scan.applies(other, data)


def test_refs(spark, catalog):
    t = make(catalog, spark, [(1,)], "id long")
    one = t.meta["current-snapshot-id"]
    t.append(spark.createDataFrame([(2,)], "id long"))
    two = t.meta["current-snapshot-id"]
    t.set_ref("v1", one, "tag", max_ref_age_ms=5).set_ref("dev", two, min_snapshots_to_keep=2)
    assert t.read(ref="v1").count() == 1 and t.read(timestamp_ms=t.meta["snapshot-log"][0]["timestamp-ms"]).count() >= 1
    for bad in (lambda: t.set_ref("v1", one), lambda: t.set_ref("x", 5), lambda: t.set_ref("y", one, "tag", min_snapshots_to_keep=1), lambda: t.set_ref("main", one, "tag"), lambda: t.expire([one]), lambda: t.expire([two]), lambda: t.read(ref="none")):
        with pytest.raises(ValueError):
            bad()
    t.rollback(one)
    assert t.read().count() == 1
    t.append(spark.createDataFrame([(3,)], "id long"))
    assert values(t.read()) == [(1,), (3,)]
    assert t.snapshots().count() == 3 and t.manifests().count() == 2 and t.files().count() == 2


def test_incremental(spark, catalog):
    t = make(catalog, spark, [(1,)], "id long")
    first = t.meta["current-snapshot-id"]
    t.append(spark.createDataFrame([(2,)], "id long")).delete_where("id = 1").append(spark.createDataFrame([(3,)], "id long"))
    assert values(appended(t, first)) == [(2,), (3,)] and values(appended(t, None)) == [(1,), (2,), (3,)]
    with pytest.raises(ValueError):
        appended(t, 12)


def test_concurrent_appends(spark, catalog):
    make(catalog, spark, [], "id long", append=False)
    errors = []

    def add(i):
        try:
            catalog.load_table("t").append(spark.createDataFrame([(i,)], "id long").coalesce(1))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=add, args=(i,)) for i in range(6)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    t = catalog.load_table("t")
    assert not errors and values(t.read()) == [(i,) for i in range(6)] and len(t.meta["snapshots"]) == 6
    assert sorted(s["sequence-number"] for s in t.meta["snapshots"]) == list(range(1, 7))
    assert t.manifests().count() == 6 and len(catalog.versions("t")) == 7


def test_append_writes_data_once(spark, catalog, monkeypatch):
    t = make(catalog, spark, [], "id long", append=False)
    real, calls = t.store.commit, []

    def once(*a):
        calls.append(1)
        if len(calls) == 1:
            raise commit.CommitConflict("injected")
        return real(*a)

    monkeypatch.setattr(t.store, "commit", once)
    t.append(spark.createDataFrame([(1,)], "id long").coalesce(1))
    assert len(calls) == 2 and len(t.io.list(f"{t.location}/data")) == 1
    assert len([n for n in t.io.list(f"{t.location}/metadata") if n.startswith("snap-")]) == 1


def test_failed_append_leaves_nothing(spark, catalog, monkeypatch):
    t = make(catalog, spark, [], "id long", append=False)
    monkeypatch.setattr(t.store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("down")))
    with pytest.raises(RuntimeError):
        t.append(spark.createDataFrame([(1,)], "id long"))
    assert t.io.list(f"{t.location}/data") == [] and not [n for n in t.io.list(f"{t.location}/metadata") if n.endswith(".avro")]


def test_transactions(spark, catalog):
    t = make(catalog, spark, [(1,)], "id long")
    one = t.meta["current-snapshot-id"]
    with t.transaction() as x:
        x.append(spark.createDataFrame([(2,)], "id long")).append(spark.createDataFrame([(3,)], "id long")).set_ref("keep", one, "tag")
    assert values(t.read()) == [(1,), (2,), (3,)] and t.read(ref="keep").count() == 1 and len(catalog.versions("t")) == 3
    before = set(t.io.list(f"{t.location}/data"))
    with pytest.raises(KeyError):
        with t.transaction() as x:
            x.append(spark.createDataFrame([(4,)], "id long"))
            raise KeyError("stop")
    assert set(t.io.list(f"{t.location}/data")) == before
    stale = catalog.load_table("t")
    t.append(spark.createDataFrame([(5,)], "id long"))
    with pytest.raises(commit.CommitConflict):
        with stale.transaction() as x:
            x.append(spark.createDataFrame([(6,)], "id long"))
    with pytest.raises(commit.CommitConflict):
        old = catalog.load_table("t")
        t.append(spark.createDataFrame([(7,)], "id long"))
        old.rewrite()
    assert values(catalog.load_table("t").read()) == [(1,), (2,), (3,), (5,), (7,)]


def test_lineage(spark, catalog):
    t = make(catalog, spark, [(1,), (2,), (3,)], "id long", version=3)
    t.append(spark.createDataFrame([(4,), (5,)], "id long").coalesce(1)).delete_where("id = 2")
    before = {r["id"]: (r["_row_id"], r["_last_updated_sequence_number"]) for r in t.read(lineage=True).collect()}
    assert sorted(before.values()) == [(0, 1), (2, 1), (3, 2), (4, 2)] and t.meta["next-row-id"] == 5
    t.rewrite()
    assert {r["id"]: (r["_row_id"], r["_last_updated_sequence_number"]) for r in t.read(lineage=True).collect()} == before
    t.append(spark.createDataFrame([(6,)], "id long"))
    ids = [r["_row_id"] for r in t.read(lineage=True).collect()]
    assert len(ids) == len(set(ids))
    old = make(catalog, spark, [(1,)], "id long", "old")
    assert old.read(lineage=True).select("_row_id", "_last_updated_sequence_number").first() == (None, None)


def test_row_ranges(spark, catalog):
    t = make(catalog, spark, [(i,) for i in range(10)], "id long", sort_order=[{"source": "id"}])
    t.append(spark.createDataFrame([(i,) for i in range(10, 20)], "id long").coalesce(1))
    order = [e["data_file"]["lower_bounds"][1][0] for e in t.plan().data]
    rows = [i for lo in order for i in range(lo, lo + 10)]
    assert values(t.read_range(8, 13)) == sorted(((i,) for i in rows[8:13]), key=str) and t.read_range(5, 5).count() == 0 and t.read_range(15).count() == 5
    t.delete_where("id % 3 = 0")
    rows = [i for i in rows if i % 3]
    assert values(t.read_range(4, 9)) == sorted(((i,) for i in rows[4:9]), key=str)
    with pytest.raises(ValueError):
        t.read_range(5, 2)


def test_sort_order_in_files(spark, catalog):
    rows = [(3, "b"), (None, "a"), (1, "c"), (2, None)]
    t = make(catalog, spark, rows, "id long, s string", sort_order=[{"source": "id", "direction": "desc", "null-order": "nulls-first"}])
    assert [r["id"] for r in scan.frame(spark, t.plan(), positions=True).orderBy(scan.POS).collect()] == [None, 3, 2, 1]
    assert t.plan().data[0]["data_file"]["sort_order_id"] == 1


def test_files_without_ids(spark, catalog, tmp_path):
    """Foreign files: columns by name mapping or name, the rest by partition, default and null."""
    df = spark.createDataFrame([(1, "x")], "num long, full_name string").coalesce(1)
    df.write.parquet(str(tmp_path / "foreign"))
    path = next(p for p in (tmp_path / "foreign").iterdir() if p.suffix == ".parquet")
    fields = [("num", "long"), ("renamed", "string"), ("tag", "string"), ("day", "date"), ("none", "int")]
    schema = {"type": "struct", "fields": [{"id": i + 1, "name": n, "required": False, "type": t} | ({"initial-default": "dflt"} if n == "tag" else {}) for i, (n, t) in enumerate(fields)]}
    mapping = json.dumps([{"field-id": 1, "names": ["num"]}, {"field-id": 2, "names": ["old", "full_name"]}])
    t = catalog.create_table("f", schema, [{"source": "day", "transform": "identity"}], properties={"schema.name-mapping.default": mapping}, version=3)
    from quarrylake.operators import write

    e = {"status": 1, "spec_id": 0, "data_file": {"content": 0, "file_path": str(path), "file_format": "PARQUET", "partition": {"day": dt.date(2020, 1, 2)}, "record_count": 1, "file_size_in_bytes": path.stat().st_size}}
    t.commit_append(write.Staged([e], [], 1))
    assert values(t.read()) == [(1, "x", "dflt", dt.date(2020, 1, 2), None)]
    assert t.read(where="day = date'2020-01-02'").count() == 1 and not t.plan("day = date'2020-01-03'").data


def test_nested_names(spark, catalog, tmp_path):
    """Fields inside structs, lists and maps of foreign files, by the mapping or by name."""
    spark.sql("""select named_struct('old', 1L, 'same', 'x', 'extra', 2) s, array(named_struct('q', 3), null) l, map('k', named_struct('v', 4L)) m
        union all select null, null, null""").coalesce(1).write.parquet(str(tmp_path / "foreign"))
    path = next(p for p in (tmp_path / "foreign").iterdir() if p.suffix == ".parquet")
    field = lambda i, name, t, **more: {"id": i, "name": name, "required": False, "type": t, **more}
    inner = {"type": "struct", "fields": [field(10, "same", "string"), field(11, "new", "long"), field(12, "none", "int"), field(13, "told", "int", **{"initial-default": 7})]}
    listed = {"type": "list", "element-id": 20, "element-required": False, "element": {"type": "struct", "fields": [field(21, "n", "int")]}}
    mapped = {"type": "map", "key-id": 30, "key": "string", "value-id": 31, "value-required": False, "value": {"type": "struct", "fields": [field(32, "w", "long")]}}
    schema = {"type": "struct", "fields": [field(1, "s", inner), field(2, "items", listed), field(3, "m", mapped)]}
    names = [
        {"field-id": 1, "names": ["s"], "fields": [{"field-id": 11, "names": ["older", "old"]}]},
        {"field-id": 2, "names": ["l"], "fields": [{"field-id": 20, "names": ["element"], "fields": [{"field-id": 21, "names": ["q"]}]}]},
        {"field-id": 3, "names": ["m"], "fields": [{"field-id": 31, "names": ["value"], "fields": [{"field-id": 32, "names": ["v"]}]}]},
    ]
    t = catalog.create_table("nested", schema, properties={"schema.name-mapping.default": json.dumps(names)}, version=3)
    from quarrylake.operators import write

    e = {"status": 1, "spec_id": 0, "data_file": {"content": 0, "file_path": str(path), "file_format": "PARQUET", "partition": {}, "record_count": 2, "file_size_in_bytes": path.stat().st_size}}
    t.commit_append(write.Staged([e], [], 2))
    rows = [json.loads(x) for x in t.read().orderBy(F.col("s").isNull()).toJSON().collect()]
    assert rows[0] == {"s": {"same": "x", "new": 1, "told": 7}, "items": [{"n": 3}, None], "m": {"k": {"w": 4}}} and rows[1] == {}
    assert [r["n"] for r in t.read().where("s is not null").select(F.col("s.new").alias("n")).collect()] == [1]


def test_vectors_in_several_files(spark, catalog, monkeypatch):
    """Deletion vectors beyond the size of a file begin another."""
    monkeypatch.setattr("quarrylake.table.PUFFIN_BYTES", 1)
    t = make(catalog, spark, [(i, f"n{i % 3}") for i in range(30)], "id long, name string", version=3, spec=[{"source": "name", "transform": "identity"}])
    t.delete_where("id < 10").delete_where("id in (4, 12, 13)")
    deletes = manifests.live(t.io, md.snapshot(t.meta))[1]
    assert len({d["data_file"]["file_path"] for d in deletes}) == 3
    assert [r["id"] for r in t.read().orderBy("id").collect()] == [10, 11, *range(14, 30)]
    assert not [n for n in t.io.list(f"{t.location}/data") if n.startswith("_staging")]


def test_storage_settings(spark):
    """What a catalog service says about a table's bucket reaches Hadoop's configuration, for that bucket."""
    told = {
        "config": {"client.region": "r-1", "s3.access-key-id": "table"},
        "storage-credentials": [
            {"prefix": "s3://held/t", "config": {"s3.access-key-id": "near", "s3.secret-access-key": "s", "s3.session-token": "w"}},
            {"prefix": "s3://held", "config": {"s3.access-key-id": "far"}},
            {"prefix": "s3://other", "config": {"s3.access-key-id": "o", "s3.secret-access-key": "p"}},
        ],
    }
    got = credentials.by_bucket(told, "s3a://held/t/x", {"s3.endpoint": "http://e"})
    assert got["held"] == {"s3.endpoint": "http://e", "client.region": "r-1", "s3.access-key-id": "near", "s3.secret-access-key": "s", "s3.session-token": "w"}
    assert got["other"]["s3.access-key-id"] == "o" and credentials.by_bucket({}, "/local/t") == {}
    credentials.apply(spark, got)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert conf.get("fs.s3a.bucket.held.access.key") == "near" and conf.get("fs.s3a.bucket.held.endpoint.region") == "r-1"
    assert conf.get("fs.s3a.bucket.held.aws.credentials.provider").endswith("TemporaryAWSCredentialsProvider")
    assert conf.get("fs.s3a.bucket.other.aws.credentials.provider").endswith("SimpleAWSCredentialsProvider") and conf.get("fs.s3a.access.key") is None


def test_special_types(spark, catalog):
    schema = {"type": "struct", "fields": [{"id": i + 1, "name": n, "required": False, "type": t} for i, (n, t) in enumerate([("id", "long"), ("ns", "timestamp_ns"), ("v", "variant"), ("g", "geometry"), ("u", "uuid"), ("nothing", "unknown"), ("time", "time")])]}
    t = catalog.create_table("s", schema, version=3)
    from quarrylake.functions import geo

    wkb = bytearray(geo.to_wkb({"type": "LineString", "coordinates": [[1, 5], [3, 2]]}))
    df = spark.createDataFrame([(1, 10**18, wkb, bytearray(b"u" * 16), 7)], "id long, ns long, g binary, u binary, time long").withColumn("v", F.parse_json(F.lit('{"a": [1, null]}')))
    t.append(df)
    r = t.read().withColumn("v", F.to_json("v")).first()
    assert (r["ns"], r["v"], r["g"], r["nothing"], r["time"]) == (10**18, '{"a":[1,null]}', wkb, None, 7)
    d = t.plan().data[0]["data_file"]
    import struct

    assert struct.unpack("<2d", d["lower_bounds"][4]) == (1, 2) and struct.unpack("<2d", d["upper_bounds"][4]) == (3, 5) and 3 not in d["lower_bounds"]


def test_sql(spark, catalog):
    make(catalog, spark, [(i, i % 3) for i in range(30)], "id long, k long", "ns.a", spec=[{"source": "k", "transform": "identity"}])
    b = spark.createDataFrame([(0, "zero"), (1, "one")], "k long, w string")
    text = 'WITH a2 AS (SELECT * FROM "ns.a" WHERE k < 2) SELECT b.w, count(*) AS n FROM a2 JOIN b ON a2.k = b.k GROUP BY b.w'
    assert references(spark, text) == ["ns.a", "b"]
    assert values(query(spark, text, {"b": b}, catalog)) == [("one", 10), ("zero", 10)]
    assert query(spark, "SELECT 1 AS x").first()["x"] == 1
    self_join = 'SELECT count(*) n FROM "ns.a" x JOIN "ns.a" y ON x.id = y.id WHERE x.k = 0 AND y.k = 0'
    assert query(spark, self_join, catalog=catalog).first()["n"] == 10
    assert query(spark, 'SELECT count(*) n FROM (SELECT * FROM "ns.a" WHERE k = 0 UNION ALL SELECT * FROM "ns.a" WHERE id = 29)', catalog=catalog).first()["n"] == 11
    assert query(spark, 'SELECT count(*) n FROM "ns.a" WHERE id = (SELECT max(id) FROM "ns.a" WHERE k = 1)', catalog=catalog).first()["n"] == 1
    with pytest.raises(ValueError, match="not found"):
        query(spark, "SELECT * FROM missing", {})
    df = query(spark, 'SELECT id FROM "ns.a" WHERE k = 1', catalog=catalog)
    assert len(df.inputFiles()) == len(catalog.load_table("ns.a").plan("k = 1").data)


def test_file_catalog(spark, catalog):
    t = make(catalog, spark, [(1,)], "id long", "ns.t")
    with pytest.raises(AlreadyExists):
        catalog.create_table("ns.t", schema_from(t.read().schema))
    t.set_properties(**{"a": 1}).update_properties({"write.metadata.previous-versions-max": "2", "write.metadata.delete-after-commit.enabled": "true"}, ["a"])
    for _ in range(3):
        t.set_properties(b=2)
    assert len(t.meta["metadata-log"]) == 2 and t.meta["properties"].get("a") is None and len(catalog.versions("ns.t")) == 3
    assert catalog.list_tables("ns") == ["t"] and catalog.table_exists("ns.t")
    t.io.delete(f"{t.location}/metadata/version-hint.text")
    old = catalog.load_table("ns.t", catalog.versions("ns.t")[0])
    assert old.read().count() == 1 and catalog.load_table("ns.t").count() == 1
    catalog.drop_table("ns.t", purge=True)
    assert not catalog.table_exists("ns.t")
    with pytest.raises(FileNotFoundError):
        catalog.load_table("ns.t")


class Service(http.server.BaseHTTPRequestHandler):
    """A REST catalog over file-based tables, for the client's tests."""

    spark = root = None
    tables: dict = {}
    seen: list = []
    conflicts = 0

    def log_message(self, *a):
        pass

    def answer(self, body, status=200):
        data = json.dumps(body).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def handle_any(self):
        body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
        path, _, q = self.path.partition("?")
        Service.seen.append((self.command, self.path, dict(self.headers)))
        parts = path.split("/")[2:]
        if parts == ["config"]:
            return self.answer({"defaults": {"prefix": "no"}, "overrides": {"prefix": "p"}})
        assert parts[0] == "p"
        parts = parts[1:]
        if parts == ["namespaces"]:
            if self.command == "POST":
                return self.answer(body)
            return self.answer({"namespaces": [["b"]]} if "pageToken" in q else {"namespaces": [["a", "x"]], "next-page-token": "2"})
        if parts[0] == "tables":
            Service.tables[".".join([*body["destination"]["namespace"], body["destination"]["name"]])] = Service.tables.pop(".".join([*body["source"]["namespace"], body["source"]["name"]]))
            return self.answer({})
        name = f"{parts[1].replace('%1F', '.')}.{parts[3] if len(parts) > 3 else body.get('name')}"
        if self.command == "POST" and len(parts) == 3 and parts[2] == "tables":
            meta = FileCatalog(Service.spark, Service.root).create_table(name, body["schema"], version=int(body["properties"]["format-version"])).meta
            Service.tables[name] = meta
            return self.answer({"metadata": meta, "metadata-location": "m"})
        if len(parts) == 3 and parts[2] == "tables":
            return self.answer({"identifiers": [{"namespace": n.split(".")[:-1], "name": n.split(".")[-1]} for n in Service.tables]})
        if name not in Service.tables:
            return self.answer({"error": {"type": "NoSuchTableException", "message": name, "code": 404}}, 404)
        if self.command == "DELETE":
            Service.tables.pop(name)
            return self.answer({})
        if parts[-1] == "credentials":
            return self.answer({"storage-credentials": [{"prefix": "x"}]})
        if self.command == "POST":
            if Service.conflicts:
                Service.conflicts -= 1
                return self.answer({"error": {"type": "CommitFailedException", "message": "again"}}, 409)
            commit.check(Service.tables[name], body["requirements"])
            Service.tables[name] = commit.apply(Service.tables[name], body["updates"])
        return self.answer({"metadata": Service.tables[name], "metadata-location": "m"})

    do_GET = do_POST = do_DELETE = handle_any


def test_rest_catalog(spark, tmp_path):
    Service.spark, Service.root, Service.tables, Service.seen = spark, str(tmp_path / "rest"), {}, []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        c = RestCatalog(spark, f"http://127.0.0.1:{server.server_port}", token="tok", sign=lambda m, u, h, b: {"X-Signed": m})
        assert c.list_namespaces() == ["a.x", "b"] and c.create_namespace("a.x")["namespace"] == ["a", "x"]
        t = c.create_table("a.x.t", schema_from(spark.createDataFrame([], "id long").schema))
        assert "/namespaces/a%1Fx/tables" in Service.seen[-1][1] and Service.seen[-1][2]["Authorization"] == "Bearer tok" and Service.seen[-1][2]["X-Signed"] == "POST"
        t.append(spark.createDataFrame([(1,)], "id long"))
        Service.conflicts = 2
        t.append(spark.createDataFrame([(2,)], "id long"))
        assert values(c.load_table("a.x.t").read()) == [(1,), (2,)] and len(Service.tables["a.x.t"]["snapshots"]) == 2
        assert query(spark, 'SELECT sum(id) s FROM "a.x.t"', catalog=c).first()["s"] == 3
        assert c.list_tables("a.x") == ["a.x.t"] and c.load_credentials("a.x.t") == [{"prefix": "x"}]
        c.load_table("a.x.t", delegation="vended-credentials")
        assert Service.seen[-2][2]["X-Iceberg-Access-Delegation"] == "vended-credentials" and Service.seen[-1][1].endswith("/credentials")
        c.rename_table("a.x.t", "a.x.u")
        with pytest.raises(RestError) as e:
            c.load_table("a.x.t")
        assert (e.value.status, e.value.kind) == (404, "NoSuchTableException")
        c.drop_table("a.x.u", purge=True)
        assert Service.seen[-1][1].endswith("purgeRequested=true")
    finally:
        server.shutdown()


def test_reload_sees_other_commits(spark, catalog):
    t = make(catalog, spark, [(1,)], "id long")
    other = Table.load(spark, FileStore(t.io, t.location))
    other.append(spark.createDataFrame([(2,)], "id long"))
    assert t.read().count() == 1 and t.refresh().read().count() == 2
    assert t.append(spark.createDataFrame([(3,)], "id long")).read().count() == 3


def test_filters_above_projections(spark, catalog):
    """Renames, swaps and self joins read the same with pruning and without."""
    t = make(catalog, spark, [(k, 100 - k) for k in range(10)], "a int, b int")
    for k in range(10, 40, 10):
        t.append(spark.createDataFrame([(x, 100 - x) for x in range(k, k + 10)], "a int, b int").coalesce(1))
    for text in (
        "SELECT * FROM (SELECT a AS b, b AS a, rand() AS r FROM t) x WHERE a < 70 AND r >= 0",
        "SELECT * FROM (SELECT a AS c, b + 1 AS a, rand() AS r FROM t) x WHERE a = 100 AND c < 5 AND r >= 0",
        "SELECT x.a, y.a AS z FROM (SELECT a, b FROM t WHERE a < 10) x JOIN (SELECT b AS a, a AS b FROM t) y ON x.a = y.b WHERE y.a > 95",
        "SELECT a FROM (SELECT a, b, rand() AS r FROM t) x WHERE a BETWEEN 12 AND 14 AND r >= 0",
    ):
        names = ("a", "b", "c", "z")
        got, want = ([sorted(tuple(r[n] for n in names if n in r) for r in query(spark, text, {"t": t}, prune=p).collect()) for p in (True, False)])
        assert got == want and got


def test_manifests_are_pruned_and_decoded_by_tasks(spark, catalog, monkeypatch):
    t = make(catalog, spark, [(0, None)], "d int, s string", spec=[{"source": "d", "transform": "truncate[10]"}, {"source": "s", "transform": "identity"}])
    for k in range(10, 50, 10):
        t.append(spark.createDataFrame([(k, f"s{k}"), (k + 5, None)], "d int, s string"))
    wheres = ("d = 23", "d in (11, 48)", "s = 's30'", "s is null and d > 35", "not (d < 20)", "d < 5 or s = 's40'", "s <> 's10'")
    read: list = []
    true = manifests.read_entries
    monkeypatch.setattr(manifests, "read_entries", lambda io, row: read.append(row) or true(io, row))
    want = {}
    for w in wheres:
        tree = _tree(spark, t, w)
        read.clear()
        want[w] = sorted(scan.plan(t.io, t.meta, predicate=tree).paths)
        pruned = len(read)
        full = [e["data_file"]["file_path"] for e in scan.plan(t.io, t.meta).data if scan.Pruner(t.meta, t.schema).keeps(e, tree)]
        assert want[w] == sorted(full)
        assert pruned < 5 or w == "s <> 's10'"
    monkeypatch.setattr(manifests, "MANY", 0)
    monkeypatch.setattr(manifests, "read_entries", true)
    for w in wheres[:3]:
        plan = scan.plan(t.io, t.meta, predicate=_tree(spark, t, w), spark=spark)
        assert sorted(plan.paths) == want[w] and plan.total == 9


def _tree(spark, t, where):
    from quarrylake.table import condition_tree

    return condition_tree(spark, scan.plan(t.io, t.meta), where)


def test_hadoop_files_appear_whole(spark, tmp_path):
    from quarrylake.sources.fileio import HadoopIO

    io, path = HadoopIO(spark), f"file://{tmp_path}/x/v1.metadata.json"
    io.write(path, b"one", only_new=True)
    with pytest.raises(AlreadyExists):
        io.write(path, b"two", only_new=True)
    assert io.read(path) == b"one" and io.list(f"file://{tmp_path}/x") == ["v1.metadata.json"]
    io.write(path, b"three")
    assert io.read(path) == b"three"


def test_rewrite_takes_no_new_row_ids(spark, catalog):
    t = make(catalog, spark, [(k,) for k in range(6)], "a int", version=3)
    before, ids = t.meta["next-row-id"], values(t.read(lineage=True).select("a", "_row_id"))
    t.rewrite()
    assert t.meta["next-row-id"] == before and values(t.read(lineage=True).select("a", "_row_id")) == ids
    t.append(spark.createDataFrame([(9,)], "a int"))
    assert (9, before) in values(t.read(lineage=True).select("a", "_row_id"))


def test_statistics_sort_no_rows(spark, catalog):
    """Least and greatest texts of a file need no sort of its rows, and come out as by hand."""
    rows = [(i, f"{(i * 7919) % 1000:04d} and a tail beyond the bound", None if i % 3 else "é") for i in range(300)]
    t = make(catalog, spark, rows, "id long, s string, n string", spec=[{"source": "id", "transform": "truncate[2]"}])
    staged = spark.read.parquet(*[e["data_file"]["file_path"] for e in t.plan().data])
    plan = write.per_file(staged, [F.min("s"), F.max("s")])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan
    assert len(t.plan().data) == 150  # more than Spark keeps in its map of objects
    for e in t.plan().data:
        d = e["data_file"]
        own = [r for r in rows if r[0] - r[0] % 2 == d["partition"]["id_truncate"]]
        assert d["lower_bounds"][2] == min(r[1] for r in own)[:16].encode() and d["upper_bounds"][2] > max(r[1] for r in own)[:16].encode()
        assert d["null_value_counts"] == {1: 0, 2: 0, 3: sum(r[2] is None for r in own)} and d["record_count"] == len(own)


def test_partitioned_append_sorts_no_rows_for_statistics(spark, catalog, monkeypatch):
    plans, made = [], write.per_file
    monkeypatch.setattr(write, "per_file", lambda *a: (df := made(*a), plans.append(df._jdf.queryExecution().executedPlan().toString()))[0])
    t = make(catalog, spark, [(dt.datetime(2020, 1 + i % 12, 1), "ANR"[i % 3], f"t{i}") for i in range(48)], "ts timestamp_ntz, f string, s string", spec=[{"source": "ts", "transform": "month"}, {"source": "f", "transform": "identity"}])
    t.delete_where("s = 't7'")
    assert len(plans) == 2 and not any("SortAggregate" in x for x in plans) and t.read().count() == 47


def test_ranged_append_deals_rows_in_order(spark, catalog, monkeypatch):
    """More ranges than the session's partitions where rows are many; files follow each other in the
    order, so ranges of rows do too, with deletes and after a rewrite."""
    monkeypatch.setattr(write, "RANGE_ROWS", 50)
    df = spark.range(0, 1000, 1, 3).select((F.col("id") * 7 % 1000).alias("id"))
    t = catalog.create_table("t", schema_from(df.schema), sort_order=[{"source": "id"}]).append(df, ranged=True)
    counts = [e["data_file"]["record_count"] for e in t.plan().data]
    assert len(counts) > 12 and max(counts) < 200 and sum(counts) == 1000
    assert [r[0] for r in t.read_range(300, 420).orderBy("id").collect()] == list(range(300, 420))
    t.delete_where("id % 4 = 0")
    left = [i for i in range(1000) if i % 4]
    assert [r[0] for r in t.read_range(300, 420).orderBy("id").collect()] == left[300:420]
    t.rewrite()
    assert max(e["data_file"]["record_count"] for e in t.plan().data) < 200 and [r[0] for r in t.read_range(300, 420).orderBy("id").collect()] == left[300:420]


def test_no_row_carries_its_path_through_a_delete(spark, catalog):
    t = make(catalog, spark, [(i, i % 2) for i in range(20)], "id long, p long", spec=[{"source": "p", "transform": "identity"}]).delete_where("id in (3, 4, 11)")
    df = t.read()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    anti = next(line for line in plan.splitlines() if "LeftAnti" in line)
    assert "__ordinal" in anti and "__path" not in anti and values(df) == sorted(((i, i % 2) for i in range(20) if i not in (3, 4, 11)), key=str)


def test_many_files_stay_where_they_are_written(spark, catalog, monkeypatch):
    """Appended files are not moved one by one, and no task a folder lists them."""
    moved = []
    monkeypatch.setattr(write, "_move", lambda *a: moved.append(a))
    t = make(catalog, spark, [(i,) for i in range(40)], "id long", spec=[{"source": "id", "transform": "identity"}])
    assert not moved and len({p.split("/data/")[1].split("/")[0] for p in t.plan().paths}) == 1 and len(t.plan().paths) == 40
    assert int(spark.conf.get(scan.LISTERS)) < 10_000 and values(t.read("id >= 38")) == [(38,), (39,)]
