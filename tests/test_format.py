"""Codecs, single values, transforms, schema rules and requirements, without Spark."""

import datetime as dt
import math
import random
import struct
import zlib
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylake.functions import geo, serde, transforms, types
from quarrylake.operators.prune import Pruner, negate
from quarrylake.plans import commit
from quarrylake.sources import avro, manifests, puffin, sigv4
from quarrylake.sources import metadata as md
from quarrylake.sources.fileio import AlreadyExists, CachingIO, LocalIO
from quarrylake.table import new_metadata

SCHEMA = {"type": "struct", "fields": [{"id": i + 1, "name": n, "required": False, "type": t} for i, (n, t) in enumerate([("id", "long"), ("name", "string"), ("ts", "timestamp"), ("price", "double"), ("d", "date")])]}


def test_bucket_vectors():
    h = lambda v, t: transforms.murmur3(transforms.hash_bytes(v, t))
    assert h(34, "int") == h(34, "long") == 2017239379
    assert h(dt.date(2017, 11, 16), "date") == -653330422
    assert h(dt.datetime(2017, 11, 16, 22, 31, 8), "timestamp") == -2047944441
    assert h(81068000000, "time") == -662762989
    assert h(Decimal("14.20"), "decimal(9, 2)") == -500754589
    assert h("iceberg", "string") == 1210000089
    assert h(b"\0\1\2\3", "fixed[4]") == -188683207
    assert h("f79c3e09-677c-4bbd-a479-3f349cb785e7", "uuid") == 1488055340
    assert transforms.apply("bucket[100]", 34, "int") == 79 and transforms.apply("bucket[4]", 1, "int") == 0 and transforms.apply("bucket[4]", 6, "int") == 1


def test_time_and_truncate():
    before = dt.datetime(1969, 12, 31, 23, 59, 59, 999999)
    assert [transforms.apply(t, before, "timestamp") for t in ("year", "month", "day", "hour")] == [-1] * 4
    assert transforms.apply("day", dt.date(2017, 11, 16), "date") == 17486
    assert [transforms.apply("truncate[10]", v, "int") for v in (-11, -1, 0, 9, 10)] == [-20, -10, 0, 0, 10]
    assert transforms.apply("truncate[3]", "a😀bc", "string") == "a😀b"
    assert transforms.apply("truncate[50]", Decimal("10.65"), "decimal(9, 2)") == Decimal("10.50")
    assert transforms.apply("void", 5, "int") is None
    for bad in ("hour", "year"):
        with pytest.raises(ValueError):
            transforms.validate(bad, "date" if bad == "hour" else "string")


VALUES = [
    ("boolean", True), ("int", -5), ("long", 1 << 40), ("float", 1.5), ("double", -0.25), ("date", -3), ("time", 5), ("timestamp", -1), ("timestamptz", 7),
    ("string", "é🙂"), ("binary", b"\0\xff"), ("fixed[2]", b"ab"), ("decimal(9, 2)", Decimal("-14.20")), ("decimal(38, 0)", Decimal(10**37)), ("timestamp_ns", 9),
]


@pytest.mark.parametrize("t,v", VALUES)
def test_single_values(t, v):
    assert serde.from_bytes(serde.to_bytes(v, t), t) == v


def test_single_value_bytes():
    assert serde.to_bytes(Decimal("14.20"), "decimal(9, 2)") == b"\x05\x8c"
    assert serde.to_bytes("f79c3e09-677c-4bbd-a479-3f349cb785e7", "uuid").hex() == "f79c3e09677c4bbda4793f349cb785e7"
    assert serde.from_bytes(struct.pack("<i", 7), "long") == 7 and serde.from_bytes(struct.pack("<f", 0.5), "double") == 0.5
    assert serde.decimal_bytes(127) == b"\x7f" and serde.decimal_bytes(128) == b"\0\x80" and serde.decimal_bytes(-128) == b"\x80"


def test_bound_truncation():
    assert serde.truncate_lower("a" * 20, "string") == "a" * 16
    assert serde.truncate_upper("a" * 20, "string") == "a" * 15 + "b"
    assert serde.truncate_upper("\U0010ffff" * 17, "string") is None
    assert serde.truncate_upper(b"\xff" * 17, "binary") is None
    assert serde.truncate_upper(b"\x01" + b"\xff" * 17, "binary") == b"\x02"
    assert serde.truncate_upper("퟿"[:1] * 17, "string")[-1] == ""


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=1, max_size=30).filter(lambda s: not any(0xD800 <= ord(c) <= 0xDFFF for c in s)))
def test_bounds_hold(s):
    up = serde.truncate_upper(s, "string")
    assert serde.truncate_lower(s, "string") <= s and (up is None or s <= up)


def test_order():
    v = [math.nan, 0.0, -0.0, 5.0, -math.inf]
    assert [str(x) for x in sorted(v, key=lambda x: serde.order_key(x, "double"))] == ["-inf", "-0.0", "0.0", "5.0", "nan"]


AVRO = {
    "type": "record", "name": "r",
    "fields": [
        {"name": "a", "type": ["null", "long"]}, {"name": "s", "type": "string"}, {"name": "f", "type": {"type": "fixed", "name": "fx", "size": 2}},
        {"name": "e", "type": {"type": "enum", "name": "en", "symbols": ["x", "y"]}}, {"name": "l", "type": {"type": "array", "items": "int"}},
        {"name": "m", "type": {"type": "map", "values": "double"}}, {"name": "d", "type": {"type": "int", "logicalType": "date"}},
        {"name": "t", "type": {"type": "long", "logicalType": "timestamp-micros", "adjust-to-utc": False}},
        {"name": "ms", "type": {"type": "long", "logicalType": "timestamp-millis", "adjust-to-utc": True}},
        {"name": "p", "type": {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}}, {"name": "b", "type": "boolean"},
        {"name": "k", "type": {"type": "array", "logicalType": "map", "items": {"type": "record", "name": "kv", "fields": [{"name": "key", "type": "int"}, {"name": "value", "type": "bytes"}]}}},
        {"name": "n", "type": {"type": "long", "logicalType": "no-such-type"}}, {"name": "again", "type": "fx"},
    ],
}


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro_round_trip(codec):
    row = {
        "a": None, "s": "é", "f": b"ab", "e": "y", "l": [1, -2], "m": {"q": 0.5}, "d": dt.date(1969, 1, 1), "t": dt.datetime(2020, 1, 2, 3, 4, 5, 6),
        "ms": dt.datetime(2020, 1, 2, tzinfo=dt.timezone.utc), "p": Decimal("-1.25"), "b": True, "k": {3: b"x"}, "n": 1 << 60, "again": b"cd",
    }
    rows = [row | {"a": i if i % 2 else None} for i in range(1200)]
    got, head = avro.read(avro.write(rows, AVRO, {"extra": "1"}, codec=codec))
    assert got == rows and head["extra"] == "1"
    assert avro.read(avro.write([], AVRO))[0] == []
    with pytest.raises(ValueError):
        avro.read(b"nope")
    with pytest.raises(ValueError):
        avro.write([{"s": None}], AVRO)


@pytest.mark.parametrize("values", [[], [0], [5, 1 << 33, (1 << 33) + 1], list(range(10, 70_000)), list(range(0, 300_000, 7))])
def test_deletion_vectors(values):
    assert puffin.decode_vector(puffin.encode_vector(values)).tolist() == values


def test_run_containers_and_damage():
    runs = struct.pack("<I", 12347) + b"\x01" + struct.pack("<HH", 0, 9) + struct.pack("<H", 2) + struct.pack("<HHHH", 3, 4, 20, 4)
    assert puffin.parse_roaring32(runs)[0].tolist() == [3, 4, 5, 6, 7, 20, 21, 22, 23, 24]
    blob = bytearray(puffin.encode_vector([1, 2, 3]))
    blob[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        puffin.decode_vector(bytes(blob))
    data, places = puffin.write([(puffin.encode_vector([4]), {"referenced-data-file": "a"}, 0), (puffin.encode_vector([9]), {"referenced-data-file": "b"}, 0)])
    assert puffin.read_vector(data, *places[1], "b").tolist() == [9]
    with pytest.raises(ValueError):
        puffin.read_vector(data, *places[1], "a")
    with pytest.raises(ValueError):
        puffin.read_vector(data, places[1][0] + 1, places[1][1])


def test_sanitize():
    assert types.sanitize("Breed Name") == "Breed_x20Name" and types.sanitize("9x") == "_9x" and types.sanitize("é") == "_xE9"


def entry(partition=None, low=None, high=None, nulls=0, n=10, nan=None, spec=0, field=1, kind="long"):
    return {
        "spec_id": spec,
        "data_file": {
            "partition": partition or {}, "value_counts": {field: n}, "null_value_counts": {field: nulls}, "nan_value_counts": {} if nan is None else {field: nan},
            "lower_bounds": {} if low is None else {field: serde.to_bytes(low, kind)}, "upper_bounds": {} if high is None else {field: serde.to_bytes(high, kind)},
        },
    }


def pruner(*spec):
    meta = new_metadata("/t", SCHEMA, list(spec))
    return Pruner(meta, SCHEMA)


def cmp(op, c, v):
    return ("cmp", op, c, v)


def test_bounds_pruning():
    p, e = pruner(), entry(low=100, high=200)
    keep = {"=": (100, 150, 200), "<": (101, 500), "<=": (100,), ">": (199,), ">=": (200,), "!=": (100,)}
    drop = {"=": (99, 201), "<": (100,), "<=": (99,), ">": (200,), ">=": (201,)}
    assert all(p.keeps(e, cmp(op, "id", v)) for op, vs in keep.items() for v in vs)
    assert not any(p.keeps(e, cmp(op, "id", v)) for op, vs in drop.items() for v in vs)
    assert not p.keeps(e, ("in", "id", [1, None, 300])) and p.keeps(e, ("in", "id", [1, 150]))
    assert p.keeps(e, cmp("=", "id", "text")) and p.keeps(e, cmp("=", "nowhere", 1)) and p.keeps(e, True)
    assert not p.keeps(e, ("null", "id")) and p.keeps(entry(low=1, high=2, nulls=3), ("null", "id"))
    assert not p.keeps(entry(nulls=10), cmp("=", "id", 1)) and not p.keeps(entry(nulls=10), ("not null", "id"))
    assert not p.keeps(entry(low=5, high=5), cmp("!=", "id", 5)) and p.keeps(entry(low=5, high=6), cmp("!=", "id", 5))
    assert not p.keeps(e, ("and", [True, cmp("=", "id", 1)])) and p.keeps(e, ("or", [True, cmp("=", "id", 1)]))


def test_nan_is_above_all():
    p = pruner()
    make = lambda nan: entry(low=1.0, high=2.0, nan=nan, field=4, kind="double")
    assert p.keeps(make(1), cmp(">", "price", 5.0)) and p.keeps(make(None), cmp(">", "price", 5.0))
    assert not p.keeps(make(0), cmp(">", "price", 5.0)) and not p.keeps(make(1), cmp("<", "price", 0.5))
    assert p.keeps(make(1), cmp("=", "price", math.nan)) and not p.keeps(make(0), cmp("=", "price", math.nan))


def test_partition_pruning():
    day = pruner({"source": "ts", "transform": "day", "name": "k"})
    e = entry({"k": dt.date(2020, 1, 2)}, field=9)
    at = lambda *x: serde.micros(dt.datetime(*x))
    assert day.keeps(e, cmp(">=", "ts", at(2020, 1, 2, 23))) and day.keeps(e, cmp("<", "ts", at(2020, 1, 2, 1))) and day.keeps(e, cmp("=", "ts", at(2020, 1, 2, 5)))
    assert not day.keeps(e, cmp(">", "ts", at(2020, 1, 3))) and not day.keeps(e, cmp("=", "ts", at(2020, 1, 1, 23))) and day.keeps(e, cmp("!=", "ts", at(2020, 1, 2)))
    bucket = pruner({"source": "id", "transform": "bucket[4]", "name": "k"})
    b = entry({"k": 0}, field=9)
    assert bucket.keeps(b, cmp("=", "id", 1)) and not bucket.keeps(b, cmp("=", "id", 6)) and bucket.keeps(b, cmp("<", "id", 0))
    assert not bucket.keeps(b, ("in", "id", [6])) and bucket.keeps(b, ("in", "id", [6, 1]))
    same = pruner({"source": "name", "transform": "identity", "name": "k"})
    assert not same.keeps(entry({"k": "a"}, field=9), cmp("!=", "name", "a")) and not same.keeps(entry({"k": "a"}, field=9), ("not in", "name", ["a"]))
    assert not same.keeps(entry({"k": None}, field=9), cmp("=", "name", "a")) and same.keeps(entry({"k": None}, field=9), ("null", "name"))
    assert not same.keeps(entry({"k": "a"}, field=9), ("null", "name"))
    void = pruner({"source": "id", "transform": "void", "name": "k"})
    assert void.keeps(entry({"k": None}, field=9), cmp("=", "id", 5))
    cut = pruner({"source": "name", "transform": "truncate[2]", "name": "k"})
    assert cut.keeps(entry({"k": "ab"}, field=9), cmp(">", "name", "abz")) and not cut.keeps(entry({"k": "ab"}, field=9), cmp("=", "name", "ac"))


def test_negation():
    p = negate(("or", [cmp("<", "a", 1), ("in", "b", [2]), ("null", "c"), True]))
    assert p == ("and", [cmp(">=", "a", 1), ("not in", "b", [2]), ("not null", "c"), True])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-30, 30), min_size=1, max_size=6), st.integers(-35, 35), st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), st.sampled_from(["identity", "truncate[7]", "bucket[3]"]))
def test_pruning_never_loses_rows(values, literal, op, transform):
    key = transforms.apply(transform, values[0], "long")
    rows = [v for v in values if transforms.apply(transform, v, "long") == key]
    p = pruner({"source": "id", "transform": transform, "name": "k"})
    e = entry({"k": key}, min(rows), max(rows))
    true = {"=": lambda v: v == literal, "!=": lambda v: v != literal, "<": lambda v: v < literal, "<=": lambda v: v <= literal, ">": lambda v: v > literal, ">=": lambda v: v >= literal}[op]
    if any(map(true, rows)):
        assert p.keeps(e, cmp(op, "id", literal))


def test_schema_rules():
    meta = new_metadata("/t", SCHEMA)
    fields = SCHEMA["fields"]
    change = lambda i, **x: [f | x if f["id"] == i else f for f in fields]
    new = lambda fs: commit.evolve_schema(meta, {"type": "struct", "schema-id": -1, "fields": fs})
    new(change(1, name="renamed"))
    new([*fields, {"id": 6, "name": "x", "required": False, "type": "int"}])
    for bad in (change(1, type="int"), change(2, type="long"), change(1, required=True), [*fields, {"id": 3, "name": "x", "required": False, "type": "int"}], [*fields, {"id": 6, "name": "x", "required": True, "type": "int"}], change(2, name="id")):
        with pytest.raises(ValueError):
            new(bad)
    assert commit.promotes("int", "long", 2) and commit.promotes("decimal(9, 2)", "decimal(10, 2)", 2) and not commit.promotes("decimal(9, 2)", "decimal(10, 3)", 2)
    assert commit.promotes("date", "timestamp", 3) and not commit.promotes("date", "timestamp", 2)
    for v, t in ((2, "variant"), (2, "timestamp_ns"), (2, "unknown")):
        with pytest.raises(ValueError):
            types.validate({"fields": [{"id": 1, "name": "a", "required": False, "type": t}]}, v)
    with pytest.raises(ValueError):
        types.validate({"fields": [{"id": types.ROW_ID, "name": "a", "type": "int"}]}, 3)


def test_updates_and_requirements():
    meta = new_metadata("/t", SCHEMA)
    snap = {"snapshot-id": 5, "sequence-number": 1, "timestamp-ms": 10, "summary": {"operation": "append"}}
    new = commit.apply(meta, [{"action": "add-snapshot", "snapshot": snap}, {"action": "set-snapshot-ref", "ref-name": "main", "type": "branch", "snapshot-id": 5}, {"action": "set-properties", "updates": {"a": "1", "b": "2"}}, {"action": "remove-properties", "removals": ["a"]}])
    assert new["current-snapshot-id"] == 5 and new["last-sequence-number"] == 1 and new["properties"] == {"b": "2"} and meta["snapshots"] == []
    for bad in ({"action": "add-snapshot", "snapshot": snap}, {"action": "set-default-spec", "spec-id": 9}, {"action": "no-such"}, {"action": "set-current-schema", "schema-id": 4}):
        with pytest.raises(ValueError):
            commit.apply(new, [bad])
    commit.check(new, [{"type": "assert-ref-snapshot-id", "ref": "main", "snapshot-id": 5}, {"type": "assert-ref-snapshot-id", "ref": "x", "snapshot-id": None}, {"type": "assert-default-spec-id", "default-spec-id": 0}])
    for bad in ({"type": "assert-create"}, {"type": "assert-table-uuid", "uuid": "x"}, {"type": "assert-ref-snapshot-id", "ref": "main", "snapshot-id": 6}, {"type": "assert-current-schema-id", "current-schema-id": 3}, {"type": "assert-next-row-id", "next-row-id": 3}):
        with pytest.raises(commit.RequirementFailed):
            commit.check(new, [bad])


def test_retry_waits_and_gives_up():
    waits, state = [], {"n": 0}

    def attempt():
        state["n"] += 1
        if state["n"] < 4:
            raise commit.CommitConflict("x")
        return "done"

    assert commit.with_retry(attempt, lambda: None, {}, waits.append) == "done" and len(waits) == 3 and all(0 <= w <= 3 for w in waits)
    state["n"] = -100
    with pytest.raises(commit.CommitConflict):
        commit.with_retry(attempt, lambda: None, {"commit.retry.num-retries": "2"}, waits.append)


def test_files(tmp_path):
    io = CachingIO(LocalIO(), 2)
    p = f"{tmp_path}/a/x"
    io.write(p, b"1", only_new=True)
    with pytest.raises(AlreadyExists):
        io.write(p, b"2", only_new=True)
    assert io.read(p) == b"1"
    io.write(p, b"3")
    assert io.read(f"file://{p}") == io.read(p) == b"3"
    io.delete(p)
    io.delete(p)
    assert io.list(f"{tmp_path}/a") == [] and io.list(f"{tmp_path}/none") == []


def test_metadata_names(tmp_path):
    io = LocalIO()
    for n in ("v1.metadata.json", "v2.metadata.json", "00002-abc-1.metadata.json", "v10.gz.metadata.json", "junk"):
        io.write(f"{tmp_path}/metadata/{n}", b"{}")
    assert md.latest_name(io, str(tmp_path)) == "v10.gz.metadata.json"
    assert md.versions(io, str(tmp_path)) == ["v1.metadata.json", "v2.metadata.json", "v10.gz.metadata.json"]
    with pytest.raises(FileNotFoundError):
        md.latest_name(io, f"{tmp_path}/none")


def test_manifest_inheritance(tmp_path):
    io, meta = LocalIO(), new_metadata("/t", SCHEMA, [{"source": "ts", "transform": "day"}, {"source": "price", "transform": "identity"}], version=3)
    make = lambda i, **x: {"status": 1, "spec_id": 0, "data_file": {"content": 0, "file_path": f"f{i}", "file_format": "PARQUET", "partition": {"ts_day": dt.date(2020, 1, i), "price": math.nan if i == 2 else None}, "record_count": 10, "file_size_in_bytes": 5, "lower_bounds": {1: b"x"}} | x}
    row = manifests.write_manifest(io, f"{tmp_path}/m", meta, 0, [make(1), make(2), make(3, first_row_id=500)], 77, 4)
    assert (row["added_files_count"], row["added_rows_count"], [s["contains_nan"] for s in row["partitions"]], row["partitions"][0]["lower_bound"]) == (3, 30, [False, True], struct.pack("<i", 18262))
    got = manifests.read_entries(io, row | {"first_row_id": 100, "sequence_number": 9})
    assert [e["sequence_number"] for e in got] == [9, 9, 9] and [e["snapshot_id"] for e in got] == [77] * 3
    assert [e["data_file"]["first_row_id"] for e in got] == [100, 110, 500]
    assert got[0]["data_file"]["partition"]["ts_day"] == dt.date(2020, 1, 1) and got[0]["data_file"]["lower_bounds"] == {1: b"x"}
    assert [e["file_sequence_number"] for e in manifests.read_entries(io, {"manifest_path": f"{tmp_path}/m", "added_snapshot_id": 1})] == [0, 0, 0]
    manifests.write_list(io, f"{tmp_path}/l", [row], meta, 77, None, 4)
    assert manifests.read_list(io, {"manifest-list": f"{tmp_path}/l"})[0]["partitions"] == row["partitions"]


def test_tuples_keep_zeros_apart():
    key = lambda v: manifests.tuple_key({"spec_id": 0, "data_file": {"partition": {"a": v}}})
    assert key(math.nan) == key(float("nan")) and key(0.0) != key(-0.0)


def test_geometry():
    g = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, {"type": "Polygon", "coordinates": [[[0, 0], [5, -1], [3, 3], [0, 0]]]}]}
    assert geo.bbox(geo.wkb_positions(geo.to_wkb(g))) == ([0, -1], [5, 3])
    z = {"type": "MultiPoint", "coordinates": [[1, 2, 3], [4, 5, 6]]}
    assert geo.bbox(geo.wkb_positions(geo.to_wkb(z))) == ([1, 2, 3], [4, 5, 6])
    assert geo.bbox([[math.nan, 1]]) is None and geo.bbox([]) is None
    assert len(geo.point_bytes([1.0, 2.0, math.nan, math.nan])) == 16


def test_signatures():
    """The published example of a GET request with an empty body."""
    headers = {"host": "examplebucket.s3.amazonaws.com", "range": "bytes=0-9", "x-amz-content-sha256": "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "x-amz-date": "20130524T000000Z"}
    request, names = sigv4.canonical_request("GET", "https://examplebucket.s3.amazonaws.com/test.txt", headers, headers["x-amz-content-sha256"], "s3")
    import hashlib
    import hmac

    assert hashlib.sha256(request.encode()).hexdigest() == "7344ae5b7ee6c3e7e6b0fe0640412a37625d1fbfff95c48bbb2dc43964946972"
    text = "\n".join(["AWS4-HMAC-SHA256", "20130524T000000Z", "20130524/us-east-1/s3/aws4_request", hashlib.sha256(request.encode()).hexdigest()])
    key = sigv4.signing_key("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "20130524", "us-east-1", "s3")
    assert hmac.new(key, text.encode(), hashlib.sha256).hexdigest() == "f0e8bdb87c964420e857bd35b5d6ed310bd44f0170aba48dd91039c6036bdb41"
    head = sigv4.signer("r", "s3tables", {"access_key": "a", "secret_key": "b", "session_token": "c"}, lambda: 0)("POST", "https://h/x?b=1&a=2", {}, b"{}")
    assert head["x-amz-security-token"] == "c" and "SignedHeaders=host;x-amz-content-sha256;x-amz-date;x-amz-security-token" in head["Authorization"]


def test_checksums_match():
    assert zlib.crc32(puffin.encode_vector([1])[4:-4]) == struct.unpack(">I", puffin.encode_vector([1])[-4:])[0]
    assert np.array_equal(puffin.decode_vector(puffin.encode_vector([3, 3, 1])), [1, 3])


def test_many_hashes_are_those_of_each_value(spark):
    rng = random.Random(1)
    for n in (0, 1, 15, 16, 17, 300):
        values = [rng.randbytes(rng.choice((0, 1, 2, 3, 4, 5, 8, 11, 30, 500))) for _ in range(n)]
        assert transforms.murmur3_many(values).tolist() == [transforms.murmur3(v) for v in values]
    texts = [None, "", "a", "éclair", *[rng.choice("xyz") * rng.randint(1, 40) for _ in range(60)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["b"] for r in df.select("t", transforms.column("bucket[7]", df["t"], "string").alias("b")).collect()}
    assert got == {t: transforms.apply("bucket[7]", t, "string") for t in texts}
