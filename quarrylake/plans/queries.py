"""Registered queries of the table engine, each with the DuckDB SQL of the same result.

Every query writes source tables through the engine's own writer, applies what it is named
for, and reads the result back.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import transforms
from ..functions.types import schema_from
from ..operators import scan
from ..sources.catalog import FileCatalog
from ..streaming.incremental import appended
from ..table import Table
from .sql import query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None):
    """Register a query under its function's name, with its oracle."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return take


def warehouse(spark: SparkSession) -> str:
    """A new folder for tables, in the session's shared folder if it names one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="tables-")


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, name: str, spec=None, order=None, version: int = 2, rows=True, split: list[str] | None = None, properties=None) -> Table:
    """A source table in a catalog of its own; ``split`` appends it by conditions, in turn."""
    df = source(spark, sf_dir, name)
    t = FileCatalog(spark, warehouse(spark)).create_table(name, schema_from(df.schema), spec, order, properties, version)
    if rows:
        for part in split or [None]:
            t.append(df if part is None else df.where(part))
    return t


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = made(spark, sf_dir, "lineitem", [{"source": "l_shipdate", "transform": "month"}], version=3)
    t.delete_where("l_returnflag = 'R' and l_quantity < 10")
    t.rename_column("l_extendedprice", "price")
    return t.read().groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast("decimal(18,2)")).alias("total"))


_LI = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@register("SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem")
def scan_project(spark, sf_dir):
    return made(spark, sf_dir, "lineitem").read(columns=["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity"])


@register("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND (o_orderstatus = 'F' OR o_orderpriority <> '1-URGENT') AND NOT o_custkey < 50")
def filter_cmp(spark, sf_dir):
    where = "o_totalprice >= 100000 and (o_orderstatus = 'F' or o_orderpriority <> '1-URGENT') and not o_custkey < 50"
    return made(spark, sf_dir, "orders").read(where, ["o_orderkey", "o_orderstatus", "o_totalprice"])


@register("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def filter_in(spark, sf_dir):
    return made(spark, sf_dir, "customer").read("c_mktsegment in ('BUILDING', 'MACHINERY', null) and c_nationkey not in (1, 2, 3)", ["c_custkey", "c_mktsegment"])


@register("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, NULL)")
def filter_not_in_null(spark, sf_dir):
    return made(spark, sf_dir, "customer").read("c_nationkey not in (1, null)", ["c_custkey"])


@register("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events WHERE NOT (CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END > 10) OR event_id % 3 = 0 AND event_id < 100")
def filter_3vl(spark, sf_dir):
    df = source(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    t = FileCatalog(spark, warehouse(spark)).create_table("events", schema_from(df.schema))
    return t.append(df).read("not (v > 10) or v is null and event_id < 100")


@register("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '%HIGH%' AND o_orderkey + 0 > 100 AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def filter_like_between(spark, sf_dir):
    t = made(spark, sf_dir, "orders", [{"source": "o_orderdate", "transform": "year"}])
    return t.read("o_orderpriority like '%HIGH%' and o_orderkey + 0 > 100 and o_orderdate >= cast('1995-01-01' as timestamp_ntz) and o_orderdate < cast('1996-01-01' as timestamp_ntz)", ["o_orderkey"])


@register("SELECT event_id, ts, event_type FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND ts < (SELECT min(ts) + INTERVAL 3 DAY FROM events)")
def prune_day(spark, sf_dir):
    t = made(spark, sf_dir, "events", [{"source": "ts", "transform": "day"}])
    first = t.read().agg(F.min("ts")).first()[0]
    where = f"ts >= cast('{first}' as timestamp_ntz) + interval 1 day and ts < cast('{first}' as timestamp_ntz) + interval 3 day"
    return t.read(where, ["event_id", "ts", "event_type"])


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 5000 AND o_orderkey <= 5500")
def prune_bounds(spark, sf_dir):
    t = made(spark, sf_dir, "orders", split=["o_orderkey <= 3000", "o_orderkey > 3000 and o_orderkey <= 7000", "o_orderkey > 7000"])
    plan = t.plan("o_orderkey > 5000 and o_orderkey <= 5500")
    if len(plan.data) * 3 > plan.total + 2:
        raise AssertionError("bounds did not prune")
    return t.read("o_orderkey > 5000 and o_orderkey <= 5500", ["o_orderkey", "o_totalprice"])


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (7, 42, 99)")
def prune_bucket(spark, sf_dir):
    t = made(spark, sf_dir, "customer", [{"source": "c_custkey", "transform": "bucket[16]"}])
    return t.read("c_custkey in (7, 42, 99)", ["c_custkey", "c_name"])


def _transformed(spark, sf_dir, name: str, key: str, column: str, transform: str) -> DataFrame:
    """Rows as a partitioned table gives them back, with their transform."""
    t = made(spark, sf_dir, name, [{"source": column, "transform": transform}])
    kind = next(f["type"] for f in t.schema["fields"] if f["name"] == column)
    return t.read().select(key, transforms.column(transform, F.col(column), kind).alias("t"))


@register("SELECT o_orderkey, year(o_orderdate) - 1970 AS t FROM orders")
def tf_year(spark, sf_dir):
    return _transformed(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "year")


@register("SELECT o_orderkey, (year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS t FROM orders")
def tf_month(spark, sf_dir):
    return _transformed(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "month")


@register("SELECT event_id, CAST(ts AS DATE) AS t FROM events")
def tf_day(spark, sf_dir):
    return _transformed(spark, sf_dir, "events", "event_id", "ts", "day")


@register("SELECT event_id, CAST(floor(epoch_us(ts) / 3600000000) AS INTEGER) AS t FROM events")
def tf_hour(spark, sf_dir):
    t = made(spark, sf_dir, "events")
    return t.read().select("event_id", transforms.column("hour", F.col("ts"), "timestamp").alias("t"))


@register("SELECT c_custkey, c_custkey - ((c_custkey % 50) + 50) % 50 AS t FROM customer")
def tf_truncate_int(spark, sf_dir):
    return _transformed(spark, sf_dir, "customer", "c_custkey", "c_custkey", "truncate[50]")


@register("SELECT c_custkey, left(c_mktsegment, 3) AS t FROM customer")
def tf_truncate_str(spark, sf_dir):
    return _transformed(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "truncate[3]")


@register("SELECT c_custkey, CAST(NULL AS INTEGER) AS t FROM customer")
def tf_void(spark, sf_dir):
    return _transformed(spark, sf_dir, "customer", "c_custkey", "c_name", "void")


@register(
    """WITH k AS (SELECT c_custkey, c_custkey::HUGEINT & 4294967295 AS lo, (c_custkey::HUGEINT >> 32) & 4294967295 AS hi FROM customer),
    a AS (SELECT *, (lo * 3432918353) % 4294967296 AS m1, (hi * 3432918353) % 4294967296 AS m2 FROM k),
    b AS (SELECT *, ((((m1 << 15) | (m1 >> 17)) % 4294967296) * 461845907) % 4294967296 AS k1, ((((m2 << 15) | (m2 >> 17)) % 4294967296) * 461845907) % 4294967296 AS k2 FROM a),
    c AS (SELECT *, ((((k1 << 13) | (k1 >> 19)) % 4294967296) * 5 + 3864292196) % 4294967296 AS h1 FROM b),
    d AS (SELECT *, xor(h1, k2) AS x2 FROM c),
    e AS (SELECT *, xor(((((x2 << 13) | (x2 >> 19)) % 4294967296) * 5 + 3864292196) % 4294967296, 8::HUGEINT) AS h2 FROM d),
    f AS (SELECT *, (xor(h2, h2 >> 16) * 2246822507) % 4294967296 AS h3 FROM e),
    g AS (SELECT *, (xor(h3, h3 >> 13) * 3266489909) % 4294967296 AS h4 FROM f)
    SELECT c_custkey, CAST((xor(h4, h4 >> 16) & 2147483647) % 16 AS INTEGER) AS t FROM g"""
)
def tf_bucket_long(spark, sf_dir):
    return _transformed(spark, sf_dir, "customer", "c_custkey", "c_custkey", "bucket[16]")


@register(
    """WITH k AS (SELECT l_orderkey, l_linenumber, (ascii(l_returnflag)::HUGEINT * 3432918353) % 4294967296 AS m FROM lineitem),
    a AS (SELECT *, ((((m << 15) | (m >> 17)) % 4294967296) * 461845907) % 4294967296 AS k1 FROM k),
    b AS (SELECT *, xor(k1, 1::HUGEINT) AS h1 FROM a),
    c AS (SELECT *, (xor(h1, h1 >> 16) * 2246822507) % 4294967296 AS h2 FROM b),
    d AS (SELECT *, (xor(h2, h2 >> 13) * 3266489909) % 4294967296 AS h3 FROM c)
    SELECT l_orderkey, l_linenumber, CAST((xor(h3, h3 >> 16) & 2147483647) % 16 AS INTEGER) AS t FROM d"""
)
def tf_bucket_text(spark, sf_dir):
    """Buckets of one-character texts."""
    t = made(spark, sf_dir, "lineitem", [{"source": "l_returnflag", "transform": "bucket[16]"}])
    return t.read().select("l_orderkey", "l_linenumber", transforms.column("bucket[16]", F.col("l_returnflag"), "string").alias("t"))


@register(f"SELECT {_LI} FROM lineitem")
def partitioned_write_read(spark, sf_dir):
    return made(spark, sf_dir, "lineitem", [{"source": "l_shipdate", "transform": "month"}, {"source": "l_returnflag", "transform": "identity"}]).read()


@register(f"SELECT {_LI} FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_quantity < 10) AND l_orderkey % 7 <> 0")
def pos_delete(spark, sf_dir):
    t = made(spark, sf_dir, "lineitem", [{"source": "l_returnflag", "transform": "identity"}], version=2)
    return t.delete_where("l_returnflag = 'R' and l_quantity < 10").delete_where("l_orderkey % 7 = 0").read()


@register(f"SELECT {_LI} FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_quantity < 10) AND l_orderkey % 7 <> 0")
def dv_delete(spark, sf_dir):
    t = made(spark, sf_dir, "lineitem", [{"source": "l_returnflag", "transform": "identity"}], version=3)
    return t.delete_where("l_returnflag = 'R' and l_quantity < 10").delete_where("l_orderkey % 7 = 0").read()


@register("SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_nationkey > 5 UNION ALL SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey < 50")
def eq_delete(spark, sf_dir):
    """Deletes reach rows of earlier commits only: those appended again afterwards stay."""
    t = made(spark, sf_dir, "customer")
    df = source(spark, sf_dir, "customer")
    keys = df.where("c_mktsegment = 'BUILDING' and c_nationkey <= 5").select("c_mktsegment", "c_nationkey")
    t.delete_equal(keys)
    return t.append(df.where("c_mktsegment = 'BUILDING' and c_custkey < 50")).read()


@register("SELECT * FROM orders WHERE o_orderkey <= 3000")
def time_travel(spark, sf_dir):
    t = made(spark, sf_dir, "orders", split=["o_orderkey <= 3000", "o_orderkey > 3000"])
    return t.read(snapshot_id=t.meta["snapshots"][0]["snapshot-id"])


@register("SELECT * FROM orders WHERE o_orderkey <= 3000")
def rollback(spark, sf_dir):
    t = made(spark, sf_dir, "orders", split=["o_orderkey <= 3000", "o_orderkey > 3000"])
    return t.rollback(t.meta["snapshots"][0]["snapshot-id"]).read()


@register("SELECT 'tag' AS ref, o_orderkey FROM orders WHERE o_orderkey <= 3000 UNION ALL SELECT 'branch', o_orderkey FROM orders UNION ALL SELECT 'main', o_orderkey FROM orders WHERE o_orderkey <= 3000")
def branch_tag(spark, sf_dir):
    t = made(spark, sf_dir, "orders", split=["o_orderkey <= 3000"])
    first = t.meta["current-snapshot-id"]
    t.set_ref("first", first, "tag").set_ref("dev", first)
    t.append(source(spark, sf_dir, "orders").where("o_orderkey > 3000"), ref="dev")
    parts = [t.read(ref=r, columns=["o_orderkey"]).select(F.lit(n).alias("ref"), "o_orderkey") for n, r in (("tag", "first"), ("branch", "dev"), ("main", "main"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("SELECT o_orderkey FROM orders")
def expire_snapshots(spark, sf_dir):
    t = made(spark, sf_dir, "orders", split=["o_orderkey <= 3000", "o_orderkey > 3000"])
    return t.expire([t.meta["snapshots"][0]["snapshot-id"]]).read(columns=["o_orderkey"])


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100")
def transaction(spark, sf_dir):
    df = source(spark, sf_dir, "orders")
    t = made(spark, sf_dir, "orders", rows=False)
    with t.transaction() as x:
        x.append(df.where("o_orderkey <= 3000")).append(df.where("o_orderkey > 3000"))
    return t.delete_where("o_orderkey <= 100").read(columns=["o_orderkey", "o_custkey"])


@register("SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation WHERE n_name < 'NATION_2'")
def schema_rename(spark, sf_dir):
    t = made(spark, sf_dir, "nation")
    return t.rename_column("n_nationkey", "id").rename_column("n_name", "name").read("name < 'NATION_2'")


@register("SELECT o_orderkey AS o_custkey, o_custkey AS o_orderkey FROM orders WHERE o_custkey < 100")
def sql_swapped_names(spark, sf_dir):
    """A filter above a projection that swaps two columns' names prunes by neither."""
    t = made(spark, sf_dir, "orders", split=["o_orderkey <= 3000", "o_orderkey > 3000 and o_orderkey <= 9000", "o_orderkey > 9000"])
    text = "SELECT o_custkey, o_orderkey FROM (SELECT o_orderkey AS o_custkey, o_custkey AS o_orderkey, rand() AS r FROM orders) x WHERE o_orderkey < 100 AND r >= 0"
    return query(spark, text, {"orders": t})


@register("SELECT a.n_name AS low, b.r_name AS high FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey UNION ALL SELECT s.s_name, r.r_name FROM supplier s CROSS JOIN region r WHERE s.s_suppkey < 3")
def join_theta(spark, sf_dir):
    text = "SELECT a.n_name low, b.r_name high FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey UNION ALL SELECT s.s_name, r.r_name FROM supplier s CROSS JOIN region r WHERE s.s_suppkey < 3"
    return _sql(spark, sf_dir, text, "nation", "region", "supplier")


@register("SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) UNION ALL SELECT l_returnflag, l_linestatus, count(*) FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) UNION ALL SELECT l_returnflag, l_linestatus, count(*) FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def agg_grouping_sets(spark, sf_dir):
    one = "SELECT l_returnflag f, l_linestatus s, count(*) n FROM lineitem GROUP BY "
    text = f"{one} ROLLUP (l_returnflag, l_linestatus) UNION ALL {one} CUBE (l_returnflag, l_linestatus) UNION ALL {one} GROUPING SETS ((l_returnflag), (l_linestatus))"
    return _sql(spark, sf_dir, text, "lineitem")


@register("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS kind FROM events WHERE event_id % 5 = 0 OR event_type = 'click'")
def null_partition(spark, sf_dir):
    """Identity partitions, one of them null: read by value and by IS NULL, other files unopened."""
    df = source(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("kind"))
    t = FileCatalog(spark, warehouse(spark)).create_table("events", schema_from(df.schema), [{"source": "kind", "transform": "identity"}]).append(df)
    parts = [t.read(where) for where in ("kind is null", "kind = 'click'")]
    if any(len(t.plan(where).data) >= t.plan(where).total for where in ("kind is null", "kind = 'click'")):
        raise AssertionError("partitions did not prune")
    return parts[0].unionByName(parts[1])


@register("SELECT o_orderkey FROM orders WHERE o_orderkey <= 3000")
def metadata_file_travel(spark, sf_dir):
    catalog = FileCatalog(spark, warehouse(spark))
    df = source(spark, sf_dir, "orders").select("o_orderkey")
    t = catalog.create_table("orders", schema_from(df.schema)).append(df.where("o_orderkey <= 3000"))
    then = t.name
    t.append(df.where("o_orderkey > 3000"))
    return catalog.load_table("orders", then).read()


@register("SELECT c_name, 'given' AS origin FROM customer WHERE c_custkey < 20 UNION ALL SELECT n_name, 'catalog' FROM nation")
def dotted_names(spark, sf_dir):
    """Quoted names of a namespace; a given table goes before one of the catalog."""
    catalog = FileCatalog(spark, warehouse(spark))
    for name in ("nation", "customer"):
        df = source(spark, sf_dir, name)
        catalog.create_table(f"ns.{name}", schema_from(df.schema)).append(df)
    text = """SELECT c_name, 'given' origin FROM "ns.customer" UNION ALL SELECT n_name, 'catalog' FROM "ns.nation" """
    return query(spark, text, {"ns.customer": source(spark, sf_dir, "customer").where("c_custkey < 20")}, catalog)


@register("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-05' AND o_orderdate < TIMESTAMP '1996-03-20'")
def prune_manifests(spark, sf_dir):
    """A manifest for each year; those whose summaries rule the dates out are not read."""
    years = ["year(o_orderdate) <= 1994", "year(o_orderdate) in (1995, 1996)", "year(o_orderdate) >= 1997"]
    t = made(spark, sf_dir, "orders", [{"source": "o_orderdate", "transform": "month"}], split=years)
    where = "o_orderdate >= cast('1996-03-05' as timestamp_ntz) and o_orderdate < cast('1996-03-20' as timestamp_ntz)"
    if len(t.plan(where).data) * 10 > t.plan(where).total:
        raise AssertionError("months did not prune")
    return t.read(where, ["o_orderkey", "o_orderstatus"])


@register("SELECT n_nationkey, n_name, n_regionkey, 'unknown' AS tag, CAST(NULL AS BIGINT) AS extra FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey, 'fresh', CAST(NULL AS BIGINT) FROM nation")
def schema_add_default(spark, sf_dir):
    t = made(spark, sf_dir, "nation", version=3)
    t.add_column("tag", "string", initial_default="unknown", write_default="fresh").add_column("extra", "long")
    return t.append(source(spark, sf_dir, "nation").withColumn("n_nationkey", F.col("n_nationkey") + 100)).read()


@register("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_size AS BIGINT) AS p_size, CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DECIMAL(18,2)) AS price, CAST(CAST(p_size AS FLOAT) AS DOUBLE) AS f FROM part")
def schema_promote(spark, sf_dir):
    df = source(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_retailprice").cast("decimal(10,2)").alias("price"), F.col("p_size").cast("float").alias("f"))
    t = FileCatalog(spark, warehouse(spark)).create_table("part", schema_from(df.schema)).append(df)
    return t.promote_column("p_size", "long").promote_column("price", "decimal(18, 2)").promote_column("f", "double").read()


@register("SELECT s_name, s_suppkey FROM supplier")
def schema_drop_reorder(spark, sf_dir):
    t = made(spark, sf_dir, "supplier")
    by = {f["name"]: f for f in t.schema["fields"]}
    return t.update_schema([by["s_name"], by["s_suppkey"]]).read()


@register("SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id, CASE WHEN n_nationkey < 10 THEN 1 ELSE 2 END AS changed FROM nation")
def row_lineage(spark, sf_dir):
    t = made(spark, sf_dir, "nation", order=[{"source": "n_nationkey"}], version=3, split=["n_nationkey < 10", "n_nationkey >= 10"])
    t.rewrite()
    return t.read(lineage=True).select("n_nationkey", F.col("_row_id").alias("row_id"), F.col("_last_updated_sequence_number").alias("changed"))


@register(f"SELECT {_LI} FROM lineitem WHERE l_orderkey % 5 <> 0")
def rewrite_sorted(spark, sf_dir):
    t = made(spark, sf_dir, "lineitem", [{"source": "l_returnflag", "transform": "identity"}], [{"source": "l_shipdate"}, {"source": "l_orderkey", "direction": "desc"}], split=["l_linenumber <= 3", "l_linenumber > 3"])
    t.delete_where("l_orderkey % 5 = 0").rewrite(target_rows=20_000)
    if t.count() is None or any(r["content"] for r in t.files().select("content").distinct().collect()):
        raise AssertionError("deletes are left after a rewrite")
    return t.read()


@register("SELECT min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n, min(o_orderpriority) AS first_priority FROM orders")
def file_stats(spark, sf_dir):
    """Column statistics of data files, as manifests hold them."""
    from ..functions import serde

    t = made(spark, sf_dir, "orders", split=["o_orderkey <= 3000", "o_orderkey > 3000"])
    ids = {f["name"]: (f["id"], f["type"]) for f in t.schema["fields"]}
    rows = []
    for e in t.plan().data:
        d = e["data_file"]
        value = lambda side, name: serde.from_bytes(d[side][ids[name][0]], ids[name][1])  # noqa: E731, B023
        rows.append((value("lower_bounds", "o_orderkey"), value("upper_bounds", "o_orderkey"), d["record_count"], value("lower_bounds", "o_orderpriority")))
    df = spark.createDataFrame(rows, "low long, high long, n long, p string")
    return df.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.min("p").alias("first_priority"))


def _sql(spark, sf_dir, text: str, *names: str, **specs) -> DataFrame:
    return query(spark, text, {n: made(spark, sf_dir, n, specs.get(n)) for n in names})


@register("SELECT count(*) AS n, count(value) AS nv, min(value) AS low, max(value) AS high, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(38,4)) AS total, count(DISTINCT event_type) AS kinds FROM events")
def agg_scalar(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT count(*) n, count(value) nv, min(value) low, max(value) high, sum(cast(value as decimal(18,4))) total, count(distinct event_type) kinds FROM events", "events")


@register("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL HAVING count(*) > 10")
def agg_group(spark, sf_dir):
    text = "SELECT l_returnflag, l_linestatus, count(*) n, sum(l_quantity) q FROM lineitem WHERE l_shipdate <= cast('1998-09-02' as timestamp_ntz) GROUP BY 1, 2 HAVING count(*) > 10"
    return _sql(spark, sf_dir, text, "lineitem", lineitem=[{"source": "l_shipdate", "transform": "year"}])


@register("SELECT c.c_mktsegment, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F' AND c.c_acctbal > 0 GROUP BY 1")
def join_inner(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT c.c_mktsegment, count(*) n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F' AND c.c_acctbal > 0 GROUP BY 1", "orders", "customer")


@register("SELECT n.n_name, s.s_suppkey FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 1000")
def join_outer(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT n.n_name, s.s_suppkey FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 1000", "nation", "supplier")


@register("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_semi_anti(spark, sf_dir):
    text = "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"
    return _sql(spark, sf_dir, text, "customer", "orders")


@register("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def union_all(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT n_name name FROM nation UNION ALL SELECT r_name FROM region", "nation", "region")


@register("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT 3")
def set_operations(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT c_nationkey k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT 3", "customer", "supplier")


@register("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12), nation2 AS (SELECT * FROM big) SELECT c.c_name, b.n FROM nation2 b JOIN customer c ON c.c_custkey = b.o_custkey")
def cte(spark, sf_dir):
    text = "WITH big AS (SELECT o_custkey, count(*) n FROM orders GROUP BY 1 HAVING count(*) > 12), nation2 AS (SELECT * FROM big) SELECT c.c_name, b.n FROM nation2 b JOIN customer c ON c.c_custkey = b.o_custkey"
    return _sql(spark, sf_dir, text, "orders", "customer")


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def order_limit_offset(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5", "orders")


@register("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def window_top(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) r FROM events) WHERE r <= 3", "events")


@register("SELECT count(*) AS n FROM lineitem")
def count_fast_path(spark, sf_dir):
    t = made(spark, sf_dir, "lineitem")
    return spark.createDataFrame([(scan.count_from_metadata(t.io, t.meta),)], "n long")


@register("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0 ORDER BY o_orderkey LIMIT 200 OFFSET 300)")
def read_range(spark, sf_dir):
    df = source(spark, sf_dir, "orders")
    t = made(spark, sf_dir, "orders", order=[{"source": "o_orderkey"}], rows=False)
    t.append(df.where("o_orderkey <= 3000"), ranged=True).append(df.where("o_orderkey > 3000"), ranged=True)
    return t.delete_where("o_orderkey % 4 = 0").read_range(300, 500).select("o_orderkey")


@register("SELECT o_orderkey FROM orders WHERE o_orderkey > 3000 AND o_orderkey <= 5000 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey > 5000")
def incremental_append(spark, sf_dir):
    t = made(spark, sf_dir, "orders", split=["o_orderkey <= 3000", "o_orderkey > 3000 and o_orderkey <= 5000", "o_orderkey > 5000"])
    return appended(t, t.meta["snapshots"][0]["snapshot-id"]).select("o_orderkey")


@register("SELECT doc_id, length(text) AS n, lang, source FROM documents")
def long_text_payload(spark, sf_dir):
    t = made(spark, sf_dir, "documents", [{"source": "lang", "transform": "identity"}])
    return t.read().select("doc_id", F.length("text").cast("long").alias("n"), "lang", "source")


@register("SELECT vec_id, label, len(embedding) AS n, embedding[1] AS first FROM embeddings")
def list_payload(spark, sf_dir):
    return made(spark, sf_dir, "embeddings").read().select("vec_id", "label", F.size("embedding").cast("long").alias("n"), F.col("embedding")[0].alias("first"))


@register("SELECT o_orderkey, o_orderpriority AS p, o_custkey AS c FROM orders WHERE o_custkey > 20")
def nested_payload(spark, sf_dir):
    """Structs and maps: a nested rename keeps its id, so old files are still read."""
    df = source(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderpriority").alias("p"), F.col("o_custkey").alias("k")).alias("s"), F.create_map(F.lit("k"), F.col("o_custkey")).alias("m"))
    t = FileCatalog(spark, warehouse(spark)).create_table("nested", schema_from(df.schema)).append(df)
    fields = [f | {"type": f["type"] | {"fields": [x | {"name": "c"} if x["name"] == "k" else x for x in f["type"]["fields"]]}} if f["name"] == "s" else f for f in t.schema["fields"]]
    return t.update_schema(fields).read().where("m['k'] > 20").select("o_orderkey", "s.p", "s.c")


@register("SELECT s_suppkey, s_suppkey % 4 AS part FROM supplier")
def evolved_spec(spark, sf_dir):
    """Files of two specs in one table."""
    df = source(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).alias("part"))
    t = FileCatalog(spark, warehouse(spark)).create_table("s", schema_from(df.schema), [{"source": "part", "transform": "identity"}])
    t.append(df.where("s_suppkey % 2 = 0")).set_spec([{"source": "s_suppkey", "transform": "bucket[4]"}]).append(df.where("s_suppkey % 2 <> 0"))
    return t.read("part >= 0")


__all__ = ["ORACLE_SQL", "QUERIES", "T", "flagship"]
