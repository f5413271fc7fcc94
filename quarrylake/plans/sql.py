"""SQL over tables: names are resolved by a catalog, files pruned by each relation's filters."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from ..operators import scan
from ..table import Table, combine, scan_probe
from . import predicates

#: Tables of a query whose metadata are loaded at a time.
LOADS = 8


def references(spark: SparkSession, text: str) -> list[str]:
    """Table names of a query, without those that its WITH clauses define."""
    keys = ("spark.sql.ansi.enabled", "spark.sql.ansi.doubleQuotedIdentifiers")
    before = {key: spark.conf.get(key) for key in keys}
    try:
        for key in keys:
            spark.conf.set(key, "true")
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    out: list[str] = []

    def visit(node, hidden: frozenset) -> None:
        n = node.getClass().getSimpleName()
        if n == "UnresolvedWith":
            relations = node.cteRelations()
            names = set(hidden)
            for k in range(relations.size()):
                pair = relations.apply(k)
                visit(pair._2(), frozenset(names))
                names.add(pair._1().lower())
            visit(node.child(), frozenset(names))
            return
        if n == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            name = ".".join(parts.apply(k) for k in range(parts.size()))
            if name.lower() not in hidden and name not in out:
                out.append(name)
            return
        for kids in (node.children(), node.subqueries()):
            for k in range(kids.size()):
                visit(kids.apply(k), hidden)

    visit(plan, frozenset())
    return out


def query(spark: SparkSession, text: str, tables: dict | None = None, catalog=None, prune: bool = True) -> DataFrame:
    """Run SQL over tables. ``tables`` maps names to Tables or DataFrames and goes before the
    catalog; ``"ns.table"`` in double quotes names a table of a namespace.

    First every table is a relation without rows of interest, and Catalyst pushes conditions
    down to it; then files are pruned by them and the query is planned over what is left.
    """
    scan.configure(spark)
    names = references(spark, text)
    wanted = [name for name in names if not (tables and name in tables)]
    if wanted and catalog is None:
        raise ValueError(f"table {wanted[0]} not found: it is not among the given tables and there is no catalog")
    # Metadata of several tables are waited for together; the first failure is the query's.
    with ThreadPoolExecutor(LOADS) as pool:
        loaded = dict(zip(wanted, pool.map(catalog.load_table, wanted))) if wanted else {}
    found = {name: loaded[name] if name in loaded else tables[name] for name in names}
    # Views belong to a session of their own, so that queries don't meet each other's.
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    scan.configure(own)
    plans = {name: scan.plan(t.io, t.meta, spark=spark) for name, t in found.items() if isinstance(t, Table)}
    trees = _conditions(own, text, plans, found) if prune else {}
    for name, t in found.items():
        if isinstance(t, Table):
            kept = scan.plan(t.io, t.meta, predicate=trees.get(name, True), spark=spark)
            _view(own, name, scan.frame(own, kept, t.io))
        else:
            _view(own, name, own.table(name) if t is None else _adopt(own, t))
    return own.sql(text)


def _adopt(own: SparkSession, df: DataFrame) -> DataFrame:
    """A DataFrame's plan in another session."""
    jvm = own.sparkContext._jvm
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan()), own)


def _view(own: SparkSession, name: str, df: DataFrame) -> None:
    parts = name.split(".")
    if len(parts) == 1:
        df.createOrReplaceTempView(f"`{name}`")
    else:
        df.createOrReplaceTempView(f"`{name}`")


def _conditions(own: SparkSession, text: str, plans: dict, found: dict) -> dict:
    marks = {}
    for name, p in plans.items():
        if not p.data:
            _view(own, name, scan.frame(own, p))
            continue
        marks[name] = f"__mark_{uuid.uuid4().hex}"
        _view(own, name, scan_probe(own, p, marks[name]).select(*[f"`{f['name']}`" for f in p.schema["fields"]]))
    for name, t in found.items():
        if name not in plans:
            _view(own, name, _adopt(own, t))
    told = predicates.conditions(own.sql(text)._jdf.queryExecution().optimizedPlan(), set(marks.values()))
    return {name: combine(told[m]) if m in told else True for name, m in marks.items()}
