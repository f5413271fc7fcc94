"""Repeated word spans by a compacted De Bruijn graph of token k-mers.

The graph's edges are the windows of ``WINDOW`` words that occur at least twice, its nodes the
windows one word shorter. Stretches that may hold repeats (see ``repeats``) are super-k-mers: the
windows of one stretch share their least gram, so equal edges meet in one bucket, where the words
at their source coordinates decide. Every node belongs to the bucket of its own least gram: an
edge whose least gram lies outside one of its nodes sends that node's bucket a probe, so each
bucket knows all edges at its nodes, in whatever batch or shard they were found.

A bucket joins edges over nodes with one edge in and one out to pieces, and tells where a piece
goes on in another bucket. Spark joins then walk these links, twice as far each round, until each
maximal unbranched path has one name. What is removed from the texts are the places of pieces.
A bucket with more text than a shard is spread over several: its edges are counted by a
pre-aggregated shuffle, the words at both coordinates compared after a join, and its nodes dealt
out by their hash, with edges for pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import Scratch

WINDOW = 35
#: Bytes of stretches that one bucket batch holds.
SHARD = 4_000_000
#: Rows whose edges are joined to pieces at a time.
ROWS = 50_000
_LISTS = ("k", "e", "e2", "u", "v", "ou", "ov")
_EDGES = "gram long, digest binary, n long, split boolean, " + ", ".join(f"{c} array<long>" for c in _LISTS)
_NONE, _ALL = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def unit_of(window: int) -> repeats.Unit:
    return repeats.Unit("word", window, (window + 1) // 2)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int64)))


def _buckets(unit: repeats.Unit, shard: int):
    """Repeated windows of each stretch of a bucket: place k, edge e (and e2, to 128 bits), nodes
    u and v, and the least grams ou and ov of the nodes; of a split bucket all windows."""
    window = unit.window

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        words = [r[3].split(b" ") for r in rows]
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for own in words for w in own), np.int64)
        sym = repeats.word_symbols(list(known))[ids]
        size = np.array([len(w) for w in words])
        ends = np.cumsum(size)
        starts = ends - size
        first = np.ones(len(ids), bool)
        for e in ends.tolist():
            first[max(0, e - window + 1) : e] = False
        edge = np.flatnonzero(first)
        if not len(edge):
            return None
        h1, h2 = (h[edge] for h in repeats.rolling_pair(sym, window))
        order = np.lexsort((h2, h1))
        a, b = order[1:], order[:-1]
        same = (h1[a] == h1[b]) & (h2[a] == h2[b])
        if same.any():  # the words at both source coordinates decide
            i, j = edge[a[same]], edge[b[same]]
            cols = np.arange(window)
            equal = np.concatenate([(ids[i[k : k + 65536, None] + cols] == ids[j[k : k + 65536, None] + cols]).all(axis=1) for k in range(0, len(i), 65536)])
            same[np.flatnonzero(same)[~equal]] = False
        owner = np.searchsorted(starts, edge, "right") - 1
        many, split = np.array([r[2] > 1 for r in rows]), np.array([r[4] for r in rows])
        hit = many[owner] | split[owner]
        hit[a[same]] = hit[b[same]] = True
        live = np.flatnonzero(hit)
        if not len(live):
            return None
        at, owner = edge[live], owner[live]
        node = repeats.rolling(sym, window - 1).view(np.int64)
        least = repeats._slide(np.minimum, repeats.rolling(sym, unit.k), window - unit.k, (1 << 64) - 1).view(np.int64)
        own, count = np.unique(owner, return_counts=True)
        offsets = np.concatenate(([0], np.cumsum(count)))
        lists = [at - starts[owner], h1[live].view(np.int64), h2[live].view(np.int64), node[at], node[at + 1], least[at], least[at + 1]]
        plain = [pa.array([rows[k][0] for k in own.tolist()], pa.int64()), pa.array([rows[k][1] for k in own.tolist()], pa.binary()), pa.array([rows[k][2] for k in own.tolist()], pa.int64()), pa.array(split[own])]
        return pa.RecordBatch.from_arrays(plain + [_lists(offsets, x) for x in lists], names=["gram", "digest", "n", "split", *_LISTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for gram, salt, digest, n, text, split in zip(*(batch.column(k).to_pylist() for k in ("gram", "salt", "digest", "n", "text", "split"))):
                if size >= shard and (gram, salt) != last:
                    if (out := solve(rows)) is not None:
                        yield out
                    rows, size = [], 0
                last = (gram, salt)
                rows.append((gram, digest, n, text, split))
                size += len(text)
        if rows and (out := solve(rows)) is not None:
            yield out

    return run


_PLACE = "gram long, digest binary, windows array<struct<a:long,b:long,piece:long>>, pieces array<struct<id:long,last:long,n:long>>, links array<struct<a:long,b:long>>"


def _structs(offsets: np.ndarray, *columns: np.ndarray, names: tuple[str, ...]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=list(names)))


def chained(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(root, circle)``: the first member of each member's chain, by pointer doubling over the
    members ``before`` (-1: none); members of a circle get its least one."""
    n = len(before)
    root = np.where(before >= 0, before, np.arange(n))
    least = np.minimum(root, np.arange(n))
    for _ in range(max(1, n.bit_length() + 1)):
        after, least = root[root], np.minimum(least, least[root])
        if (after == root).all():
            break
        root = after
    circle = before[root] >= 0 if n else np.zeros(0, bool)
    return np.where(circle, least, root), circle


def _solve(table: pa.Table) -> list[pa.RecordBatch]:
    """Pieces, links and places of whole buckets: stretches (kind 0), edges of a split bucket (1)
    and probes (2)."""
    kind = table.column("kind").to_numpy()
    held = table.filter(pa.array(kind < 2)).combine_chunks()
    probe = table.filter(pa.array(kind == 2))
    count = pc.list_value_length(held.column("e")).to_numpy()
    k, e, u, v, ou, ov = (held.column(c).combine_chunks().flatten().to_numpy() for c in ("k", "e", "u", "v", "ou", "ov"))
    gram, hot = (np.repeat(held.column(c).to_numpy(), count) for c in ("gram", "kind"))
    home = np.repeat(held.column("home").to_numpy(zero_copy_only=False).astype(bool), count)
    order = np.argsort(e, kind="stable")
    new = np.concatenate(([True], e[order][1:] != e[order][:-1])) if len(e) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    number = np.empty(len(e), np.int64)
    number[order] = np.cumsum(new) - 1  # of each window's edge
    edge, one = e[order][start], order[start]
    over = lambda f, x: f.reduceat(x[order], start) if len(start) else x[:0]
    # An end belongs to this bucket if its node's least gram is the bucket's.
    mine_u, mine_v, home, hot = over(np.logical_or, ou == gram), over(np.logical_or, ov == gram), over(np.logical_or, home), over(np.maximum, hot) > 0
    u, v = u[one], v[one]
    fill = lambda value, mask: np.full(int(mask.sum()), value)
    of = lambda c, none: probe.column(c).combine_chunks().fill_null(none).to_numpy()
    nodes = np.concatenate((u[mine_u], v[mine_v], of("node", 0)))
    by, inverse = np.unique(nodes, return_inverse=True)
    place = np.argsort(inverse, kind="stable")
    cuts = np.searchsorted(inverse[place], np.arange(len(by)))
    ends = []
    for f, name, none, out in ((np.minimum, "lo_out", _NONE, True), (np.maximum, "hi_out", _ALL, True), (np.minimum, "lo_in", _NONE, False), (np.maximum, "hi_in", _ALL, False)):
        x = np.concatenate((edge[mine_u] if out else fill(none, mine_u), fill(none, mine_v) if out else edge[mine_v], of(name, none)))
        ends.append(f.reduceat(x[place], cuts) if len(by) else x)
    lo_out, hi_out, lo_in, hi_in = ends
    through = (lo_out == hi_out) & (lo_in == hi_in) & (lo_in != lo_out)
    a, b = lo_in[through], lo_out[through]
    index = lambda x: np.minimum(np.searchsorted(edge, x), max(len(edge) - 1, 0))
    inner = np.zeros(len(a), bool)
    if len(edge):
        i, j = index(a), index(b)
        inner = (edge[i] == a) & (edge[j] == b) & mine_v[i] & mine_u[j] & ~hot[i] & ~hot[j]
    before = np.full(len(edge), -1, np.int64)
    if inner.any():
        before[j[inner]] = i[inner]
    root, circle = chained(before)
    last = np.full(len(edge), _NONE)  # a circle has none
    ended = np.ones(len(edge), bool)
    ended[before[before >= 0]] = False
    last[root[ended]] = edge[ended]
    heads = np.flatnonzero((root == np.arange(len(edge))) & home)
    n = np.bincount(root, minlength=len(edge)) if len(edge) else np.zeros(0, np.int64)
    out = []
    links = np.stack((a[~inner], b[~inner]))
    for at in range(0, max(len(heads), links.shape[1]), ROWS):
        h, l = heads[at : at + ROWS], links[:, at : at + ROWS]
        none = pa.nulls(1, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("piece", pa.int64())])))
        lists = [_structs(np.array([0, len(h)]), edge[h], last[h], n[h], names=("id", "last", "n")), _structs(np.array([0, l.shape[1]]), l[0], l[1], names=("a", "b"))]
        out.append(pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), none, *lists], names=["gram", "digest", "windows", "pieces", "links"]))
    rows = np.flatnonzero(held.column("kind").to_numpy() == 0)
    if len(rows):
        row = np.repeat(np.arange(len(count)), count)
        keep = np.repeat(held.column("kind").to_numpy() == 0, count)
        row, k, piece = row[keep], k[keep], edge[root[number[keep]]]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (k[1:] != k[:-1] + 1) | (piece[1:] != piece[:-1])))
        s = np.flatnonzero(new)
        until = np.append(s[1:], len(row)) - 1
        offsets = np.concatenate(([0], np.cumsum(np.bincount(row[s], minlength=len(count))[rows])))
        own = held.take(pa.array(rows)).combine_chunks()
        plain = [own.column(c).combine_chunks() for c in ("gram", "digest")]
        empty = [pa.nulls(len(rows), pa.list_(pa.struct([(x, pa.int64()) for x in names]))) for names in (("id", "last", "n"), ("a", "b"))]
        out.append(pa.RecordBatch.from_arrays([*plain, _structs(offsets, k[s], k[until], piece[s], names=("a", "b", "piece")), *empty], names=["gram", "digest", "windows", "pieces", "links"]))
    return out


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets at a time; the rows come sorted by bucket and part."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= ROWS:
            table = pa.Table.from_batches(held)
            gram, part = (table.column(c).to_numpy() for c in ("gram", "part"))
            cut = int(np.argmax((gram == gram[-1]) & (part == part[-1])))  # the last bucket may go on
            if cut:
                yield from _solve(table.slice(0, cut))
                table = table.slice(cut)
            held, size = table.to_batches(), table.num_rows
    if size:
        yield from _solve(pa.Table.from_batches(held))


def _split_edges(scratch: Scratch, made: DataFrame, apart: DataFrame, unit: repeats.Unit) -> DataFrame:
    """Windows of split buckets that repeat: (gram, digest, k, e, u, v, ou, ov). Edges that occur
    twice are joined with the texts of both places, whose words are compared."""
    rows = made.where("split").select("gram", "digest", "n", F.explode(F.arrays_zip(*_LISTS)).alias("x")).select("gram", "digest", "n", "x.*")
    twice = rows.groupBy("gram", "e", "e2").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("digest", "k")).alias("lead")).where("times > 1")
    twice = twice.select("gram", "e", "e2", F.col("lead.digest").alias("other"), F.col("lead.k").alias("there"))
    pairs = rows.join(twice, ["gram", "e", "e2"]).groupBy("gram", "digest", "other").agg(F.collect_list(F.struct("k", "there")).alias("at"))
    words = lambda c: F.split(c, " ")
    text = apart.select("gram", "digest", words(F.col("text").cast("string")).alias("w"))
    both = pairs.join(text, ["gram", "digest"]).join(text.select("gram", F.col("digest").alias("other"), F.col("w").alias("w2")), ["gram", "other"])
    part = lambda w, k: F.slice(w, (k + 1).cast("int"), unit.window)
    sure = both.select("gram", "digest", F.explode(F.filter("at", lambda x: part(F.col("w"), x["k"]) == part(F.col("w2"), x["there"]))).alias("x")).select("gram", "digest", "x.k")
    flagged = sure.unionByName(rows.where("n > 1").select("gram", "digest", "k")).distinct()
    return scratch.keep(rows.join(flagged, ["gram", "digest", "k"]).drop("n", "e2"))


def graph(scratch: Scratch, found: DataFrame, unit: repeats.Unit, shard: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(places, pieces, links)``: ``places(gram, digest, windows)`` are the stretches of windows
    (a to b) that lie on a piece, ``pieces(id, last, n)`` have their first edge as id, and a link
    ``(a, b)`` leads from the last edge of a piece to the first of the next."""
    shard = shard or SHARD
    apart = scratch.keep(repeats.stretches(found))
    weight = apart.groupBy("gram").agg(F.sum(F.length("text")).alias("total")).where(F.col("total") > 2 * shard)
    large = scratch.keep(weight.select("gram", F.ceil(F.col("total") / shard).cast("int").alias("salts")))
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("digest"), F.col("salts"))).cast("int")
    dealt = apart.join(large, "gram", "left").select("gram", salt.alias("salt"), "digest", "n", "text", F.col("salts").isNotNull().alias("split"))
    made = scratch.keep(dealt.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "digest").mapInArrow(_buckets(unit, shard), _EDGES))
    plain = made.where("not split").select("gram", "digest", *[c for c in _LISTS if c != "e2"])
    lists = [c for c in _LISTS if c != "e2"]
    alien = F.filter(F.arrays_zip("e", "u", "v", "ou", "ov"), lambda x: (x["ou"] != F.col("gram")) | (x["ov"] != F.col("gram")))
    aliens = plain.select("gram", F.explode(alien).alias("x")).select("gram", "x.*")
    split = bool(large.limit(1).count())
    if split:
        hot = _split_edges(scratch, made, apart, unit)
        edges = hot.groupBy("gram", "e").agg(*[F.min(c).alias(c) for c in ("u", "v", "ou", "ov")])
        aliens = aliens.unionByName(edges.select("gram", "e", "u", "v", "ou", "ov").where("ou != gram or ov != gram"))
    ends = F.array(F.struct(F.col("ou").alias("o"), F.col("u").alias("node"), F.col("e").alias("out"), F.lit(None).cast("long").alias("in")), F.struct(F.col("ov").alias("o"), F.col("v").alias("node"), F.lit(None).cast("long").alias("out"), F.col("e").alias("in")))
    probes = aliens.select("gram", F.explode(ends).alias("x")).where("x.o != gram").select(F.col("x.o").alias("gram"), "x.node", "x.out", "x.in")
    probes = probes.groupBy("gram", "node").agg(F.min("out").alias("lo_out"), F.max("out").alias("hi_out"), F.min("in").alias("lo_in"), F.max("in").alias("hi_in"))
    probes = probes.withColumn("part", F.lit(0))
    none = lambda kind: F.lit(None).cast(kind)
    sides = ("node", "lo_out", "hi_out", "lo_in", "hi_in")
    rows = plain.select("gram", F.lit(0).alias("part"), F.lit(0).alias("kind"), "digest", *lists, F.lit(True).alias("home"), *[none("long").alias(c) for c in sides])
    if split:
        known = lambda df: df.join(large, "gram", "left")
        part = lambda node: F.pmod(F.xxhash64(node), F.col("salts")).cast("int") + 1
        probes = known(probes.drop("part")).withColumn("part", F.coalesce(part("node"), F.lit(0))).drop("salts")
        two = known(edges).withColumn("pu", part("u")).withColumn("pv", part("v")).withColumn("part", F.explode(F.array_distinct(F.array("pu", "pv"))))
        here = lambda owner, own: F.when(F.col(own) == F.col("part"), F.col(owner)).otherwise(F.col("gram") - 1)
        two = two.select("gram", "part", F.lit(1).alias("kind"), none("binary").alias("digest"), F.lit(0).cast("long").alias("k"), "e", "u", "v", here("ou", "pu").alias("ou"), here("ov", "pv").alias("ov"), (F.col("pu") == F.col("part")).alias("home"), *[none("long").alias(c) for c in sides])
        rows = rows.unionByName(two.select("gram", "part", "kind", "digest", *[F.array(c).alias(c) for c in lists], "home", *sides))
    rows = rows.unionByName(probes.select("gram", "part", F.lit(2).alias("kind"), none("binary").alias("digest"), *[none("array<long>").alias(c) for c in lists], F.lit(False).alias("home"), *sides))
    solved = scratch.keep(rows.repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(_compact, _PLACE))
    scratch.drop(apart)
    places = solved.where("digest is not null").select("gram", "digest", "windows")
    if split:
        places = places.unionByName(hot.groupBy("gram", "digest").agg(F.collect_list(F.struct(F.col("k").alias("a"), F.col("k").alias("b"), F.col("e").alias("piece"))).alias("windows")))
    pieces = solved.select(F.explode("pieces").alias("p")).select("p.*")
    links = solved.select(F.explode("links").alias("l")).select("l.*")
    return places, pieces, links


def paths(scratch: Scratch, pieces: DataFrame, links: DataFrame) -> DataFrame:
    """``(piece, path, path_words)``: the maximal unbranched path of every piece.

    Names travel by pointer doubling: each round joins the pieces that have not met the start of
    their path with the piece they point to, twice as far as before; those that have met it are only
    looked up. Pieces still under way after more doublings than there are pieces lie on a
    circle, which is named after its least piece.
    """
    back = pieces.join(links, pieces["last"] == links["a"]).select(F.col("b").alias("id"), F.col("id").alias("root"))
    # `met`: the root is the start of the path, which points to nothing.
    active = scratch.keep(back.select("id", "root", F.least("id", "root").alias("least"), F.lit(False).alias("met")))
    number, done = active.count(), []
    for _ in range(number.bit_length() + 2 if number else 0):
        known = active
        for d in done:
            known = known.unionByName(d)
        far = known.select(F.col("id").alias("root"), F.col("root").alias("further"), F.col("least").alias("low"), F.col("met").alias("over"))
        state = active.join(far, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.least("least", "low").alias("least"), F.coalesce("over", F.lit(True)).alias("met"))
        after = scratch.keep(state)
        done.append(after.where("met"))
        active = after.where("not met")
        if not active.limit(1).count():
            break
    else:
        done.append(active.withColumn("root", F.col("least")))
    told = active.limit(0)
    for d in done:
        told = told.unionByName(d)
    told = told.select("id", F.col("root").alias("path"))
    named = scratch.keep(pieces.select("id", "n").join(told, "id", "left").select("id", "n", F.coalesce("path", "id").alias("path")))
    total = named.groupBy("path").agg(F.sum("n").alias("path_words"))
    return named.join(total, "path").select(F.col("id").alias("piece"), "path", "path_words")


def repeated_paths(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(path, path_words)``: the compacted repeated paths of the distinct texts of
    ``docs(doc_id, text)``; the number of words is the number of edges, without the words that
    overlap at the end."""
    scratch, unit = Scratch(spark), unit_of(window)
    _, pieces, links = graph(scratch, repeats.candidates(scratch, docs, unit).found, unit)
    return paths(scratch, pieces, links).select("path", "path_words").distinct()


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, shard: int | None = None) -> DataFrame:
    """Digest of what is left of every row of ``docs(doc_id, text)``.

    Columns: doc_id, n_words, n_removed, n_spans, kept_sha256, longest_path. A word goes if a
    window of ``window`` words that covers it starts anywhere else. ``longest_path`` is the
    number of edges of the longest compacted path that the text touches, in the graph of the
    windows that repeat among or within distinct texts (null: none); it is the same for all
    copies of a text. ``shard`` (bytes) bounds a bucket and changes no result.

    Null texts have no words; repeated rows count as occurrences of their own; a null ``doc_id``
    stays null; an empty table gives no rows; very long texts are worked on in stretches; other
    columns are ignored, whatever their names.
    """
    scratch, unit = Scratch(spark), unit_of(window)
    own = repeats.candidates(scratch, docs, unit)
    places, pieces, links = graph(scratch, own.found, unit, shard)
    named = paths(scratch, pieces, links)
    on = places.select("gram", "digest", F.explode(F.array_distinct(F.transform("windows", lambda w: w["piece"]))).alias("piece"))
    best = on.join(named, "piece").groupBy("gram", "digest").agg(F.max("path_words").alias("path_words"))
    longest = own.found.select("doc_id", "key", "gram", "digest").join(best, ["gram", "digest"]).groupBy("doc_id", "key").agg(F.max("path_words").alias("longest_path"))
    same = own.info["doc_id"].eqNullSafe(longest["doc_id"]) & (own.info["key"] == longest["key"])
    by_text = scratch.keep(own.info.join(longest, same).groupBy("sha").agg(F.max("longest_path").alias("longest_path")))
    out = repeats.outcome_of(scratch, unit, own, repeats.spans(own.found, places, unit)).withColumnRenamed("n", "n_words")
    return out.join(by_text, "sha", "left").select("doc_id", "n_words", "n_removed", "n_spans", "kept_sha256", "longest_path")
