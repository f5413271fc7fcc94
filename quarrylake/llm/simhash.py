"""SimHash near-duplicates by segment popcounts: a grid range join under Manhattan distance.

A 64-bit fingerprint maps to the bit counts of its 32 two-bit segments. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints, so
fingerprints within ``RADIUS`` = 3 bits lie within Manhattan distance 3, and one half of the
vector (16 segments) lies within distance 1. Each half is a grid: a fingerprint stands in its
home cell and probes the cells one count higher in one segment, which finds each pair at
distance 0 or 1 in that half from one of its sides. Candidates of a cell are then compared
exactly. Only distinct fingerprints enter the grid, and a cell gives a spanning forest of its
links rather than all pairs.

``keep_one`` takes five-word shingles and a Jaccard similarity instead. Fingerprints of texts at
0.8 differ in about ten bits, more than any grid can look up, so the grid gives some of the
links and bands of least hashes the others; all are verified on the whole sets of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import Scratch, Writer, rows_of, text_bytes
from .components import components

RADIUS = 3
#: Rows of one cell that a single task compares; larger cells are dealt out as pairs of blocks.
CELL_BLOCK = 16_384


def fingerprint(data: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of a text in UTF-8: majority over the bits of the XXH64 of its word shingles."""
    parts = data.lower().split()  # bytes.lower() changes A-Z alone; split() takes the six ASCII spaces
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined = memoryview(b" ".join(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[: len(parts) - words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 15):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)])], ">u8")
        votes += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Writer(_FP)
    for doc, data in rows_of(batches, "doc_id", "data"):
        fp = fingerprint(data)
        if out.add(doc, fp - (1 << 64) if fp >> 63 else fp):
            yield out.flush()
    if len(out):
        yield out.flush()


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` a row of ``docs(doc_id, text)``; null and wordless texts get 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _pairs(fp: np.ndarray, home: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups; rows are sorted by group, homes first. Probes meet homes only."""
    n = len(fp)
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(start, n))
    a, b = [], []
    small = np.repeat(size <= 48, size)
    live = np.flatnonzero(small & home & np.repeat(size > 1, size))
    step = 1
    while len(live):
        live = live[live + step < n]
        live = live[group[live + step] == group[live]]
        hit = live[np.bitwise_count((fp[live] ^ fp[live + step]).view(np.uint64)) <= RADIUS]
        a.append(fp[hit])
        b.append(fp[hit + step])
        step += 1
    for s, m in zip(start[size > 48], size[size > 48]):
        x, y = _forest(fp[s : s + m], int(home[s : s + m].sum()))
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _forest(fp: np.ndarray, homes: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the first ``homes`` rows and all rows."""
    label = np.arange(len(fp))
    a, b = [], []
    for at in range(0, homes, 64):
        near = np.bitwise_count((fp[at : min(at + 64, homes), None] ^ fp[None, :]).view(np.uint64)) <= RADIUS
        for k in range(len(near)):
            idx = np.flatnonzero(near[k])
            lab, first = np.unique(label[idx], return_index=True)
            if len(lab) > 1:
                own = label[at + k]
                other = first[lab != own]
                a.append(np.repeat(fp[at + k], len(other)))
                b.append(fp[idx[other]])
                label[np.isin(label, lab)] = own
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of cells; rows come sorted by (cell, block, probe)."""
    held: list[np.ndarray] | None = None

    def out(rows: list[np.ndarray]) -> pa.RecordBatch:
        cell, block, probe, fp = rows
        change = np.concatenate(([True], (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])))
        a, b = _pairs(fp, ~probe, np.cumsum(change))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_LINK)

    for batch in batches:
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("cell", "block", "probe", "fp")]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        cut = len(last) - int(last.sum())  # the last cell may go on in the next batch
        if cut:
            yield out([x[:cut] for x in rows])
        held = [x[cut:] for x in rows]
    if held is not None:
        yield out(held)


def links(fps: DataFrame, block_rows: int = CELL_BLOCK) -> DataFrame:
    """``(a, b)``: links that connect all of ``fps(fp)`` (distinct) within three bits.

    Cells with more than ``block_rows`` rows are split into hashed blocks and compared as
    block pairs in separate tasks, so no cell has to fit one task.
    """
    even = F.lit(0x55555555)

    def half(n: int):
        bits = F.shiftrightunsigned("fp", 32) if n else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
        own = bits.bitwiseAND(even) + F.shiftright(bits, 1).bitwiseAND(even)
        steps = [F.when(F.shiftright(own, 2 * i).bitwiseAND(F.lit(2)) == 0, own + F.lit(1 << 2 * i)) for i in range(16)]
        tag = F.lit(n << 32)
        return F.concat(
            F.array(F.struct((own + tag).alias("cell"), F.lit(False).alias("probe"))),
            F.transform(F.array_compact(F.array(*steps)), lambda c: F.struct((c + tag).alias("cell"), F.lit(True).alias("probe"))),
        )

    rows = fps.select("fp", F.explode(F.concat(half(0), half(1))).alias("x")).select("x.cell", "x.probe", "fp")
    large = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    parts = F.ceil(F.col("n") / block_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    code = lambda i, j: (i * F.col("parts") + j).cast("long")
    blocks = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1), lambda k: code(F.least(own, k), F.greatest(own, k)))
    )
    dealt = rows.join(large.select("cell", parts.alias("parts")), "cell", "left").select("cell", F.explode(blocks).alias("block"), "probe", "fp")
    return dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "probe").mapInArrow(_cells, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the least ``doc_id`` reachable over links of at most three bits.
    Null and wordless texts share the fingerprint zero and are linked like any other; repeated
    rows come back repeated; rows with a null ``doc_id`` are linked but never name a component
    (a component of such rows alone has a null id); an empty table gives no rows. Other
    columns are ignored.
    """
    scratch = Scratch(spark)
    rows = scratch.keep(fingerprints(docs))
    fps = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(fps.select("fp")), scratch)
    named = fps.join(found, fps["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = scratch.keep(named.join(roots, "root").select("fp", "component_id"))
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity: five-word shingles, verified exactly.

#: Shingle length, least Jaccard similarity, and the sketch: BANDS bands of ROWS least hashes.
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 10, 3
#: Bytes of shingle sets that are compared in one task of a band; larger bands are dealt as block pairs.
SET_BYTES = 8_000_000
_seeds = np.random.default_rng(5).integers(1, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of all word shingles of a text in order; of a shorter text its whole sequence."""
    sym = repeats.word_symbols(data.lower().split())
    return repeats.rolling(sym, min(words, len(sym))) if len(sym) else np.zeros(0, np.uint64)


def sketch(distinct: np.ndarray) -> list[int]:
    """A key a band, equal for two sets where the band's ROWS least hashes are equal."""
    if not len(distinct):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(distinct), 4096):
        x = (distinct[None, at : at + 4096] ^ _seeds[0]) * _seeds[1]
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * _seeds[0]).min(axis=1))
    x = least.reshape(BANDS, ROWS) * _seeds[1].reshape(BANDS, ROWS)
    x = x.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64).tolist()


def majority(h: np.ndarray) -> int:
    """The signed 64-bit fingerprint of shingle hashes; of none it is zero."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        votes += np.unpackbits(h[at : at + (1 << 15)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h)).view(">i8")[0])


_ROW = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("sha", pa.binary()), ("fp", pa.int64()), ("size", pa.int64()), ("band", pa.list_(pa.int64()))])
_SET = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Writer(_ROW)
    for doc, mark, data in rows_of(batches, "doc_id", "mark", "data"):
        h = shingles(data)
        own = np.unique(h)
        if out.add(doc, mark, hashlib.blake2b(b" ".join(data.lower().split()), digest_size=16).digest(), majority(h), len(own), sketch(own)):
            yield out.flush()
    if len(out):
        yield out.flush()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Writer(_SET)
    for i, data in rows_of(batches, "id", "data"):
        own = np.unique(shingles(data)).tobytes()
        if out.add(i, own, nbytes=len(own)):
            yield out.flush()
    if len(out):
        yield out.flush()


def similar(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets of hashes (sorted, none empty) have at least the similarity to ``one``."""
    size = np.fromiter(map(len, others), np.int64, len(others))
    x = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, x), len(one) - 1)
    both = np.add.reduceat(one[at] == x, np.cumsum(size) - size)
    return both >= similarity * (len(one) + size - both) - 1e-9


def _verified(similarity: float):
    """Pairs that are similar enough; the two sets of a pair come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, before = Writer(_LINK), None
        for a, b, raw in rows_of(batches, "a", "b", "shingles"):
            own = np.frombuffer(raw, np.uint64)
            if before and before[:2] == (a, b) and similar(before[2], [own], similarity)[0] and out.add(a, b):
                yield out.flush()
            before = (a, b, own)
        if len(out):
            yield out.flush()

    return run


def _banded(similarity: float):
    """A spanning forest of the similar pairs of a band's block pair that no component joins yet."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: (len(r[2]), r[0]))
        size = np.array([len(r[2]) for r in rows])
        label = np.unique([r[1] for r in rows], return_inverse=True)[1]
        found = []
        for i in range(len(rows) - 1):
            until = int(np.searchsorted(size, size[i] / similarity + 1e-9, "right"))
            other = i + 1 + np.flatnonzero(label[i + 1 : until] != label[i])
            if not len(other):
                continue
            near = other[similar(rows[i][2], [rows[j][2] for j in other.tolist()], similarity)]
            for j in near.tolist():
                if label[j] != label[i]:
                    found.append((rows[i][0], rows[j][0]))
                    label[label == label[j]] = label[i]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, own = Writer(_LINK), None, []
        for key, block, i, comp, raw in rows_of(batches, "key", "block", "id", "comp", "shingles"):
            if (key, block) != place:
                for pair in solve(own):
                    out.add(*pair)
                if len(out) >= out.rows:
                    yield out.flush()
                place, own = (key, block), []
            own.append((i, comp, np.frombuffer(raw, np.uint64)))
        for pair in solve(own):
            out.add(*pair)
        if len(out):
            yield out.flush()

    return run


def _marked(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, mark, data)``: the mark is a hash of all columns but maps."""
    cols = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*cols, *[c.isNull() for c in cols]).alias("mark"), text_bytes().alias("data"))


def similar_groups(scratch: Scratch, rows: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, bool]:
    """``(firsts, repeated)`` of ``rows(doc_id, mark, data)``: the row (doc_id, mark) with the least
    id of each component of texts whose sets of five-word shingles have at least the Jaccard
    similarity, and whether any (doc_id, mark) occurs more than once.

    First the texts are linked whose fingerprints over five-word shingles the grid finds within
    three bits, or that share the least text of a band. Fingerprints see few pairs near the least
    similarity, so then every band whose texts are not in one component yet is compared text by
    text, in blocks. Every link is verified on the whole sets. Two texts at similarity s share no
    band with probability ``(1 - s ** 3) ** 10``: 0.0008 at 0.8, and 0.000002 at 0.9.
    """
    known = scratch.keep(rows.select("doc_id", "mark", "data").mapInArrow(_sketches, "doc_id long, mark long, sha binary, fp long, size long, band array<long>").withColumn("id", F.monotonically_increasing_id()))
    repeated = bool(known.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())
    lead = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "id")
    groups = scratch.keep(known.groupBy("sha").agg(F.min(lead).alias("lead")).select("sha", "lead.*"))
    items = scratch.keep(known.select("sha", "id", "fp", "size", "band").join(groups.select("sha", "id"), ["sha", "id"]).select("id", "fp", "size", "band"))
    bands = items.select("id", "size", F.explode("band").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("n > 1").select("key", "least")
    shared = scratch.keep(bands.join(shared, "key"))
    star = shared.groupBy("id").agg(F.min("least").alias("b")).where("id != b").select(F.col("id").alias("a"), "b")
    fps = scratch.keep(items.groupBy("fp").agg(F.min("id").alias("least")))
    same = items.select("id", "fp").join(fps, "fp").where("id != least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    near = links(fps.select("fp")).where("a != b")
    for c in ("a", "b"):
        near = near.join(fps.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_id")), c)
    near = near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    every = star.unionByName(same).unionByName(near)
    edges = scratch.keep(every.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    needed = shared.select("id").unionByName(edges.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    told = groups.join(needed, "id", "left_semi").select("doc_id", "mark", "id")
    single = rows.select("doc_id", "mark", "data")
    single = single.dropDuplicates(["doc_id", "mark"]) if repeated else single
    sets = single.join(told, single["doc_id"].eqNullSafe(told["doc_id"]) & (single["mark"] == told["mark"])).select("id", "data")
    sets = scratch.keep(sets.mapInArrow(_sets, "id long, shingles binary").where(F.length("shingles") > 0))
    pairs = edges.select("a", "b", F.explode(F.array("a", "b")).alias("id")).join(sets, "id").select("a", "b", "shingles")
    linked = scratch.keep(pairs.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_verified(similarity), "a long, b long"))
    first = components(linked, scratch)
    named = shared.join(first, shared["id"] == first["node"], "left").select("key", "id", "size", F.coalesce("root", "id").alias("comp"))
    open_ = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("size").alias("total")).where("low != high")
    open_ = open_.select("key", F.ceil(F.col("total") * 8 / SET_BYTES).cast("long").alias("parts"))
    own = F.pmod(F.xxhash64("id"), F.col("parts"))
    code = lambda i, j: i * F.col("parts") + j
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: code(F.least(own, k), F.greatest(own, k)))
    dealt = named.join(open_, "key").select("key", "id", "comp", F.explode(blocks).alias("block")).join(sets, "id")
    dealt = dealt.select("key", "block", "id", "comp", "shingles").repartition("key", "block").sortWithinPartitions("key", "block")
    more = scratch.keep(dealt.mapInArrow(_banded(similarity), "a long, b long"))
    found = components(linked.unionByName(more), scratch)
    roots = groups.join(found, groups["id"] == found["node"], "left").select(F.coalesce("root", "id").alias("root"), F.struct("none", "doc_id", "mark").alias("lead"))
    return scratch.keep(roots.groupBy("root").agg(F.min("lead").alias("lead")).select("lead.doc_id", "lead.mark")), repeated


def keep_one(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component of near copies: that with the least ``doc_id``.

    Near copies are texts whose sets of five-word shingles (A-Z lower-cased; of a shorter text
    its whole sequence) have a Jaccard similarity of at least ``similarity``. Null, empty and
    wordless texts are copies of each other. Of rows that share the kept ``doc_id`` the one with
    the least hash of all columns stays, equal rows once; rows without a ``doc_id`` stay only where
    their whole component has none. An empty table gives no rows; a very long text is one set;
    other columns pass through, whatever their names.
    """
    rows = _marked(docs)
    firsts, repeated = similar_groups(Scratch(spark), rows, similarity)
    kept = rows.select("row", "doc_id", "mark").join(firsts, rows["doc_id"].eqNullSafe(firsts["doc_id"]) & (rows["mark"] == firsts["mark"]), "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["doc_id", "mark"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
