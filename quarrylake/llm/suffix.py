"""Repeated strings of bytes or words by suffix arrays: Larsson-Sadakane refinement, Kasai, merging.

Stretches that may hold repeats (see ``repeats``) are dealt out by their gram into shards of a
few megabytes. A shard sorts its suffixes by prefix doubling that refines unsorted groups alone
(Larsson and Sadakane) up to the window's length, takes common prefixes of neighbours by Kasai's
rule in its vectorised form, and marks windows whose common prefix with a neighbour reaches the
window. A gram with more text than a shard spreads over several; each then hands on the 128-bit hash of
every distinct window, and the windows of other shards are found among the sorted hashes by
binary search.

Windows of bytes shorter than the one that is cut tell passages: where they repeat over less than
the window, the text stays but is counted, and only where they repeat over at least the window
can the window itself repeat, so the longer windows are sought in those regions alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import Scratch, Writer

WINDOW = 400
#: Bytes of a repeated passage that is counted; fifty words and more of most languages.
PASSAGE = 240
#: Words of a passage that ``without_passages`` cuts.
PASSAGE_WORDS = 50
#: Symbols of stretches in one suffix array.
SHARD = 400_000
#: Pairs that are compared at a time.
PAIRS = 8192


def suffix_array(text: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``(sa, rank)``: suffixes sorted by their first ``depth`` symbols; equal ones share a rank.

    Symbols are bytes, or numbers below 2**32. ``room`` is the number of symbols from each
    position to the end of its stretch. Suffixes that end before the depth reached are left out
    of further rounds: nothing looks at them.
    """
    n = len(text)
    start = 8 if text.dtype == np.uint8 else 2  # symbols in the first key
    packed = np.zeros(n + start, np.uint64)
    padded = np.concatenate((text, np.zeros(start, text.dtype))).astype(np.uint64)
    for k in range(min(start, depth)):
        packed[:n] = (packed[:n] << np.uint64(64 // start)) | padded[k : n + k]
    at = np.flatnonzero(room >= min(start, depth))
    order = np.argsort(packed[at], kind="stable")
    sa = at[order]
    key = packed[sa]
    rank = np.full(n + depth, -1, np.int64)

    def settle(sa: np.ndarray, new: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Give each group the index of its first member; return members of groups over one."""
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(sa)))
        rank[sa] = np.repeat(base[start], size)
        return np.repeat(size > 1, size)

    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    open_ = np.flatnonzero(settle(sa, new, np.arange(len(sa))))
    h = start
    while h < depth and len(open_):
        step = min(h, depth - h)
        reach = h + step
        open_ = open_[room[sa[open_]] >= reach]
        own = sa[open_]
        group, follow = rank[own], rank[own + step]
        order = np.lexsort((follow, group))
        own, group, follow = own[order], group[order], follow[order]
        # Members keep the slots of their group; those that ended earlier stay behind.
        first = np.concatenate(([True], group[1:] != group[:-1])) if len(own) else np.zeros(0, bool)
        new = first | np.concatenate(([True], follow[1:] != follow[:-1])) if len(own) else first
        starts = np.flatnonzero(first)
        slot = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own)))) + group
        sa_new = own
        keep = settle(sa_new, new, slot)
        sa[open_] = sa_new
        open_ = open_[keep]
        h = reach
    return sa[open_], rank


def kasai(text: np.ndarray, room: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common prefix lengths of the suffix pairs ``(i, j)``, as far as both stretches go.

    Kasai: a pair one place right of another pair has its length less one. Pairs that start
    such a chain are compared directly; the rest of the chain follows from them.
    """
    order = np.lexsort((j, i - j))
    a, b = i[order], j[order]
    chain = np.concatenate(([True], ((a - b)[1:] != (a - b)[:-1]) | (a[1:] != a[:-1] + 1))) if len(a) else np.zeros(0, bool)
    start = np.flatnonzero(chain)
    x, y = a[start], b[start]
    limit = np.minimum(room[x], room[y])
    length = np.zeros(len(start), np.int64)
    live = np.arange(len(start))
    padded = np.concatenate((text, np.zeros(64, text.dtype)))
    cols = np.arange(64)
    while len(live):
        own, live = live[:PAIRS], live[PAIRS:]
        p, q = x[own] + length[own], y[own] + length[own]
        differ = padded[p[:, None] + cols] != padded[q[:, None] + cols]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), 64)
        length[own] = np.minimum(length[own] + same, limit[own])
        live = np.concatenate((live, own[(same == 64) & (length[own] < limit[own])]))
    size = np.diff(np.append(start, len(a)))
    lcp = np.empty(len(a), np.int64)
    value = np.repeat(length, size) - (np.arange(len(a)) - np.repeat(start, size))
    lcp[order] = value
    # A chain may run past the first mismatch; such pairs are compared on their own.
    short = np.flatnonzero(lcp <= 0)
    if len(short):
        lcp[short] = [_direct(text, room, int(i[k]), int(j[k])) for k in short]
    return lcp


def _direct(text: np.ndarray, room: np.ndarray, i: int, j: int) -> int:
    m = int(min(room[i], room[j]))
    d = np.flatnonzero(text[i : i + m] != text[j : j + m])
    return int(d[0]) if len(d) else m


def repeated_windows(parts: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hit, starts, rank)`` over the joined parts: windows that occur at least twice in them."""
    text = np.concatenate(parts)
    size = np.array([len(p) for p in parts])
    ends = np.cumsum(size)
    room = np.repeat(ends, size) - np.arange(len(text))
    room_all = np.append(room, np.zeros(window, room.dtype))
    sa, rank = suffix_array(text, room_all[: len(text)], window)
    hit = np.zeros(len(text), bool)
    if len(sa) > 1:
        near = np.flatnonzero(rank[sa[1:]] == rank[sa[:-1]])
        i, j = sa[near + 1], sa[near]
        enough = kasai(text, room_all, i, j) >= window
        hit[i[enough]] = True
        hit[j[enough]] = True
    return hit, ends - size, rank


def symbols(texts: list[bytes], unit: repeats.Unit) -> tuple[list[np.ndarray], np.ndarray]:
    """The symbols of each stretch, exact within the list, and the hash of each symbol."""
    if unit.name == "byte":
        return [np.frombuffer(t, np.uint8) for t in texts], repeats._TABLE
    known: dict[bytes, int] = {}
    parts = [np.array([known.setdefault(w, len(known)) for w in t.split(b" ")], np.uint32) for t in texts]
    return parts, repeats.word_symbols(list(known))


_HIT = pa.schema([("gram", pa.int64()), ("digest", pa.binary()), ("windows", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("open", pa.binary()), ("at", pa.binary())])
HIT = "gram long, digest binary, windows array<struct<a:long,b:long>>, open binary, at binary"


def runs_of(flags: np.ndarray) -> list[dict]:
    """Maximal runs of true flags as (first, last)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"a": a, "b": b - 1} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _shards(unit: repeats.Unit, shard: int):
    window = unit.window
    per = 1 if unit.name == "byte" else 6  # bytes of a symbol, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            parts, hashes = symbols([r[4] for r in rows], unit)
            hit, starts, rank = repeated_windows(parts, window)
            out = Writer(_HIT)
            sent = np.zeros(len(rank), bool)  # classes of equal windows that are handed on already
            for (gram, digest, n, _, _, split), own, s in zip(rows, parts, starts.tolist()):
                m = len(own) - window + 1
                flags = hit[s : s + m] if n == 1 else np.ones(m, bool)
                open_ = at = None
                if split:  # the hash of each distinct window of this shard, for the other shards
                    k = np.arange(m)
                    twin = hit[s : s + m]
                    k = k[~(twin & sent[rank[s : s + m]])]
                    first = np.unique(np.where(twin[k], rank[s + k], -1 - k), return_index=True)[1]
                    k = np.sort(k[first])
                    sent[rank[s + k[twin[k]]]] = True
                    a, b = repeats.rolling_pair(hashes[own], window)
                    open_, at = np.stack((a[k], b[k]), axis=1).astype(">u8").tobytes(), k.astype("<i8").tobytes()
                found = runs_of(flags)
                if found or split:
                    out.add(gram, digest, found, open_, at)
            return out.flush()

        last = None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("gram", "digest", "n", "salt", "text", "split"))):
                if size >= shard * per and (row[0], row[3]) != last:
                    yield solve(rows)
                    rows, size = [], 0
                last = (row[0], row[3])
                rows.append(row)
                size += len(row[4])
        if rows:
            yield solve(rows)

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for gram, digest, own, at in zip(*(batch.column(k).to_pylist() for k in ("gram", "digest", "open", "at"))):
            k = np.frombuffer(at, "<i8")
            d = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(k), [None, pa.py_buffer(own)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([d, pa.array([gram] * len(k), pa.int64()), pa.array([digest] * len(k), pa.binary()), pa.array(k)], names=["d", "gram", "digest", "k"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that two shards hold; the rows of a partition come sorted by their hash."""
    held = None

    def shared(table: pa.Table, d: np.ndarray) -> list[pa.RecordBatch]:
        many = np.searchsorted(d, d, "right") - np.searchsorted(d, d, "left") > 1
        return table.filter(pa.array(many)).select(["gram", "digest", "k"]).combine_chunks().to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        d = np.array(table.column("d").to_pylist(), "V16").view(">u8").reshape(-1, 2)
        d = np.unique(d, axis=0, return_inverse=True)[1].ravel()  # ranks keep the order
        cut = int(np.searchsorted(d, d[-1], "left"))  # the last hash may go on in the next batch
        yield from shared(table.slice(0, cut), d[:cut])
        held = table.slice(cut)
    if held is not None and held.num_rows > 1:
        yield from held.select(["gram", "digest", "k"]).combine_chunks().to_batches()


def hits(scratch: Scratch, found: DataFrame, unit: repeats.Unit, shard: int | None = None) -> DataFrame:
    """``(gram, digest, windows)``: repeated windows of each distinct stretch."""
    shard = shard or SHARD
    apart = scratch.keep(repeats.stretches(found))
    weight = apart.groupBy("gram").agg(F.sum(F.length("text")).alias("total")).where(F.col("total") > 2 * shard)
    large = weight.select("gram", F.ceil(F.col("total") / shard).cast("int").alias("salts"))
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("digest"), F.col("salts"))).cast("int")
    dealt = apart.join(large, "gram", "left").select("gram", "digest", "n", salt.alias("salt"), "text", F.col("salts").isNotNull().alias("split"))
    made = scratch.keep(dealt.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "digest").mapInArrow(_shards(unit, shard), HIT))
    wide = made.where(F.col("open").isNotNull())
    opened = wide.mapInArrow(_opened, "d binary, gram long, digest binary, k long").repartition("d").sortWithinPartitions("d")
    met = opened.mapInArrow(_merged, "gram long, digest binary, k long")
    # What a shard marked by one window of a class holds for the class: its twins repeat anyway.
    extra = met.select("gram", "digest", F.array(F.struct(F.col("k").alias("a"), F.col("k").alias("b"))).alias("windows"))
    scratch.drop(apart)
    return made.where(F.size("windows") > 0).select("gram", "digest", "windows").unionByName(extra)


_REGION = pa.schema([("own_id", pa.int64()), ("own_key", pa.int64()), ("start", pa.int64()), ("n_passage", pa.int64()), ("text", pa.binary())])


def _regions(window: int):
    """Regions that passages cover over at least ``window`` bytes, and a row without text that
    tells how many bytes of the document passages cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(_REGION)
        for batch in batches:
            for doc, key, data, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "data", "spans"))):
                merged = repeats.merge_spans(own)
                out.add(doc, key, None, sum(b - a for a, b in merged), None)
                for a, b in merged:
                    if b - a >= window and out.add(doc, key, a, None, data[a:b], nbytes=b - a):
                        yield out.flush()
                if len(out) >= out.rows:
                    yield out.flush()
        if len(out):
            yield out.flush()

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, passage: int = PASSAGE) -> DataFrame:
    """Digest of what is left of every row of ``docs(doc_id, text)``.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage. A byte goes if a
    ``window``-byte string that covers it starts anywhere else, in the same document or another.
    ``n_passage`` counts the bytes covered by a string of ``passage`` (at most ``window``) bytes
    that starts anywhere else; those that the longer window does not cover stay in the text.
    Null texts are empty; repeated rows count as occurrences of their own; a null ``doc_id``
    stays null; an empty table gives no rows; texts shorter than the window lose nothing, very
    long ones are worked on in stretches; other columns are ignored, whatever their names.
    """
    passage = min(passage, window)
    scratch = Scratch(spark)
    unit = repeats.Unit("byte", passage, passage // 2)
    own = repeats.candidates(scratch, docs, unit)
    place = scratch.keep(repeats.spans(own.found, hits(scratch, own.found, unit), unit))
    scratch.drop(own.found)
    joined = own.docs.join(place.hint("shuffle_hash"), own.docs["doc_id"].eqNullSafe(place["doc_id"]) & (own.docs["key"] == place["key"]))
    made = joined.select(own.docs["doc_id"], own.docs["key"], "data", "spans").mapInArrow(_regions(window), "own_id long, own_key long, start long, n_passage long, text binary")
    made = scratch.keep(made.withColumn("doc_id", F.monotonically_increasing_id()))
    regions = made.where("start is not null")
    longer = repeats.Unit("byte", window, window // 2)
    inner = repeats.candidates(scratch, regions, longer)
    part = repeats.spans(inner.found, hits(scratch, inner.found, longer), longer).select("doc_id", "spans")
    every = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    double = inner.info.join(inner.copies, "sha").select("doc_id", every.alias("spans"))
    found = regions.join(part.unionByName(double), "doc_id").select(F.col("own_id").alias("doc_id"), F.col("own_key").alias("key"), F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b"))).alias("spans"))
    found = found.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    count = made.where("start is null").select(F.col("own_id").alias("doc_id"), F.col("own_key").alias("key"), F.col("n_passage").alias("n_some"))
    out = repeats.outcome_of(scratch, longer, own, found, count).withColumnRenamed("n", "n_bytes")
    n_passage = F.when((F.col("copies") > 1) & (F.col("n_bytes") >= passage), F.col("n_bytes")).otherwise(F.coalesce("n_some", F.lit(0).cast("long")))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", n_passage.alias("n_passage"))


def without_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; a cut character goes entirely.
    Nulls, repeated rows and other columns: see ``repeats.removed``."""
    return repeats.removed(spark, docs, repeats.Unit("byte", window, window // 2), hits)


def without_passages(spark: SparkSession, docs: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with every passage of ``words`` words or more that stands anywhere else cut out
    of ``text``; the suffix arrays are those of the texts' words. What stays keeps its lines and
    spaces. Nulls, repeated rows and other columns: see ``repeats.removed``."""
    return repeats.removed(spark, docs, repeats.Unit("word", words, words // 2), hits)
