"""Where long repeats can lie: minimizer runs shared by the two substring operators.

A window of ``W`` units (bytes or words) is a repeat if the same window starts anywhere else.
Every window selects its least-hashed gram of ``k`` units, so equal windows select equal grams.
Neighbouring windows that select the same gram form a run, and only runs whose gram occurs
again can hold repeats. Runs are about ``2 / (W - k + 2)`` a unit; what is shuffled for all
text is one short row a run, and the text itself only of runs whose gram repeats. Documents of
equal content are represented by one of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Writer, rows_of, text_bytes

#: Units that are hashed at a time; longer documents are cut with an overlap of a window.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 5
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        m = max(n, CHUNK)
        inverse = pow(_BASE, -1, 1 << 64)
        ones = [np.full(m, np.uint64(b)) for b in (_BASE, inverse)]
        for x in ones:
            x[0] = 1
        _powers = tuple(np.multiply.accumulate(x) for x in ones)
    return _powers


def _slide(ufunc: np.ufunc, x: np.ndarray, w: int, fill: int) -> np.ndarray:
    """``ufunc`` (minimum or maximum) over each ``w`` neighbours, from block prefixes and suffixes."""
    n = len(x)
    pad = np.full(-n % w, np.uint64(fill))
    b = np.concatenate((x, pad)).reshape(-1, w)
    left = ufunc.accumulate(b, axis=1).ravel()
    right = ufunc.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(right[: n - w + 1], left[w - 1 : n])


def rolling(sym: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` neighbours among the symbols."""
    n = len(sym)
    if n < size:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(n)
    s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(sym * power[:n])))
    v = (s[size:] - s[:-size]) * inverse[: n - size + 1]
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(29)
    return v


def rolling_pair(sym: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two such hashes, of the symbols and of the symbols mixed anew: 128 bits together."""
    other = sym ^ (sym >> np.uint64(33))
    other = (other * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (other >> np.uint64(27))
    return rolling(sym, size), rolling(other, size)


def minimizer_runs(sym: np.ndarray, ends: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first, last, gram, again)`` of the runs of windows in documents that end at ``ends``.

    ``again`` tells that the gram stands more than once in this stretch, so that a run may
    hold a repeat of its own.
    """
    n, w = len(sym), window - k + 1
    if n < window:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(bool)
    v = rolling(sym, k)
    least = _slide(np.minimum, v, w, (1 << 64) - 1)
    valid = np.ones(n, bool)
    for e in ends.tolist():
        valid[max(0, e - window + 1) : e] = False
    valid = valid[: len(least)]
    differ = least[1:] != least[:-1]
    first = np.flatnonzero(valid & np.concatenate(([True], differ | ~valid[:-1])))
    last = np.flatnonzero(valid & np.concatenate((differ | ~valid[1:], [True])))
    gram = least[first]
    zero = np.zeros(w - 1, np.uint64)
    most = _slide(np.maximum, np.concatenate((zero, np.where(valid, least, np.uint64(0)), zero)), w, 0)
    chosen = np.sort(v[(v == most) & (most > 0)])
    again = np.isin(gram, chosen[1:][chosen[1:] == chosen[:-1]])
    return first, last, gram.view(np.int64), again


def word_symbols(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words)) | np.uint64(1)


@dataclass(frozen=True)
class Unit:
    """What a document is a sequence of, and the windows that count."""

    name: str
    window: int
    k: int
    chunk: int = CHUNK

    def split(self, data: bytes) -> tuple[np.ndarray, Callable[[int, int], bytes], bytes]:
        """Symbols, a function giving the text of a stretch, and the text that is compared whole."""
        if self.name == "byte":
            return _TABLE[np.frombuffer(data, np.uint8)], lambda a, b: data[a:b], data
        words = data.split()
        return word_symbols(words), lambda a, b: b" ".join(words[a:b]), b" ".join(words)


_INFO = pa.schema(
    [("doc_id", pa.int64()), ("key", pa.int64()), ("sha", pa.binary()), ("n", pa.int64())]
    + [("gram", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("again", pa.list_(pa.bool_()))]
)
INFO = "doc_id long, key long, sha binary, n long, gram array<long>, first array<long>, last array<long>, again array<boolean>"


def _stretches(n: int, unit: Unit) -> Iterator[tuple[int, int]]:
    for at in range(0, max(n - unit.window + 1, 0), unit.chunk):
        yield at, min(at + unit.chunk + unit.window - 1, n)


def describe(docs: DataFrame, unit: Unit) -> DataFrame:
    """INFO rows of ``docs(doc_id, key, data)``: content digest, length and runs of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(_INFO, rows=2000)
        held, parts, size = [], [], 0

        def settle() -> None:
            """Runs of the gathered stretches, each a (row, start, symbols)."""
            nonlocal parts, size, held
            runs = [([], [], [], []) for _ in held]
            if parts:
                ends = np.cumsum([len(p[2]) for p in parts])
                starts = ends - [len(p[2]) for p in parts]
                first, last, gram, again = minimizer_runs(np.concatenate([p[2] for p in parts]), ends, unit.window, unit.k)
                cuts = np.searchsorted(first, np.append(starts, ends[-1]))
                for (row, at, _), s, a, b in zip(parts, starts.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                    for own, x in zip(runs[row], (gram[a:b], first[a:b] - s + at, last[a:b] - s + at, again[a:b])):
                        own.extend(x.tolist())
            for (doc, key, sha, n), r in zip(held, runs):
                out.add(doc, key, sha, n, *r)
            held, parts, size = [], [], 0

        for doc, key, data in rows_of(batches, "doc_id", "key", "data"):
            sym, _, whole = unit.split(data)
            held.append((doc, key, hashlib.sha256(whole).digest(), len(sym)))
            for a, b in _stretches(len(sym), unit):
                parts.append((len(held) - 1, a, sym[a:b]))
                size += b - a
            if size >= CHUNK // 2 or len(held) >= 2000:
                settle()
                yield out.flush()
        if held:
            settle()
            yield out.flush()

    return docs.mapInArrow(run, INFO)


_CTX = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("gram", pa.int64()), ("digest", pa.binary()), ("first", pa.int64()), ("size", pa.int64()), ("text", pa.binary())])
CTX = "doc_id long, key long, gram long, digest binary, first long, size long, text binary"
#: Digests of stretches that a worker remembers as sent, so that copies travel without text.
SENT = 200_000


def contexts(docs: DataFrame, runs: DataFrame, unit: Unit) -> DataFrame:
    """CTX rows: each run of ``runs(doc_id, key, runs)`` with the stretch that its windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sent = Writer(_CTX), set()
        for doc, key, data, own in rows_of(batches, "doc_id", "key", "data", "runs"):
            _, text, _ = unit.split(data)
            for r in own:
                stretch = text(r["first"], r["last"] + unit.window)
                digest = hashlib.blake2b(stretch, digest_size=16).digest()
                new = digest not in sent
                if new:
                    if len(sent) >= SENT:
                        sent.clear()
                    sent.add(digest)
                if out.add(doc, key, r["gram"], digest, r["first"], r["last"] - r["first"] + unit.window, stretch if new else None, nbytes=len(stretch)):
                    yield out.flush()
        if len(out):
            yield out.flush()

    joined = docs.join(runs.hint("shuffle_hash"), (docs["doc_id"].eqNullSafe(runs["doc_id"])) & (docs["key"] == runs["key"]))
    return joined.select(docs["doc_id"], docs["key"], "data", "runs").mapInArrow(run, CTX)


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, data)``: the key tells rows that share a doc_id apart by their text."""
    data = text_bytes()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(data).alias("key"), data.alias("data"))


def once(docs: DataFrame, info: DataFrame) -> DataFrame:
    """Keyed rows, those of equal id and text once; a plain pass where no row repeats."""
    rows = keyed(docs)
    repeated = info.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return rows.dropDuplicates(["doc_id", "key"]) if repeated else rows


@dataclass
class Found:
    """What ``candidates`` gives: INFO rows, ``copies(sha, copies)`` of contents that occur more
    than once, CTX rows of one row a content for runs whose gram occurs again, and the keyed
    rows without repeated ones."""

    info: DataFrame
    copies: DataFrame
    found: DataFrame
    docs: DataFrame


def candidates(scratch: Scratch, docs: DataFrame, unit: Unit) -> Found:
    """The stretches that can hold repeats. One row leads each content, however often its id
    and text are repeated, so what follows grows with the distinct texts."""
    info = scratch.keep(describe(keyed(docs), unit).withColumn("row", F.monotonically_increasing_id()))
    groups = scratch.keep(info.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "row")).alias("least")).select("sha", "copies", F.col("least.row").alias("row")))
    one = info.where(F.size("gram") > 0).select("sha", "row", "doc_id", "key", F.arrays_zip("gram", "first", "last", "again").alias("runs"))
    lead = scratch.keep(one.join(groups.select("sha", "row"), ["sha", "row"]).select("doc_id", "key", F.explode("runs").alias("r")).select("doc_id", "key", "r.*"))
    # Kept as a table: a join of two plain inputs lets adaptive execution split a frequent gram.
    again = scratch.keep(lead.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("own")).where("n > 1 or own").select("gram"))
    runs = lead.join(again, "gram").groupBy("doc_id", "key").agg(F.collect_list(F.struct("gram", "first", "last")).alias("runs"))
    rows = once(docs, info)
    found = scratch.keep(contexts(rows, runs, unit))
    scratch.drop(lead)
    return Found(info, groups.where("copies > 1").select("sha", "copies"), found, rows)


def stretches(found: DataFrame) -> DataFrame:
    """Distinct stretches ``(gram, digest, n, text)``; counted before the shuffle, so a passage
    that very many documents share arrives as one row a task."""
    return found.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("text").alias("text"))


def spans(found: DataFrame, hits: DataFrame, unit: Unit) -> DataFrame:
    """``(doc_id, key, spans)`` from ``hits(gram, digest, windows)``.

    ``windows`` are pairs (first, last) of repeated windows within a stretch; the spans are
    in units of the document and may overlap.
    """
    joined = found.select("doc_id", "key", "gram", "digest", "first").join(hits, ["gram", "digest"])
    return (
        joined.select("doc_id", "key", "first", F.explode("windows").alias("w"))
        .groupBy("doc_id", "key")
        .agg(F.collect_list(F.struct((F.col("first") + F.col("w.a")).alias("a"), (F.col("first") + F.col("w.b") + unit.window).alias("b"))).alias("spans"))
    )


def merge_spans(own: list) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined, in order."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in own):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_CUT = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def cut(docs: DataFrame, found: DataFrame, unit: Unit) -> DataFrame:
    """``(doc_id, key, n_removed, n_spans, kept_sha256)`` of the documents with spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(_CUT)
        for doc, key, data, own in rows_of(batches, "doc_id", "key", "data", "spans"):
            merged = merge_spans(own)
            digest = hashlib.sha256(kept_text(data, merged, unit)).hexdigest()
            if out.add(doc, key, sum(b - a for a, b in merged), len(merged), digest):
                yield out.flush()
        if len(out):
            yield out.flush()

    joined = docs.join(found.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(found["doc_id"]) & (docs["key"] == found["key"]))
    schema = "doc_id long, key long, n_removed long, n_spans long, kept_sha256 string"
    return joined.select(docs["doc_id"], docs["key"], "data", "spans").mapInArrow(run, schema)


def kept_text(data: bytes, merged: list[tuple[int, int]], unit: Unit) -> bytes:
    """What is left of a document without its spans; words are joined by one space."""
    units = data if unit.name == "byte" else data.split()
    parts, at = [], 0
    for a, b in merged:
        parts.append(units[at:a])
        at = b
    parts.append(units[at:])
    return b"".join(parts) if unit.name == "byte" else b" ".join(w for p in parts for w in p)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_text(data: bytes, merged: list[tuple[int, int]], unit: Unit) -> bytes:
    """A document without its spans that otherwise stays as it is. Words go with the white space
    behind them; the last word of all goes without."""
    if unit.name == "word":
        start, end = zip(*((m.start(), m.end()) for m in _WORD.finditer(data)))
        merged = [(start[a], start[b] if b < len(start) else end[-1]) for a, b in merged]
    return kept_text(data, merged, Unit("byte", 1, 1))


def outcome(scratch: Scratch, docs: DataFrame, unit: Unit, hits: Callable[[Scratch, DataFrame, Unit], DataFrame]) -> DataFrame:
    """A row for every document: doc_id, n, n_removed, n_spans, kept_sha256, sha, copies."""
    own = candidates(scratch, docs, unit)
    return outcome_of(scratch, unit, own, spans(own.found, hits(scratch, own.found, unit), unit))


def outcome_of(scratch: Scratch, unit: Unit, own: Found, part: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """The same from spans ``part(doc_id, key, spans)``; ``extra(doc_id, key, ...)`` adds columns."""
    place = scratch.keep(part)
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])
    done = cut(own.docs, place, unit)
    more = []
    if extra is not None:
        more = [c for c in extra.columns if c not in ("doc_id", "key")]
        # The documents with an extra are not always those with spans.
        done = done.withColumnRenamed("doc_id", "own_doc").withColumnRenamed("key", "own_key")
        done = extra.join(done, extra["doc_id"].eqNullSafe(done["own_doc"]) & (extra["key"] == done["own_key"]), "full")
        either = lambda a, b: F.when(F.col("key").isNull(), F.col(b)).otherwise(F.col(a))
        done = done.select(either("doc_id", "own_doc").alias("doc_id"), F.coalesce("key", "own_key").alias("key"), "n_removed", "n_spans", "kept_sha256", *more)
    done = scratch.keep(done)
    scratch.drop(own.found)
    left = own.info.select("doc_id", "key", "sha", "n").join(own.copies, "sha", "left")
    left = left.join(done, same(left, done), "left").drop(done["doc_id"]).drop(done["key"])
    whole = (F.col("copies") > 1) & (F.col("n") >= unit.window)
    pick = lambda all_of_it, part, none: F.when(whole, all_of_it).otherwise(F.coalesce(part, none))
    zero = F.lit(0).cast("long")
    return left.select(
        "doc_id",
        "n",
        pick(F.col("n"), F.col("n_removed"), zero).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.col("n_spans"), zero).alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256"), F.lower(F.hex("sha"))).alias("kept_sha256"),
        *more,
        "sha",
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
    )


def removed(spark: SparkSession, docs: DataFrame, unit: Unit, hits: Callable) -> DataFrame:
    """``docs`` without the text that repeats; all columns pass through, whatever their names,
    ``n_chars`` counted anew.

    Documents whose content occurs more than once keep nothing of it if a window fits in. A
    null text stays null and an empty one empty; repeated rows come back repeated; an empty
    table gives no rows.
    """
    scratch = Scratch(spark)
    own = candidates(scratch, docs, unit)
    part = spans(own.found, hits(scratch, own.found, unit), unit)
    double = own.info.where(F.col("n") >= unit.window).join(own.copies, "sha").select("doc_id", "key", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))).alias("spans"))
    place = scratch.keep(double.distinct().unionByName(part).groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    scratch.drop(own.found)

    @F.pandas_udf("string")
    def rest(data, own):
        import pandas as pd

        return pd.Series([None if s is None else cut_text(d, merge_spans(s), unit).decode("utf-8", "ignore") for d, s in zip(data, own)])

    # The row travels as one column, so that no name of its columns meets one used here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row").getField("text")
    keyed_ = rows.select("row", F.col("row").getField("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b""))).alias("mark"))
    joined = keyed_.join(place.hint("shuffle_hash"), keyed_["id"].eqNullSafe(place["doc_id"]) & (keyed_["mark"] == place["key"]), "left")
    data = F.when(F.col("spans").isNotNull(), text.cast("binary"))
    fresh = F.when(F.col("spans").isNull(), text).otherwise(rest(data, F.col("spans")))
    fresh = joined.select("row", fresh.alias("fresh"))
    size = lambda: F.length("fresh").cast(docs.schema["n_chars"].dataType)
    return fresh.select(*[F.col("fresh").alias("text") if c == "text" else size().alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns])
