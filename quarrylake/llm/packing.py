"""Best-fit packing of tokenised documents under token, document-count and attention limits.

Documents are tokenised, end with id 0, and are cut into pieces only where longer than a
sequence. Packing works on the histogram of piece lengths, which has at most as many entries
as a sequence has tokens: lengths are placed in decreasing order, a whole class of equal
pieces at a time, into classes of equal open sequences. Among the classes that can take a
piece under every limit, the one that fits best wins: by the norm of the residual that would
be left, or by the weighted dot product of residual and demand. The plan is a list of runs
(length, ranks, first sequence, offset); each piece finds its run from its rank among the
pieces of its length, which is counted in salted parts, so a length that a third of all
pieces share is no hot key.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, Writer, rows_of, text_bytes

TOKENS = 2048
#: Distinct words whose ids a worker remembers; beyond it the memory starts anew.
WORD_CACHE = 200_000
#: Longer words (in bytes) are split anew each time, so that what is remembered is bounded in bytes too.
LONG_WORD = 256


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of a text, word by word, as little-endian 32-bit integers.

    The tokenizer drops white space and never joins across it, so the ids of a text are those
    of its words in turn; words seen before come from memory. New words of Latin letters,
    digits and signs are split as the tokenizer splits them and merged by a rank table with
    the same merges (the word end is one more byte, 0xFF, which UTF-8 never holds); all others
    go through the tokenizer itself. A table that doesn't have that layout is not used.
    """

    def __init__(self, path: str, cache: int = WORD_CACHE):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.known = Tokenizer.from_file(path), cache, {}
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.piece, self.to_id = self._ranks(path)

    def _ranks(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        split = (model.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        if model["model"].get("end_of_word_suffix") != "</w>" or (split.get("pattern") or {}).get("Regex") != self.pattern.pattern:
            return None, None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [x for x in range(256) if x not in plain]
        byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(other)}
        raw = lambda t: bytes(byte[c] for c in t.removesuffix("</w>")) + b"\xff" * t.endswith("</w>")
        vocab, ids = model["model"]["vocab"], {}
        sign = {x: c for c, x in byte.items()}
        ranks = {bytes([x]): x for x in range(256)} | {bytes([x, 255]): 256 + x for x in range(255)}
        for x in range(256):
            ids[x] = vocab.get(sign[x], 0)
            if x < 255:
                ids[256 + x] = vocab[sign[x] + "</w>"]
        for k, merge in enumerate(model["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            if ranks.setdefault(raw(left + right), 512 + k) != 512 + k:
                return None, None
            ids[512 + k] = vocab[left + right]
        to_id = [ids.get(k, 0).to_bytes(4, "little") for k in range(max(ids) + 1)]  # rank 511 stands for no word end
        coder = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        return coder._core_bpe.encode_single_piece, to_id

    def _ids(self, data: bytes) -> bytes:
        return np.array(self.tokenizer.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, w: bytes) -> bytes:
        if self.piece is None or b"<|" in w:
            return self._ids(w)
        if w.isascii():
            low = w.lower()
            if low.isalpha():
                return b"".join([self.to_id[k] for k in self.piece(low + b"\xff")])
            parts = self.pattern.findall(low.decode())
        else:
            s = unicodedata.normalize("NFC", w.decode("utf-8", "replace"))
            if max(s) > "\u024f" or any(x in s for x in "\x85\xa0"):
                return self._ids(w)
            s = s.lower()
            parts = [s] if s.isalpha() else self.pattern.findall(s)
        return b"".join([self.to_id[k] for p in parts for k in self.piece(p.encode() + b"\xff")])

    def encode(self, data: bytes) -> bytes:
        words, known = data.split(), self.known
        if len(known) > self.cache:
            known = self.known = {}
        ids = list(map(known.get, words))
        at = -1
        try:
            while True:
                at = ids.index(None, at + 1)
                w = words[at]
                got = known.get(w)
                if got is None:
                    got = self.word(w)
                    if len(w) <= LONG_WORD:
                        known[w] = got
                ids[at] = got
        except ValueError:
            return b"".join(ids)


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One table a worker process, whatever the number of its tasks."""
    return WordIds(path)


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int64())])


def pieces(docs: DataFrame, path: str, tokens: int = TOKENS) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, salt)`` for every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, out = word_ids(path), Writer(_PIECE)
        for doc, data in rows_of(batches, "doc_id", "data"):
            ids = words.encode(data) + b"\0\0\0\0"
            for k, at in enumerate(range(0, len(ids), 4 * tokens)):
                part = ids[at : at + 4 * tokens]
                crc = zlib.crc32(part)
                if out.add(doc, k, at // 4, len(part) // 4, crc, crc):
                    yield out.flush()
        if len(out):
            yield out.flush()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data")).mapInArrow(cut, schema)


#: Weights of the residuals of tokens, documents and attention cost in the choice of a sequence.
WEIGHTS = (1.0, 0.01, 0.01)


def _levels(used: np.ndarray, limits: np.ndarray, binding: np.ndarray) -> tuple[float, float, float]:
    """What a sequence has used, as its class counts it. Tokens are exact. The other two are
    rounded, so that the number of classes doesn't grow with the number of documents: up where
    they bind (documents beyond 16 to a multiple of 16, cost to a 64th of its limit), which keeps
    to the limit; else to one of a few levels, as tokens alone decide what fits."""
    docs, cost = used[1], used[2]
    if binding[1]:
        docs = docs if docs <= 16 else -(-docs // 16) * 16
    else:
        docs = min(docs, 4.0)
    step = limits[2] / (64 if binding[2] else 8)
    cost = (np.ceil if binding[2] else np.floor)(round(cost / step, 9)) * step
    return float(used[0]), float(docs), float(cost)


def plan(counts: dict[int, int], tokens: int = TOKENS, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Runs ``(length, first rank, sequence, offset)`` that place ``counts`` pieces by length.

    Capacities of a sequence: ``tokens``; ``max_docs`` pieces; ``max_cost``, the sum of squared
    lengths (attention). None is as much as ``tokens`` tokens can need: ``tokens`` pieces, and
    ``tokens`` squared. All three residuals, each as a share of its capacity, choose the sequence:
    by ``norm`` (least weighted norm of what would be left) or ``dot`` (largest weighted dot
    product of residual and demand), the fuller one in a tie. A piece that alone exceeds
    ``max_cost`` still gets its own sequence.
    """
    limits = np.array([tokens, max_docs or tokens, max_cost or tokens * tokens], float)
    binding = np.array([True, max_docs is not None, max_cost is not None])  # the others hold wherever tokens do
    w = np.array(weights) / limits**2
    classes: list[list[tuple[int, int]]] = []  # runs of sequences (first, number) in each class
    at: dict[tuple, int] = {}
    room = np.zeros((64, 3))  # residuals of each class
    some = np.zeros(64, bool)  # classes that are not empty
    runs, fresh = [], 0

    def put(used: np.ndarray, first: int, number: int) -> None:
        nonlocal room, some
        if used[0] >= tokens or binding[1] and used[1] >= limits[1]:
            return
        key = _levels(used, limits, binding)
        k = at.setdefault(key, len(classes))
        if k == len(classes):
            classes.append([])
            if k == len(room):
                room, some = np.concatenate((room, np.zeros_like(room))), np.concatenate((some, np.zeros_like(some)))
            room[k] = limits - key
        classes[k].append((first, number))
        some[k] = True

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length], float)
        least = np.where(binding, need, -np.inf)
        while left:
            fits = np.flatnonzero(some & (room >= least).all(axis=1))
            if len(fits):
                r = room[fits]
                score = ((r - need) ** 2 @ w) if rule == "norm" else -(r * need @ w)
                k = int(fits[np.lexsort((r[:, 0], score))[0]])
                first, number = classes[k].pop()
                take = min(left, number)
                if take < number:
                    classes[k].append((first + take, number - take))
                some[k] = bool(classes[k])
                runs.append((length, rank, first, int(tokens - room[k, 0])))
                put(limits - room[k] + need, first, take)
            else:
                # As many sequences as the class needs, each holding as many of it as fit.
                take = max(1, -(-left // max(1, int(min(limits[binding] // need[binding])))))
                runs.append((length, rank, fresh, 0))
                put(np.minimum(need, limits), fresh, take)
                fresh += take
            left, rank = left - take, rank + take
    return np.array(runs, np.int64).reshape(-1, 4)


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, tokens: int = TOKENS, **limits) -> DataFrame:
    """Every piece of ``docs(doc_id, text)`` with its sequence and place.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. ``limits`` are those
    of ``plan``. A null text counts as empty and is the single id 0; repeated rows are packed as
    often as they occur; a null ``doc_id`` stays null; an empty table gives no rows; a very long
    text is many pieces; other columns are ignored, whatever their names. Sequences have no gaps.
    What goes to the driver is a histogram of at most ``tokens`` lengths, and the plan sent back
    is bounded by the number of lengths and classes, not of documents.
    """
    scratch = Scratch(spark)
    made = scratch.keep(pieces(docs, path or tokenizer_path(), tokens))
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(salts)).cast("int"))
    counts = made.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `tokens` rows
    runs = plan(histogram, tokens, **limits)
    starts: dict[int, tuple] = {}
    for length in np.unique(runs[:, 0]):
        own = runs[runs[:, 0] == length]
        starts[int(length)] = (own[:, 1], own[:, 2], own[:, 3])
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = made.withColumn("rank", rank).join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base")).drop("salt", "base")
    shared = spark.sparkContext.broadcast(starts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = shared.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for idx in np.split(order, cuts) if len(order) else []:
                first, number, offset = by[int(length[idx[0]])]
                k = np.searchsorted(first, rank[idx], "right") - 1
                seq[idx], off[idx] = number[k] + rank[idx] - first[k], offset[k]
            cols = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, out)
