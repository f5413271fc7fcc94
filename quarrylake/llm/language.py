"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword of signs; for each bit a binary classifier of hashed byte n-grams
separates the languages with a plus from those with a minus. A classifier's margin on a text is
the mean log-likelihood ratio of its n-grams, centred and scaled so that the nearest languages
of both sides lie at +1 and -1. Decoding sums, for each codeword, the bits' losses weighted by
how far apart their sides are, takes the least, and flags texts whose second choice is close.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Writer, rows_of, text_bytes

#: Hash buckets of two- and three-byte grams.
BUCKETS = 1 << 12
FOLDS = 5
AMBIGUOUS = 0.1
#: Letters keep their (lower) byte, all else is a space; bytes of other scripts stay.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x > 127 else 32 for x in range(256))
_STEP = 1 << 20


def grams(data: bytes) -> np.ndarray:
    """Counts of the hashed two- and three-byte grams of a whole text."""
    counts = np.zeros(BUCKETS, np.int64)
    folded = np.frombuffer(b" " + data.translate(_FOLD) + b" ", np.uint8)
    for at in range(0, len(folded) - 1, _STEP):
        x = folded[at : at + _STEP + 2].astype(np.uint32)
        two = x[:-1] * np.uint32(257) + x[1:]
        counts += np.bincount((two[:_STEP] * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
        if len(x) > 2:
            three = (two[:-1] * np.uint32(263) + x[2:]) * np.uint32(2246822519)
            counts += np.bincount(three[:_STEP] >> np.uint32(20), minlength=BUCKETS)
    return counts


def has_letter(data: bytes) -> bool:
    if any(65 <= x <= 90 or 97 <= x <= 122 for x in data[:64]) or data.translate(None, bytes(x for x in range(256) if x not in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")):
        return True
    return not data.isascii() and any(c.isalpha() for c in data.decode("utf-8", "replace"))


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """Sign matrix (languages x bits): all splits up to five languages, else random codes of
    which the set with the largest least distance in a fixed number of draws is taken."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        bits = np.arange(1 << (n - 1))[None, :-1] >> np.arange(n - 1)[:, None] & 1
        return np.vstack([np.ones(bits.shape[1]), 2.0 * bits - 1])
    rng, best, most = np.random.default_rng(seed), None, -1
    width = 8 * int(np.ceil(np.log2(n)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        if (abs(code.sum(axis=0)) == n).any():
            continue
        apart = (code @ code.T)[~np.eye(n, dtype=bool)].max()
        if best is None or -apart > most:
            best, most = code, -apart
    return best


class Model:
    """Codewords, the bits' weight vectors, and their centring, from n-gram counts by language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.code = codewords(len(self.langs))
        if not self.langs:
            return
        c = np.array([counts[k] for k in self.langs], float) + 0.5
        p = c / c.sum(axis=1, keepdims=True)
        plus, minus = self.code > 0, self.code < 0
        if len(self.langs) == 1:
            self.weights, self.centre, self.scale, self.trust = np.zeros((BUCKETS, 1)), np.zeros(1), np.ones(1), np.ones(1)
            return
        up = (p.T @ plus) / plus.sum(axis=0)
        down = (p.T @ minus) / minus.sum(axis=0)
        self.weights = np.log(up) - np.log(down)
        at = p @ self.weights  # each language's expected margin
        low = np.where(plus, at, np.inf).min(axis=0)
        high = np.where(minus, at, -np.inf).max(axis=0)
        self.centre, self.scale = (low + high) / 2, np.maximum((low - high) / 2, 1e-3)
        self.trust = self.scale / self.scale.sum()

    def decode(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of texts given as rows of n-gram counts."""
        n = np.maximum(x.sum(axis=1, keepdims=True), 1)
        margin = (x @ self.weights / n - self.centre) / self.scale
        loss = np.stack([(np.log1p(np.exp(-np.clip(self.code[k] * margin, -30, 30) * 2)) * self.trust).sum(axis=1) for k in range(len(self.langs))], axis=1)
        order = np.sort(loss, axis=1)
        score = np.ones(len(x)) if len(self.langs) == 1 else (order[:, 1] - order[:, 0]) / np.maximum(order[:, 1] + order[:, 0], 1e-12)
        return [self.langs[k] for k in loss.argmin(axis=1)], np.clip(score, 0, 1)


def fold(doc_id: Column) -> Column:
    """True for held-out documents: crc32 of the id as text leaves no remainder by FOLDS."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """A model from all rows of ``docs(doc_id, text, lang)`` that are not held out.

    Counts are summed in each task and then by language and bucket; the driver receives
    BUCKETS numbers a language. Rows with a null id, text or language teach nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for lang, data in rows_of(batches, "lang", "data"):
            sums[lang] = sums.get(lang, 0) + grams(data)
        for lang, c in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * BUCKETS, "k": np.arange(BUCKETS), "n": c})

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~fold(F.col("doc_id"))).select("lang", text_bytes().alias("data"))
    sums = rows.mapInArrow(count, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang").agg(F.collect_list(F.struct("k", "n")).alias("c")).toLocalIterator():
        own = np.zeros(BUCKETS)
        for x in r["c"]:
            own[x["k"]] = x["n"]
        counts[r["lang"]] = own
    return Model(counts)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, ambiguous)`` for every row of ``docs(doc_id, text)``."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, out = shared.value, Writer(_OUT)
        held: list[tuple] = []

        def settle() -> pa.RecordBatch:
            texts = [k for k, h in enumerate(held) if m.langs and has_letter(h[2])]
            got: dict[int, tuple] = {}
            if texts:
                langs, scores = m.decode(np.array([grams(held[k][2]) for k in texts], float))
                got = {k: (lang, float(s)) for k, lang, s in zip(texts, langs, scores)}
            for k, (doc, out_of, _) in enumerate(held):
                lang, score = got.get(k, ("und", 0.0))
                out.add(doc, out_of, lang, score, lang != "und" and score < AMBIGUOUS)
            held.clear()
            return out.flush()

        for row in rows_of(batches, "doc_id", "held_out", "data"):
            held.append(row)
            if len(held) >= 256:
                yield settle()
        if held:
            yield settle()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id")).alias("held_out"), text_bytes().alias("data"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Predicted language of every row of ``docs(doc_id, text, lang)``.

    Learns from the rows that are not held out, predicts from text alone. A null text or one
    without a letter is ``und`` with score 0, as is every text if no row teaches a language;
    repeated rows come back repeated; a null ``doc_id`` stays null, is not held out and teaches
    nothing; an empty table gives no rows.
    """
    return predict(spark, docs, fit(docs))
