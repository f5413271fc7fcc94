"""SentencePiece encoding, decoding, and sampled segmentations without replacement.

A text's lattice has an edge for every piece of the vocabulary that matches at a place, and a
byte-fallback edge for characters without a piece. An edge weighs ``(rank + 2) ** -alpha``, a
Zipf law over the ranks of the vocabulary; paths are weighed by the product of their edges.
Pieces hold word marks only in front, so the lattice falls into chunks that start at a mark.

Sampling is top-down Gumbel search (A* sampling): the whole set of paths has a Gumbel value,
the chosen branch of each node inherits the value of its set, and the branches not chosen share
one truncated Gumbel value of their joint mass. The next segmentation is found in the open set
with the largest value, so the ``k`` segmentations of a text are distinct and are a sample
without replacement; the value of the best set still open turns log-probabilities into
inclusion scores. Random numbers come from a counter hashed with the row's key, so a row gets
the same segmentations wherever and with whichever other rows it is processed.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Writer, text_bytes

SAMPLES, ALPHA, SEED = 2, 1.0, 20
MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Characters of one stretch; longer texts are walked stretch by stretch.
SEGMENT = 160_000
#: Words whose ids are remembered, each of up to so many characters.
KNOWN, KNOWN_CHARS = 200_000, 64
_B = np.uint64(0x9E3779B97F4A7C15)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(key: np.ndarray, sample: int, purpose: int) -> np.ndarray:
    """The start of a row's random numbers for a sample and a purpose."""
    return _mix(key.astype(np.uint64) + np.uint64((sample * 8 + purpose + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))


def drawn(start: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number in (0, 1) that a stream has at a place."""
    return ((_mix(start + at.astype(np.uint64) * _B) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def uniform(key: np.ndarray, at: np.ndarray, sample: int, purpose: int) -> np.ndarray:
    """Numbers in (0, 1) from the row's key, a place, a sample and a purpose."""
    return drawn(stream(key, sample, purpose), at)


class Vocabulary:
    """Pieces by hash of their characters, their log-weights, and their bytes."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.vocab_size()
        self.bytes = [b""] * n
        self.size = np.ones(n + 1, np.int64)  # characters of a piece; the last is for characters without one
        self.byte_id = [0] * 256
        pieces, ids = [], []
        for i in range(n):
            p = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes[i] = bytes([int(p[3:5], 16)])
            elif not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i)):
                self.bytes[i] = p.replace(MARK, " ").encode()
                self.size[i] = len(p)
                if MARK not in p.lstrip(MARK):
                    pieces.append(p)
                    ids.append(i)
        self.longest = max(map(len, pieces))
        # Where every piece has marks in front only, merges never join two chunks.
        self.apart = all(MARK not in (p := self.sp.id_to_piece(i)).lstrip(MARK) or self.sp.is_control(i) or self.sp.is_unknown(i) for i in range(n))
        self.coded: dict[str, list[int]] = {}
        keys = np.array([self.hash_of(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.log_weight = -alpha * np.log(np.arange(n) + 2.0)
        self.fallback = float(self.log_weight.min()) - alpha * np.log(256.0)
        # By the upper hash bits: the first piece that has them, and what may be the front of a longer one.
        slot = (self.keys >> np.uint64(42)).astype(np.int64)
        own, first, number = np.unique(slot, return_index=True, return_counts=True)
        self.first, self.most = np.full(1 << 22, -1, np.int32), int(number.max())
        self.first[own] = first
        self.front = np.zeros(1 << 22, bool)
        fronts = {p[:n] for p in pieces for n in range(1, len(p))}
        self.front[np.array([self.hash_of(p) >> 42 for p in fronts])] = True

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h + ord(c) + 1) * int(_B) & (1 << 64) - 1
            h ^= h >> 29
        return h

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """The tokenizer's ids of different chunks; a word is encoded once while it is remembered."""
        if len(self.coded) + len(chunks) > KNOWN:
            self.coded.clear()
        fresh = [c for c in chunks if c not in self.coded]
        # The tokenizer puts a mark in front itself, but not before an empty text.
        found = dict(zip(fresh, self.sp.encode([c[1:] for c in fresh], num_threads=1)))
        if MARK in found:
            found[MARK] = [self.sp.piece_to_id(MARK)]
        out = [self.coded[c] if c in self.coded else found[c] for c in chunks]
        self.coded.update((c, ids) for c, ids in found.items() if len(c) <= KNOWN_CHARS)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids; the mark in front of the first word is dropped."""
        out = b"".join([self.bytes[i] for i in ids])
        return out[1:] if out[:1] == b" " else out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    return Vocabulary(path, alpha)


class Lattice:
    """Edges of ``codes``, whose chunks begin at ``starts``; ``to_end`` counts to the chunk's end."""

    def __init__(self, v: Vocabulary, codes: np.ndarray, to_end: np.ndarray):
        n = len(codes)
        at, h, codes = np.arange(n), np.zeros(n, np.uint64), codes.astype(np.uint64) + np.uint64(1)
        froms, lens, ids = [], [], []
        for size in range(1, v.longest + 1):
            h = (h + codes[at + (size - 1)]) * _B
            h ^= h >> np.uint64(29)
            slot = (h >> np.uint64(42)).astype(np.int64)
            k = v.first[slot]
            maybe = np.flatnonzero(k >= 0)
            k, own = k[maybe], h[maybe]
            for _ in range(v.most - 1):  # pieces that share the upper bits are neighbours
                k = np.minimum(k + (v.keys[k] < own), len(v.keys) - 1)
            good = v.keys[k] == own
            froms.append(at[maybe[good]])
            lens.append(np.full(int(good.sum()), size, np.int64))
            ids.append(v.ids[k[good]])
            if size == 1:
                bare = np.ones(n, bool)
                bare[froms[0]] = False
                lone = np.flatnonzero(bare)
                froms.append(lone)
                lens.append(np.ones(len(lone), np.int64))
                ids.append(np.full(len(lone), -1))
            more = np.flatnonzero(v.front[slot] & (to_end[at] > size))
            at, h = at[more], h[more]
        start, size, piece = map(np.concatenate, (froms, lens, ids))
        # Backward masses, by distance to the chunk's end.
        order = np.argsort((to_end[start] << 32 | start) << 5 | size) if n < 1 << 31 and int(to_end.max(initial=0)) < 1 << 26 else np.lexsort((size, start, to_end[start]))
        start, size, piece = start[order], size[order], piece[order]
        logw = np.where(piece >= 0, v.log_weight[piece], v.fallback)
        mass = np.zeros(n + 1)
        node = np.concatenate(([True], start[1:] != start[:-1])) if n else np.zeros(0, bool)
        first = np.flatnonzero(node)
        dist = to_end[start[first]]
        cuts = np.searchsorted(dist, np.arange(1, int(dist.max(initial=0)) + 2))
        ends = np.append(first[1:], len(start))
        target = start + size
        ends_chunk = to_end[start] == size
        score = logw.copy()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            lo, hi = first[a], ends[b - 1]
            score[lo:hi] += np.where(ends_chunk[lo:hi], 0.0, mass[target[lo:hi]])
            own = first[a:b] - lo
            top = np.maximum.reduceat(score[lo:hi], own)
            counts = ends[a:b] - first[a:b]
            total = np.add.reduceat(np.exp(score[lo:hi] - np.repeat(top, counts)), own)
            mass[start[first[a:b]]] = top + np.log(total)
        self.size, self.piece = size, piece
        self.p = np.exp(score - np.repeat(mass[start[first]], ends - first))
        self.low, self.high = np.zeros(n, np.int64), np.zeros(n, np.int64)  # edges of each place
        self.low[start[first]], self.high[start[first]] = first, ends
        self.cum = np.concatenate(([0.0], np.cumsum(self.p)))
        self.to_end, self.n = to_end, n

    def choose(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge out of each place by its share: binary search among the place's own edges."""
        edge = self.low[at]
        number = self.high[at] - edge
        low = self.cum[edge]
        goal = low + u * (self.cum[edge + number] - low)
        for _ in range(int(number.max()).bit_length()):
            half = number >> 1
            beyond = self.cum[edge + half] <= goal
            edge = edge + half * beyond
            number = np.where(beyond, number - half, half)
        return edge

    def walk(self, at: np.ndarray, shift: np.ndarray, start: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place, edge, chunk)`` of one path from each node to the end of its chunk, in order
        of place. Chunks ``own`` have the shift from nodes to places and the random stream."""
        places, edges, chunks = [], [], []
        while len(at):
            place = at + shift[own]
            e = self.choose(at, drawn(start[own], place))
            places.append(place)
            edges.append(e)
            chunks.append(own)
            go = np.flatnonzero(self.to_end[at] > self.size[e])
            at, own = at[go] + self.size[e[go]], own[go]
        place = np.concatenate(places)
        order = np.argsort(place, kind="stable")
        return place[order], np.concatenate(edges)[order], np.concatenate(chunks)[order]


def _truncated(loc: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values at ``loc`` (log mass) that do not exceed ``bound``."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        g = loc - np.log(-np.log(u))
        return np.where(np.isneginf(loc), -np.inf, -np.logaddexp(-bound, -g))


def _chunks(text: str) -> list[str]:
    """The marked text, cut in front of each run of marks."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
        return _CHUNK.findall(MARK + text.replace(" ", MARK))
    return [MARK + w for w in text.split(" ")]


class Group:
    """Texts sampled together, stretch by stretch.

    A stretch has a lattice of its distinct chunks only: a word that comes often is one chunk
    for all its places. Long texts have several stretches, whose lattices are made in turn.
    """

    def __init__(self, v: Vocabulary, texts: list[str], keys: list[int]):
        self.v = v
        self.size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        self.keys = np.array([k & (1 << 64) - 1 for k in keys], np.uint64)
        self.words = [w for t in texts for w in _chunks(t)]
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)))
        self.chunk = np.concatenate((np.zeros(1, np.int64), ends[:-1])) if len(ends) else ends
        self.owner = np.searchsorted(self.end, self.chunk, "right")
        n = int(ends[-1]) if len(ends) else 0
        first, at = [0], 0  # numbers of the chunks that stretches begin with
        while n - at > SEGMENT:
            k = int(np.searchsorted(self.chunk, at + SEGMENT))
            if k >= len(self.chunk):
                break
            first.append(k)
            at = int(self.chunk[k])
        self.first = [*first, len(self.words)]
        self.cuts = [0, *self.chunk[first[1:]].tolist(), n]
        self.held: tuple[int, Lattice, np.ndarray] | None = None
        self.known: tuple[int, list[str], np.ndarray] | None = None

    def lattice(self, k: int) -> tuple[Lattice, np.ndarray]:
        """The lattice of stretch ``k`` and, for each of its chunks, the shift from nodes to places.

        The last one asked for is held."""
        if self.held is None or self.held[0] != k:
            self.held = None
            self.held = k, *self._lattice(k)
        return self.held[1:]

    def _kinds(self, k: int) -> tuple[list[str], np.ndarray]:
        """The distinct chunks of stretch ``k``, and which each of its chunks is; the last ones asked for are held."""
        if self.known is None or self.known[0] != k:
            words = self.words[self.first[k] : self.first[k + 1]]
            known = {w: i for i, w in enumerate(dict.fromkeys(words))}
            self.known = k, list(known), np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return self.known[1:]

    def encoded(self) -> list[np.ndarray]:
        """The tokenizer's own ids of every text, joined from those of its chunks."""
        parts, counts = [], []
        for k in range(len(self.cuts) - 1):
            known, kind = self._kinds(k)
            ids = self.v.encode(known)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(size.sum()))
            number, start = size[kind], (np.cumsum(size) - size)[kind]
            ends = np.cumsum(number)
            parts.append(flat[np.repeat(start - ends + number, number) + np.arange(number.sum())])
            counts.append(number)
        total = np.bincount(self.owner, np.concatenate(counts), len(self.size)).astype(np.int64)
        return np.split(np.concatenate(parts), np.cumsum(total)[:-1])

    def _lattice(self, k: int) -> tuple[Lattice, np.ndarray]:
        known, kind = self._kinds(k)
        ends = np.cumsum(np.fromiter(map(len, known), np.int64, len(known)))
        size = np.diff(ends, prepend=0)
        codes = np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), np.uint32)
        lattice = Lattice(self.v, codes, np.repeat(ends, size) - np.arange(len(codes)))
        return lattice, self.chunk[self.first[k] : self.first[k + 1]] - (ends - size)[kind]

    def path(self, docs: np.ndarray, at: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, place, piece, share) of a path from place ``at`` to the end of each of ``docs``."""
        start_of = np.full(len(self.size), 1 << 62, np.int64)
        start_of[docs] = at
        parts = []
        for k, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            begin, owner = (x[self.first[k] : self.first[k + 1]] for x in (self.chunk, self.owner))
            whole = np.flatnonzero(begin >= start_of[owner])
            inside = at[(at > a) & (at < b)]
            within = np.searchsorted(begin, inside, "right") - 1
            middle = begin[within] != inside
            inside, within = inside[middle], within[middle]
            if not len(whole) and not len(inside):
                continue
            lat, shift = self.lattice(k)
            places, own = np.concatenate((begin[whole], inside)), np.concatenate((whole, within))
            # Places count from the front of their text in its stream.
            streams = (stream(self.keys, sample, 0) - self.begin.astype(np.uint64) * _B)[owner]
            place, e, own = lat.walk(places - shift[own], shift, streams, own)
            parts.append((owner[own], place, lat.piece[e], lat.p[e]))
        if not parts:
            z = np.zeros(0, np.int64)
            return z, z, z, np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def sample(self, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
        """For each text up to ``k`` (pieces, log-probability, inclusion score), best first."""
        n_docs = len(self.size)
        live = np.flatnonzero(self.size > 0)
        zero = np.zeros(len(live), np.int64)
        bound = -np.log(-np.log(uniform(self.keys[live], zero, 0, 1)))
        rounds: list[dict] = []
        open_: list[list[tuple]] = [[] for _ in range(n_docs)]  # leftovers of nodes branched at
        state = [{"doc": d, "at": int(self.begin[d]), "log": 0.0, "keep": (), "g": float(g)} for d, g in zip(live.tolist(), bound)]
        made: list[list[tuple]] = [[] for _ in range(n_docs)]
        for s in range(k + 1):
            if s:
                picks = [(d, pick) for d in live.tolist() if (pick := self._best(d, rounds, open_[d])) is not None]
                if s == k:  # only the values are needed, as thresholds
                    for d, pick in picks:
                        made[d].append((None, pick[0], None))
                    break
                own = np.array([d for d, _ in picks], np.int64)
                at = np.array([rounds[p[1]]["place"][p[2]] for _, p in picks], np.int64) - self.begin[own]
                draws = zip(*(uniform(self.keys[own], at, s, purpose).tolist() for purpose in (3, 4)))
                state = [self._branch(d, pick, u, rounds, open_) for (d, pick), u in zip(picks, draws)]
            if not state:
                break
            docs = np.array([x["doc"] for x in state])
            doc, place, piece, p = self.path(docs, np.array([x["at"] for x in state]), s)
            cut = np.searchsorted(doc, docs)
            until = np.searchsorted(doc, docs, "right")
            logp = np.log(np.maximum(p, 1e-300))
            run = np.concatenate(([0.0], np.cumsum(logp)))
            slot = np.repeat(np.arange(len(docs)), until - cut)
            base = np.array([x["log"] for x in state])
            before = base[slot] + run[:-1] - run[cut][slot]
            g = np.array([x["g"] for x in state])
            with np.errstate(divide="ignore"):
                rest = before + np.log(np.maximum(1 - p, 0) * (1 - p > 1e-12))
            value = _truncated(rest, g[slot], drawn(stream(self.keys[docs], s, 2)[slot], place - self.begin[docs][slot]))
            rounds.append({"cut": dict(zip(docs.tolist(), zip(cut.tolist(), until.tolist()))), "place": place, "piece": piece, "before": before, "value": value, "used": {}, "lead": {}})
            for x, a, b in zip(state, cut.tolist(), until.tolist()):
                lead = x["keep"]
                rounds[-1]["lead"][x["doc"]] = lead
                pieces = np.concatenate((*[np.asarray(y) for y in lead], piece[a:b])) if len(lead) else piece[a:b]
                made[x["doc"]].append((pieces, x["log"] + float(run[b] - run[a]), x["g"]))
        out = []
        for own in made:
            kappa = own.pop()[1] if own and own[-1][0] is None else -np.inf
            out.append([(pieces, logp, float(-np.expm1(-np.exp(min(logp - kappa, 700.0))))) for pieces, logp, _ in own])
        return out

    def _best(self, d: int, rounds: list[dict], extra: list[tuple]) -> tuple | None:
        """(value, round, index or None, leftover) of the best open set of a text."""
        best = None
        for r, x in enumerate(rounds):
            if d in x["cut"]:
                a, b = x["cut"][d]
                if b > a:
                    i = a + int(x["value"][a:b].argmax())
                    if x["value"][i] > -np.inf and (best is None or x["value"][i] > best[0]):
                        best = (float(x["value"][i]), r, i, None)
        for left in extra:
            if left[0] > -np.inf and (best is None or left[0] > best[0]):
                best = (left[0], left[1], left[2], left)
        return best

    def _branch(self, d: int, pick: tuple, u: tuple[float, float], rounds: list[dict], open_: list[list[tuple]]) -> dict:
        """Leave the node by another edge; what is still unused there stays open."""
        value, r, i, left = pick
        x = rounds[r]
        place = int(x["place"][i])
        used = left[3] if left else (int(x["piece"][i]),)
        if left:
            open_[d].remove(left)
        else:
            x["value"][i] = -np.inf
        k = bisect.bisect_right(self.cuts, place) - 1
        lat, shift = self.lattice(k)
        node = place - int(shift[int(np.searchsorted(self.chunk, place, "right")) - 1 - self.first[k]])
        low, high = int(lat.low[node]), int(lat.high[node])
        edges = [(e, p, q) for e, p, q in zip(range(low, high), lat.piece[low:high].tolist(), lat.p[low:high].tolist()) if p not in used]
        total = sum(q for _, _, q in edges)
        goal, run = u[0] * total, 0.0
        for e, piece, share in edges:
            run += share
            if run > goal:
                break
        before = float(x["before"][i])
        if len(edges) > 1:
            g = before + math.log(max(total - share, 1e-300)) - math.log(-math.log(u[1]))
            capped = min(value, g) - math.log1p(math.exp(-abs(value - g)))  # as _truncated() has it
            open_[d].append((capped, r, i, (*used, piece)))
        first = x["cut"][d][0]
        lead = (*x["lead"][d], x["piece"][first:i], np.array([piece]))
        return {"doc": d, "at": place + int(lat.size[e]), "log": before + math.log(share), "keep": lead, "g": value}


def ids_of(v: Vocabulary, text: str, pieces: np.ndarray) -> np.ndarray:
    """Ids of a path; characters without a piece become their bytes."""
    bare = np.flatnonzero(pieces < 0)
    if not len(bare):
        return pieces
    at = (np.cumsum(v.size[pieces]) - v.size[pieces])[bare].tolist()
    marked = MARK + text.replace(" ", MARK)
    own = [[v.byte_id[b] for b in marked[k].encode("utf-8", "replace")] for k in at]
    count = np.ones(len(pieces), np.int64)
    count[bare] = [len(x) for x in own]
    out = np.repeat(pieces, count)
    out[np.repeat(pieces < 0, count)] = [i for x in own for i in x]
    return out


_OUT = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("inclusion", pa.float64()), ("exact", pa.bool_())])
SCHEMA = "doc_id long, sample int, ids array<int>, log_prob double, inclusion double, exact boolean"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("log_prob", pa.float64()), ("inclusion", pa.float64()), ("exact", pa.bool_())])
DIGEST = "doc_id long, sample int, n_ids long, ids_crc32 long, log_prob double, inclusion double, exact boolean"
#: What the tokenizer's own segmentation adds to each.
_ENC, ENC = [("enc_ids", pa.list_(pa.int32())), ("enc_exact", pa.bool_())], ", enc_ids array<int>, enc_exact boolean"
_ENC_DIGEST, ENC_DIGEST = [("enc_n_ids", pa.int64()), ("enc_ids_crc32", pa.int64()), ("enc_exact", pa.bool_())], ", enc_n_ids long, enc_ids_crc32 long, enc_exact boolean"


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, path: str | None = None, alpha: float = ALPHA, seed: int = SEED, digest: bool = False, encoded: bool = False) -> DataFrame:
    """Up to ``k`` distinct segmentations of every row of ``docs(doc_id, text)``, best first.

    Columns: doc_id, sample, ids (or n_ids and ids_crc32), log_prob, inclusion, exact (the
    decoded ids give the text). A text with fewer than ``k`` segmentations gives all of them,
    with inclusion score 1; a null or empty text gives one empty segmentation; a word mark
    U+2581 in a text decodes as a space, so such a text is not exact. Rows with the same id and
    text get the same samples; a null ``doc_id`` stays null; an empty table gives no rows.
    With ``encoded`` every row also has the tokenizer's own segmentation of its text, which has no
    part in the sampling: enc_ids (or enc_n_ids and enc_ids_crc32) and enc_exact.
    """
    where = path or model_path()
    schema, shape = (_DIGEST, DIGEST) if digest else (_OUT, SCHEMA)
    if encoded:
        schema, shape = pa.schema([*schema, *(_ENC_DIGEST if digest else _ENC)]), shape + (ENC_DIGEST if digest else ENC)

    def shown(ids: np.ndarray) -> tuple:
        return (len(ids), zlib.crc32(ids.astype("<u4").tobytes())) if digest else (ids.tolist(),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, out = vocabulary(where, alpha), Writer(schema, rows=2000)
        held: list[tuple] = []
        size = 0

        def settle() -> None:
            texts = [h[1] for h in held]
            group, best = Group(v, texts, [h[2] for h in held]), [None] * len(held)
            if encoded:
                best = group.encoded() if v.apart else [np.array(x, np.int64) for x in v.sp.encode(texts, num_threads=1)]
            for (doc, text, _), own, enc in zip(held, group.sample(k), best):
                data = text.encode("utf-8", "replace")
                more = (*shown(enc), v.decode(enc.tolist()) == data) if encoded else ()
                for s, (pieces, logp, q) in enumerate(own or [(np.zeros(0, np.int64), 0.0, 1.0)]):
                    ids = ids_of(v, text, pieces)
                    out.add(doc, s, *shown(ids), logp, q, v.decode(ids.tolist()) == data, *more)

        for batch in batches:
            for doc, data, key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "data", "key"))):
                text = data.decode("utf-8", "replace")
                held.append((doc, text, key))
                size += len(text) + 1
                if size >= SEGMENT // 2 or len(held) >= 500:
                    settle()
                    held, size = [], 0
                    yield out.flush()
        if held:
            settle()
            yield out.flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data"))
    return rows.withColumn("key", F.xxhash64("doc_id", F.lit(seed))).mapInArrow(run, shape)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids)``: the tokenizer's own segmentation of ``docs(doc_id, text)``."""
    where = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(where)
        for batch in batches:
            texts = [b.decode("utf-8", "replace") for b in batch.column("data").to_pylist()]
            ids = pa.array(v.sp.encode(texts, num_threads=1), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of ``rows(doc_id, ids)``; null ids give an empty text."""
    where = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(where)
        for batch in batches:
            texts = pa.array([v.decode(i or []).decode("utf-8", "replace") for i in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
