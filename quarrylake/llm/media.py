"""Copies among images by local descriptors: cropped, brightened, blurred or rotated ones too.

Corners (Harris maxima at several scales) get an orientation from the intensity centroid and a
128-bit descriptor of brightness comparisons turned by it. Images are dealt into groups by id, and
a task for every two groups compares their descriptors: all pairs within ``MAX_BITS`` = 7 bits
are matches, found by counts of set bits that bound the distance from below; equal descriptors
are compared once. Matches of two images agree if enough of them imply one similarity transform
(turn, scale and shift); agreeing images link, and components of the links whose transform makes the images alike are the groups
of copies. Matches and links never leave their task, which counts the links of each image and
keeps one way to the least image that it is joined with.
Equal images are described once.
"""

from __future__ import annotations

import hashlib
import itertools
import logging
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Writer
from .components import components

RADIUS, BITS, TURNS, WORDS = 8, 128, 30, 4
MAX_BITS, MIN_MATCHES, SHIFT = 7, 5, 4.0
#: Bits in which half of the corners that a link puts on each other may differ (measured: copies at
#: most 19, unrelated pictures on one grid at least 28), and the least share of the common part's corners
#: that agree (resized copies 0.58 or more, unrelated large pictures at most 0.05).
ALIKE, SHARE = 24, 1 / 16
#: Corners of a group of images, of the images of a group that are compared at a time, and matches held at a time.
GROUP, ROWS, HELD = 200_000, 50_000, 60_000_000
#: Matches whose turns are counted at a time, and those left that wait to be judged together.
VOTES, WAITING = 30_000, 1_000_000
#: Groups at least, so that there are tasks for all cores.
LEAST_GROUPS = 8
#: Turns are counted in steps, and their differences in sectors. An arc has the steps within which the differences
#: lie that agree with one of them (by 4 * pi / TURNS), and what rounding adds; it meets ``MEET`` sectors at most.
STEPS, SECTORS = 700, 14
ARC = 4 * STEPS // TURNS + 3
MEET = (ARC - 1) // (STEPS // SECTORS) + 2
_sector = np.arange(2 * STEPS) % STEPS // (STEPS // SECTORS)
#: Steps of at most 1.5 between scales, so that copies resized by 1.5, 2 or 3 share descriptors.
SCALES = (1, 1.5, 2, 3)
#: Corners count from this share of an image's strongest.
STRENGTH = 0.02
_rng = np.random.default_rng(128)
_tests = np.clip(_rng.normal(0, RADIUS / 2.2, (BITS, 4)), -RADIUS * 0.7, RADIUS * 0.7)
_angles = 2 * np.pi * np.arange(TURNS) / TURNS
_turned = np.rint(
    np.stack([_tests[None, :, 0] * np.cos(_angles)[:, None] - _tests[None, :, 1] * np.sin(_angles)[:, None], _tests[None, :, 0] * np.sin(_angles)[:, None] + _tests[None, :, 1] * np.cos(_angles)[:, None]]
    + [_tests[None, :, 2] * np.cos(_angles)[:, None] - _tests[None, :, 3] * np.sin(_angles)[:, None], _tests[None, :, 2] * np.sin(_angles)[:, None] + _tests[None, :, 3] * np.cos(_angles)[:, None]])
).astype(np.int64)  # (x1, y1, x2, y2) by turn and test
_dy, _dx = (g.ravel() for g in np.mgrid[-7:8, -7:8])
_disk = _dx**2 + _dy**2 <= 49
_dy, _dx = _dy[_disk], _dx[_disk]


def pgm(image: np.ndarray) -> bytes:
    """A grey image as binary PGM."""
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


_HEAD = re.compile(rb"(P[56])((?:\s|#[^\n\r]*[\n\r])+)(\d+)((?:\s|#[^\n\r]*[\n\r])+)(\d+)((?:\s|#[^\n\r]*[\n\r])+)(\d+)\s")


def parse(data: bytes | None) -> np.ndarray | None:
    """The grey image of a binary PGM or PPM, whose header may have comments; None for anything
    else. Samples count from 0 to 255 whatever the header's maximum; what follows the image is ignored."""
    head = _HEAD.match(data or b"")
    if not head:
        return None
    colours = 3 if head[1] == b"P6" else 1
    width, height, top = (int(head[k]) for k in (3, 5, 7))
    kind = np.dtype("u1" if top < 256 else ">u2")
    number = width * height * colours
    if not number or not 0 < top < 65536 or len(data) - head.end() < number * kind.itemsize:
        return None
    image = np.frombuffer(data, kind, number, head.end()).reshape(height, width, colours)
    if colours == 1 and top == 255:
        return image[:, :, 0]
    grey = image @ np.array([0.299, 0.587, 0.114]) if colours == 3 else image[:, :, 0].astype(np.float64)
    return np.rint(np.minimum(grey * (255 / top), 255)).astype(np.uint8)


def _shrink(n: int, scale: float) -> np.ndarray:
    """The matrix that averages ``n`` pixels over stretches of ``scale``."""
    at = np.arange(int(n / scale))[:, None] * scale
    x = np.arange(n)[None, :]
    return np.clip(np.minimum(x + 1, at + scale) - np.maximum(x, at), 0, None) / scale


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r+1) squares of a stack of images, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis)
        n = x.shape[axis]
        x = np.take(c, np.arange(2 * r + 1, 2 * r + 1 + n), axis) - np.take(c, np.arange(n), axis)
    return x


def describe(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(image, places, descriptors)`` of a stack of equally large grey images; places are
    (x, y, turn in radians, scale) in pixels of the original."""
    images, places, words = [], [], []
    base = stack.astype(np.float64)
    for scale in SCALES:
        h, w = int(base.shape[1] / scale), int(base.shape[2] / scale)
        if h <= 2 * RADIUS + 2 or w <= 2 * RADIUS + 2:
            continue
        if scale == int(scale):
            scale = int(scale)
            img = base[:, : h * scale, : w * scale].reshape(len(base), h, scale, w, scale).mean(axis=(2, 4))
        else:
            img = _shrink(base.shape[1], scale) @ base @ _shrink(base.shape[2], scale).T
        soft = _box(img, 1) / 9
        gy, gx = np.gradient(soft, axis=(1, 2))
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        top = r.copy()
        for axis in (1, 2):
            rolled = [np.roll(top, k, axis) for k in range(-3, 4)]
            top = np.maximum.reduce(rolled)
        m = RADIUS + 1
        peak = (r == top) & (r > STRENGTH * r.max(axis=(1, 2), keepdims=True)) & (r > 1e-6)
        peak[:, :m] = peak[:, -m:] = peak[:, :, :m] = peak[:, :, -m:] = False
        k, y, x = np.nonzero(peak)
        if not len(k):
            continue
        patch = img[k[:, None], y[:, None] + _dy, x[:, None] + _dx]
        turn = np.arctan2((patch * _dy).sum(axis=1), (patch * _dx).sum(axis=1))
        t = np.rint(turn / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
        x1, y1, x2, y2 = (_turned[i][t] for i in range(4))
        soft = _box(img, 2) / 25
        bits = soft[k[:, None], y[:, None] + y1, x[:, None] + x1] < soft[k[:, None], y[:, None] + y2, x[:, None] + x2]
        images.append(k)
        places.append(np.stack([(x + 0.5) * scale, (y + 0.5) * scale, turn, np.full(len(k), float(scale))], axis=1))
        words.append(np.packbits(bits, axis=1).view(">u4").astype(np.int64))
    if not images:
        return np.zeros(0, np.int64), np.zeros((0, 4)), np.zeros((0, WORDS), np.int64)
    return np.concatenate(images), np.concatenate(places), np.concatenate(words)


_KEY = pa.schema([("media_id", pa.int64()), ("sha", pa.binary()), ("known", pa.bool_()), ("n_corners", pa.int64()), ("place", pa.list_(pa.float32())), ("word", pa.list_(pa.int64()))])


def _keypoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, data = batch.column("media_id").to_pylist(), batch.column("image").to_pylist()
        for at in range(0, len(ids), 128):
            part = [(i, d, parse(d)) for i, d in zip(ids[at : at + 128], data[at : at + 128])]
            rows = {k: (np.zeros((0, 4)), np.zeros((0, WORDS), np.int64)) for k in range(len(part))}
            for shape in {p.shape for _, _, p in part if p is not None}:
                own = [k for k, (_, _, p) in enumerate(part) if p is not None and p.shape == shape]
                image, place, word = describe(np.stack([part[k][2] for k in own]))
                order = np.argsort(image, kind="stable")
                cut = np.searchsorted(image[order], np.arange(len(own) + 1))
                for k, a, b in zip(own, cut[:-1], cut[1:]):
                    rows[k] = place[order[a:b]], word[order[a:b]]
            out = Writer(_KEY)
            for k, (i, d, p) in enumerate(part):
                out.add(i, None if d is None else hashlib.sha256(d).digest(), p is not None, len(rows[k][0]), rows[k][0].astype(np.float32).ravel().tolist(), rows[k][1].ravel().tolist())
            yield out.flush()


_MATCH = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("pa", pa.list_(pa.float32())), ("pb", pa.list_(pa.float32()))])


def _view(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A flip and two masks of bits for ``_near``, along the main directions of descriptors ``d``.

    They only decide how much is compared, never what is found."""
    bits = np.unpackbits(d[:: len(d) // 4096 + 1].view(np.uint8), axis=1).astype(float)
    bits -= bits.mean(axis=0)
    values, vectors = np.linalg.eigh(bits.T @ bits)
    some, views = d[:: len(d) // 500 + 1], []
    for turn in np.arange(6) * np.pi / 12:
        load = vectors[:, -2:] * np.sqrt(np.maximum(values[-2:], 0)) @ [[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]]
        own = abs(load).argmax(axis=1)
        views.append(tuple(np.packbits(x).view(np.uint64) for x in (load[np.arange(BITS), own] < 0, own == 1, own == 0)))
    bits = [[np.bitwise_count((some ^ v[0]) & mask).sum(axis=1, dtype=np.int16) for mask in v[1:]] for v in views]
    near = [(abs(x[:, None] - x) + abs(y[:, None] - y) <= MAX_BITS).sum() for x, y in bits]
    return views[int(np.argmin(near))]


def _near(a: np.ndarray, b: np.ndarray, view: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``a`` and ``b`` of all pairs of descriptors within ``MAX_BITS``, part by part.

    The numbers of set bits under two masks that share no bit differ, taken together, by no more
    than the descriptors do; so the rows of ``b`` are sorted by both numbers and only those near enough compared."""
    (a1, a2), (b1, b2) = ([np.bitwise_count((x ^ view[0]) & mask).sum(axis=1, dtype=np.int64) for mask in view[1:]] for x in (a, b))
    order, rows = np.argsort(b1 << 8 | b2, kind="stable"), np.argsort(a1 << 8 | a2, kind="stable")
    key, cell = (b1 << 8 | b2)[order], (a1 << 8 | a2)[rows]
    left, right = ([np.ascontiguousarray(x[k, c]) for c in (0, 1)] for x, k in ((a, rows), (b, order)))
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    step = np.arange(-MAX_BITS, MAX_BITS + 1)
    room = MAX_BITS - abs(step)
    one, two = (cell[first] >> 8)[:, None] + step, (cell[first] & 255)[:, None]
    low = np.searchsorted(key, one * 256 + np.maximum(two - room, 0)).tolist()
    high = np.searchsorted(key, one * 256 + two + room, "right").tolist()
    for start, end, lows, highs in zip(first.tolist(), [*first[1:].tolist(), len(rows)], low, high):
        spans = [slice(x, y) for x, y in zip(lows, highs) if x < y]
        if not spans:
            continue
        x, y, at = (np.concatenate([v[s] for s in spans]) for v in (*right, order))
        size = max(1, 65_536 // len(at))
        for k in range(start, end, size):
            own = slice(k, min(k + size, end))
            far = np.bitwise_count(left[0][own, None] ^ x)
            far += np.bitwise_count(left[1][own, None] ^ y)
            found = np.flatnonzero(far <= MAX_BITS)
            if len(found):
                i = np.repeat(np.arange(len(far)), np.diff(np.searchsorted(found, np.arange(len(far) + 1) * len(at))))
                yield rows[k + i], at[found - i * len(at)]


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every match of rows of a bucket (t, w) whose images differ, the lesser id as ``a``; rows come
    sorted by table, word and id."""
    rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["t"], r["w"], r["id"]))
    out = Writer(_MATCH)
    for _, bucket in itertools.groupby(rows, key=lambda r: (r["t"], r["w"])):
        own = list(bucket)
        d = np.array([[r["d1"], r["d2"]] for r in own], np.int64).view(np.uint64)
        for i, j in (x for part in _near(d, d, _view(d)) for x in zip(*(y.tolist() for y in part))):
            if own[i]["id"] < own[j]["id"] and out.add(own[i]["id"], own[j]["id"], own[i]["p"], own[j]["p"]):
                yield out.flush()
    if len(out):
        yield out.flush()


def consensus(a: np.ndarray, b: np.ndarray) -> int:
    """Most matches of places ``a`` with ``b`` (n x 4) that one similarity transform explains."""
    return _consensus(a, b)[0]


def _consensus(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Most matches that agree, and one whose transform explains them."""
    best = which = 0
    turn = b[:, 2] - a[:, 2]
    ratio = b[:, 3] / a[:, 3]
    cos, sin = ratio * np.cos(turn), ratio * np.sin(turn)
    tx = b[:, 0] - cos * a[:, 0] + sin * a[:, 1]
    ty = b[:, 1] - sin * a[:, 0] - cos * a[:, 1]
    for k in range(len(a)):
        if len(a) - k <= best and best >= MIN_MATCHES:
            break
        x = cos[k] * a[:, 0] - sin[k] * a[:, 1] + tx[k]
        y = sin[k] * a[:, 0] + cos[k] * a[:, 1] + ty[k]
        good = (abs(x - b[:, 0]) <= SHIFT * b[:, 3]) & (abs(y - b[:, 1]) <= SHIFT * b[:, 3])
        good &= (abs((turn - turn[k] + np.pi) % (2 * np.pi) - np.pi) <= 4 * np.pi / TURNS) & (abs(np.log(ratio / ratio[k])) < 0.42)
        if good.sum() > best and (n := _corners(a[good], b[good])) > best:
            best, which = n, k
    return best, which


def _corners(a: np.ndarray, b: np.ndarray) -> int:
    """Matches of different corners: one that is found at several scales, in either image, counts once."""
    left = np.lexsort((b[:, 1], b[:, 0], b[:, 3]))
    n = 0
    while len(left):
        k, n = left[0], n + 1
        far = lambda x: (abs(x[left, :2] - x[k, :2]) > SHIFT * np.maximum(x[left, 3:], x[k, 3])).any(axis=1)
        left = left[far(a) & far(b)]
    return n


class Side:
    """Images of a group in order of id, with their corners one after another."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, place: np.ndarray, d: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ends = np.cumsum(sizes)
        corners = np.concatenate([np.arange(ends[k] - sizes[k], ends[k]) for k in order]) if len(order) else np.zeros(0, np.int64)
        self.ids, self.place, self.d = ids[order], place[corners], d[corners]
        self.image = np.repeat(np.arange(len(order)), sizes[order])
        self.step = np.floor(self.place[:, 2] * (STEPS / (2 * np.pi))).astype(np.int64) % STEPS
        self.lines = *(np.ascontiguousarray(self.place[:, k]) for k in (0, 1, 3)), np.cos(self.place[:, 2]), np.sin(self.place[:, 2])
        self.cut = np.concatenate(([0], np.cumsum(sizes[order])))
        self.told: tuple = None, None  # what _distinct gives for some of the images

    def __len__(self) -> int:
        return len(self.ids)


def _implied(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Turn, logarithm of the scale, and the transform (cos, sin, tx, ty) that each match implies."""
    turn, ratio = b[..., 2] - a[..., 2], b[..., 3] / a[..., 3]
    cos, sin = ratio * np.cos(turn), ratio * np.sin(turn)
    return turn, np.log(ratio), cos, sin, b[..., 0] - cos * a[..., 0] + sin * a[..., 1], b[..., 1] - sin * a[..., 0] - cos * a[..., 1]


def _along(left: Side, i: np.ndarray, right: Side, j: np.ndarray) -> np.ndarray:
    """Of n pairs of images with m matches each (corners ``i`` and ``j``, m x n): whether ``MIN_MATCHES`` may agree
    by where their transforms put corners on one axis; most of the pairs that can't link end here."""
    (ax, ay, a_size, a_cos, a_sin), (bx, _, b_size, b_cos, b_sin) = ([x.take(k) for x in side.lines] for side, k in ((left, i), (right, j)))
    ratio = b_size / a_size
    cos, sin = ratio * (b_cos * a_cos + b_sin * a_sin), ratio * (b_sin * a_cos - b_cos * a_sin)
    tx, reach = bx - cos * ax + sin * ay, SHIFT * b_size + 1e-6
    out = np.zeros(i.shape[1], bool)
    for k in range(len(i)):
        off = cos[k] * ax
        off -= sin[k] * ay
        off += tx[k]
        off -= bx
        out |= (np.abs(off, out=off) <= reach).sum(axis=0, dtype=np.int16) >= MIN_MATCHES
    return out


def _enough(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n pairs of images with m matches each (n x m x 4): whether ``MIN_MATCHES`` may agree.

    As in ``consensus``, but for a little slack and with every match counted."""
    turn, ratio, cos, sin, tx, ty = (x[:, :, None] for x in _implied(a, b))
    ax, ay, bx, by, reach = (x[:, None, :] for x in (a[..., 0], a[..., 1], b[..., 0], b[..., 1], SHIFT * b[..., 3] + 1e-6))
    good = abs(cos * ax - sin * ay + tx - bx) <= reach
    good &= abs(sin * ax + cos * ay + ty - by) <= reach
    good &= abs((turn.swapaxes(1, 2) - turn + np.pi) % (2 * np.pi) - np.pi) <= 4 * np.pi / TURNS + 1e-6
    good &= abs(ratio.swapaxes(1, 2) - ratio) < 0.42 + 1e-6
    return (good.sum(axis=2) >= MIN_MATCHES).any(axis=1)


def _agreed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_consensus`` of n pairs of images at a time, each with m matches that all differ (n x m x 4)."""
    n, m = a.shape[:2]
    turn, _, cos, sin, tx, ty = (x[:, :, None] for x in _implied(a, b))
    ratio = (b[..., 3] / a[..., 3])[:, :, None]
    (ax, ay, a_size), (bx, by, b_size) = ([x[:, None, :, c] for c in (0, 1, 3)] for x in (a, b))
    good = abs(cos * ax - sin * ay + tx - bx) <= SHIFT * b_size
    good &= abs(sin * ax + cos * ay + ty - by) <= SHIFT * b_size
    good &= abs((turn.swapaxes(1, 2) - turn + np.pi) % (2 * np.pi) - np.pi) <= 4 * np.pi / TURNS
    good &= abs(np.log(ratio.swapaxes(1, 2) / ratio)) < 0.42
    number = good.sum(axis=2)
    # Matches that count once, and their order, as in _corners.
    once = np.zeros((n, m, m), bool)
    for x, y, size in ((ax, ay, a_size), (bx, by, b_size)):
        reach = SHIFT * np.maximum(size, size.swapaxes(1, 2))
        once |= (abs(x - x.swapaxes(1, 2)) <= reach) & (abs(y - y.swapaxes(1, 2)) <= reach)
    order = np.lexsort((b[..., 1], b[..., 0], b[..., 3]), axis=-1)
    best, which, start = (np.zeros(n, np.int64) for _ in range(3))
    live, k = np.arange(n), np.arange(m)
    while True:
        top = best[live, None]
        can = (k >= start[live, None]) & (number[live] > top) & ((m - k > top) | (top < MIN_MATCHES))
        more = can.any(axis=1)
        live, at = live[more], can[more].argmax(axis=1)
        if not len(live):
            return best, which
        left, found, rows = good[live, at], np.zeros(len(live), np.int64), np.arange(len(live))
        for step in range(m):
            own = order[live, step]
            here = left[rows, own]
            found += here
            left &= ~(once[live, own] & here[:, None])
        better = found > best[live]
        best[live[better]], which[live[better]] = found[better], at[better]
        start[live] = at + 1


def _all_alike(left: Side, x: np.ndarray, right: Side, y: np.ndarray, a: np.ndarray, b: np.ndarray, number: np.ndarray) -> np.ndarray:
    """``_alike`` of n pairs of images at a time."""
    size, other = left.cut[x + 1] - left.cut[x], right.cut[y + 1] - right.cut[y]
    out, room = np.zeros(len(x), bool), int(size.max()) * int(other.max())
    if room > 100_000:
        for k in range(len(x)):
            out[k] = _alike(left, int(x[k]), right, int(y[k]), a[k], b[k], int(number[k]))
        return out
    if len(x) > (n := max(1, 500_000 // room)):
        return np.concatenate([_all_alike(left, x[k : k + n], right, y[k : k + n], a[k : k + n], b[k : k + n], number[k : k + n]) for k in range(0, len(x), n)])
    # Places past an image's last corner hold a corner of no weight.
    mine, theirs = np.arange(size.max()) < size[:, None], np.arange(other.max()) < other[:, None]
    own, at = (np.where(there, first[:, None] + np.arange(there.shape[1]), first[:, None]) for there, first in ((mine, left.cut[x]), (theirs, right.cut[y])))
    p, to = left.place[own], right.place[at]
    _, ratio, cos, sin, tx, ty = (v[:, None] for v in _implied(a, b))
    u, v, grown = to[..., 0] - tx, to[..., 1] - ty, np.exp(2 * ratio)[..., None]
    there = np.stack((cos * p[..., 0] - sin * p[..., 1] + tx, sin * p[..., 0] + cos * p[..., 1] + ty), axis=2)
    back = np.stack((cos * u + sin * v, cos * v - sin * u), axis=2) / grown
    inside = lambda x, y: ((x >= y[..., :2].min(axis=1, keepdims=True)) & (x <= y[..., :2].max(axis=1, keepdims=True))).all(axis=2)
    common = np.minimum((inside(there, to) & mine).sum(axis=1), (inside(back, p) & theirs).sum(axis=1))
    near = abs(there[:, :, None, 0] - to[:, None, :, 0]) <= SHIFT * to[:, None, :, 3]
    near &= abs(there[:, :, None, 1] - to[:, None, :, 1]) <= SHIFT * to[:, None, :, 3]
    near &= abs(np.log(to[:, None, :, 3] / p[:, :, None, 3]) - ratio[..., None]) < 0.42
    near &= mine[:, :, None] & theirs[:, None, :]
    g, i, j = np.nonzero(near)
    far = np.full(own.shape, BITS + 1)
    np.minimum.at(far, (g, i), np.bitwise_count(left.d[own[g, i]] ^ right.d[at[g, j]]).sum(axis=1, dtype=np.int64))
    far.sort(axis=1)
    found, k = (far <= BITS).sum(axis=1), np.arange(len(x))
    return (number >= SHARE * common) & (far[k, (found - 1) // 2] + far[k, found // 2] <= 2 * ALIKE)


def _alike(left: Side, x: int, right: Side, y: int, a: np.ndarray, b: np.ndarray, number: int) -> bool:
    """Whether the transform of match ``a``, ``b`` holds for image ``x`` of ``left`` and ``y`` of ``right`` beyond its matches:
    half of the corners that it puts on corners of the other image differ in at most ``ALIKE`` bits, and the ``number`` of
    matches that agree is a ``SHARE`` or more of the corners in the part that the images have in common, of the image that has fewer there."""
    mine, theirs = slice(left.cut[x], left.cut[x + 1]), slice(right.cut[y], right.cut[y + 1])
    _, ratio, cos, sin, tx, ty = _implied(a, b)
    to, d, least = right.place[theirs], right.d[theirs], []
    p, u, v = left.place[mine], to[:, 0] - tx, to[:, 1] - ty
    grown = np.exp(2 * ratio)
    there = np.stack((cos * p[:, 0] - sin * p[:, 1] + tx, sin * p[:, 0] + cos * p[:, 1] + ty), axis=1)
    back = np.stack((cos * u + sin * v, cos * v - sin * u), axis=1) / grown
    common = min(((x >= y[:, :2].min(axis=0)) & (x <= y[:, :2].max(axis=0))).all(axis=1).sum() for x, y in ((there, to), (back, p)))
    if number < SHARE * common:
        return False
    for k in range(mine.start, mine.stop, size := max(1, 500_000 // len(d))):
        p, own = left.place[k : min(k + size, mine.stop)], left.d[k : min(k + size, mine.stop)]
        near = abs((cos * p[:, 0] - sin * p[:, 1] + tx)[:, None] - to[:, 0]) <= SHIFT * to[:, 3]
        near &= abs((sin * p[:, 0] + cos * p[:, 1] + ty)[:, None] - to[:, 1]) <= SHIFT * to[:, 3]
        near &= abs(np.log(to[:, 3] / p[:, 3:]) - ratio) < 0.42
        i, j = np.nonzero(near)
        far = np.full(len(p), BITS + 1)
        np.minimum.at(far, i, np.bitwise_count(own[i] ^ d[j]).sum(axis=1, dtype=np.int64))
        least.append(far[far <= BITS])
    return bool(np.median(np.concatenate(least)) <= ALIKE)


def _all_rows(k: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rows from ``start``, as many as ``size``, of each of the numbers ``k``, one after another."""
    start, size = start.take(k), size.take(k)
    start -= np.cumsum(size, dtype=np.int32)
    start += size
    out = np.repeat(start, size)
    out += np.arange(len(out), dtype=np.int32)
    return out


def _distinct(d: np.ndarray, view: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different descriptors in the order that ``_near`` keeps, the rows of ``d`` in that order, and where each one's rows start."""
    one, two = (np.bitwise_count((d ^ view[0]) & mask).sum(axis=1, dtype=np.int64) for mask in view[1:])
    order = np.lexsort((d[:, 1], d[:, 0], one << 8 | two))
    d = d[order]
    start = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]).any(axis=1))))
    return d[start], order, np.append(start, len(d))


def _block(left: Side, right: Side, rows: tuple[int, int], cols: tuple[int, int], view: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matches (corners of ``left`` and of ``right``) of some images of ``left`` with some of ``right``, those of every pair that may
    link and of few others; halved where the matches are too many at a time.

    Each two different descriptors are compared once, however many corners have them."""
    (r0, r1), (c0, c1) = rows, cols
    at, to, wide = left.cut[r0], right.cut[c0], c1 - c0
    own, others = slice(at, left.cut[r1]), slice(to, right.cut[c1])
    if own.start == own.stop or others.start == others.stop:
        return
    mine, order, start = _distinct(left.d[own], view)
    if right.told[0] != cols:
        right.told = cols, _distinct(right.d[others], view)
    theirs, corner, first = right.told[1]
    first, parts, held = first.astype(np.int32), [], 0
    size = np.diff(first)
    # Of each of the left's descriptors: how many of the right's are near, how many corners have these, and where they are held.
    number, reached, part, low = (np.zeros(len(mine), np.int64) for _ in range(4))
    for i, j in _near(mine, theirs, view):  # in order of i, all of an i together
        these = slice(i[0], i[-1] + 1)
        number[these] = np.bincount(i - i[0])
        reached[these] = np.bincount(i - i[0], size.take(j))
        part[these], low[these] = len(parts), np.cumsum(number[these]) - number[these]
        parts.append(j.astype(np.int32))
        held += len(j)
        if held > HELD and (r1 - r0 > 1 or c1 - c0 > 1):
            del parts
            r, c = (r0 + r1) // 2, (c0 + c1) // 2
            for half in ((rows, (c0, c)), (rows, (c, c1))) if r1 - r0 == 1 else (((r0, r), cols), ((r, r1), cols)):
                yield from _block(left, right, *half, view)
            return
    if not parts:
        return
    # For each corner of the left, its descriptor and the number of its matches.
    told = np.empty(len(order), np.int64)
    told[order] = np.repeat(np.arange(len(mine)), np.diff(start))
    total = reached[told]
    # A corner's column and turn, or its row and turn, in one number; so a sum has the pair of images and the difference of turns.
    right_code = (right.image[others] - c0 << 11 | right.step[others] + STEPS)[corner].astype(np.int32 if wide + VOTES < 1 << 20 else np.int64)
    left_code = (left.image[own] - r0) * wide * 2048 - left.step[own]
    ends = np.concatenate(([0], np.cumsum(total)))
    cut = left.cut[r0 : r1 + 1] - at
    waiting, kept, r = [], 0, 0
    while r < r1 - r0:
        end = int(np.searchsorted(ends[cut], ends[cut[r]] + VOTES, "right")) - 1
        end = min(max(end, r + 1), r + max(1, VOTES // wide), r1 - r0)
        some = slice(cut[r], cut[end])
        u, many = told[some], ends[cut[end]] - ends[cut[r]]
        if many > HELD // 4 and c1 - c0 > 1:  # of one image
            for half in ((c0, (c0 + c1) // 2), ((c0 + c1) // 2, c1)):
                yield from _block(left, right, (r0 + r, r0 + end), half, view)
        elif many >= MIN_MATCHES:
            j = np.concatenate([parts[k][x : x + y] for k, x, y in zip(part[u].tolist(), low[u].tolist(), number[u].tolist())])
            j = _all_rows(j, first, size)
            code = right_code.take(j)
            code += np.repeat((left_code[some] - r * wide * 2048).astype(code.dtype), total[some])
            pair, pairs = code >> 11, (end - r) * wide
            code &= 2047
            cell = (_sector * pairs).take(code)
            cell += pair
            votes = np.bincount(cell, minlength=SECTORS * pairs)
            votes = np.minimum(votes, MIN_MATCHES, out=votes).astype(np.uint8).reshape(SECTORS, -1)
            # Matches that agree lie in as many neighbouring sectors as an arc meets.
            enough = _around(votes, np.add) >= MIN_MATCHES
            if enough.any():
                keep = np.flatnonzero(_around(enough[::-1], np.logical_or)[::-1].ravel().take(cell))
                i = np.searchsorted(ends, keep + ends[cut[r]], "right") - 1
                waiting.append((i + at, corner[j[keep]] + to, pair[keep] + r * wide))
                kept += len(keep)
        r = end
        if waiting and (kept > WAITING or r == r1 - r0):
            yield _likely(left, right, *(np.concatenate(x) for x in zip(*waiting)))
            waiting, kept = [], 0


def _around(x: np.ndarray, add: np.ufunc) -> np.ndarray:
    """Each row together with the next ones, ``MEET`` in all, the first row after the last."""
    x = np.concatenate((x, x[: MEET - 1]))
    out = x[:SECTORS]
    for k in range(1, MEET):
        out = add(out, x[k : SECTORS + k])
    return out


def _likely(left: Side, right: Side, i: np.ndarray, j: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of matches of numbered pairs of images, those of pairs that have enough corners and are likely by ``_along``."""
    if left.ids[-1] >= right.ids[0]:
        other = left.ids[left.image[i]] < right.ids[right.image[j]]
        i, j, pair = i[other], j[other], pair[other]
    if not len(i):
        return i, j
    order = np.argsort(pair * len(left.d) + i)
    i, j, pair = i[order], j[order], pair[order]
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    corners = np.add.reduceat(np.concatenate(([True], i[1:] != i[:-1])) | np.concatenate(([True], pair[1:] != pair[:-1])), first, dtype=np.int64)
    sizes = np.diff(np.append(first, len(pair)))
    first, sizes = first[corners >= MIN_MATCHES], sizes[corners >= MIN_MATCHES]
    found = []
    for m in np.unique(sizes).tolist():
        own = first[sizes == m]
        for k in range(0, len(own), n := max(1, VOTES // m)):
            some = own[k : k + n] + np.arange(m)[:, None]
            found.append(some[:, _along(left, i.take(some), right, j.take(some))].ravel())
    found = np.concatenate(found) if found else np.zeros(0, np.int64)
    return i[found], j[found]


def _judged(left: Side, right: Side, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """Links (lesser id first, and whether the images are alike) among matches that hold all of a pair's which may agree."""
    pair = left.image[i] * len(right) + right.image[j]
    order = np.argsort(pair)
    i, j, pair = i[order], j[order], pair[order]
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(pair)))
    for m in np.unique(sizes[sizes >= MIN_MATCHES]).tolist():
        own = first[sizes == m]
        for k in range(0, len(own), n := max(1, 200_000 // m**2)):
            some = own[k : k + n, None] + np.arange(m)
            a, b = left.place[i[some]], right.place[j[some]]
            ends = left.image[i[some[:, 0]]], right.image[j[some[:, 0]]]
            if m <= 400:
                some = np.flatnonzero(_enough(a, b))
                rows = np.concatenate((a[some], b[some]), axis=2)
                rows = np.take_along_axis(rows, np.lexsort(rows.transpose(2, 0, 1)[::-1], axis=-1)[:, :, None], axis=1)
                differ = (rows[:, 1:] != rows[:, :-1]).any(axis=2).all(axis=1)
                at_once, rows = some[differ], rows[differ]
                number, best = _agreed(rows[..., :4], rows[..., 4:])
                good = np.flatnonzero(number >= MIN_MATCHES)
                if len(good):
                    x, y, one = ends[0][at_once[good]], ends[1][at_once[good]], rows[good, best[good]]
                    alike = _all_alike(left, x, right, y, one[:, :4], one[:, 4:], number[good])
                    yield from zip(left.ids[x].tolist(), right.ids[y].tolist(), alike.tolist())
                some = some[~differ]
            else:
                some = np.arange(len(some))
            for x in some.tolist():
                both = np.unique(np.concatenate((a[x], b[x]), axis=1), axis=0)
                number, best = _consensus(both[:, :4], both[:, 4:])
                if number >= MIN_MATCHES:
                    alike = _alike(left, int(ends[0][x]), right, int(ends[1][x]), both[best, :4], both[best, 4:], number)
                    yield int(left.ids[ends[0][x]]), int(right.ids[ends[1][x]]), alike


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("alike", pa.bool_())])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links of a group of images with another, whose ids are greater, or with itself (``other``)."""
    ids, group, other, sizes, place, word = [], [], [], [], [], []
    for batch in batches:
        cols = [batch.column(c) for c in ("id", "g", "other", "place", "word")]
        for held, c in zip((ids, group, other), cols):
            held.append(c.to_numpy(zero_copy_only=False))
        sizes.append(np.diff(cols[3].offsets.to_numpy()) // 4)
        place.append(cols[3].flatten().to_numpy(zero_copy_only=False).reshape(-1, 4))
        word.append(cols[4].flatten().to_numpy(zero_copy_only=False).reshape(-1, 2, 2))
    if not sum(map(len, ids)):
        return
    ids, group, other, sizes, place, word = map(np.concatenate, (ids, group, other, sizes, place, word))
    d = (word[:, :, 0] << 32 | word[:, :, 1]).view(np.uint64)
    place = place.astype(float)
    del word

    def side(mine: np.ndarray) -> Side:
        corners = np.repeat(mine, sizes)
        return Side(ids[mine], sizes[mine], place[corners], d[corners])

    left, right = side(group <= other), side(group >= other)
    same, view = bool((group == other).all()), _view(d)
    out, r, waiting = Writer(_LINK), 0, []
    while r < len(left) and len(right):
        c = r if same else 0
        end = int(np.searchsorted(left.cut, left.cut[r] + (ROWS if same else 5 * ROWS), "right")) - 1
        end = min(max(end, r + 1), len(left))
        for found in _block(left, right, (r, end), (c, len(right)), view):
            waiting.append(found)
            if sum(len(x) for x, _ in waiting) > WAITING:
                for link in _judged(left, right, *(np.concatenate(x) for x in zip(*waiting))):
                    if out.add(*link):
                        yield out.flush()
                waiting = []
        r = end
    if waiting:
        for link in _judged(left, right, *(np.concatenate(x) for x in zip(*waiting))):
            if out.add(*link):
                yield out.flush()
    if len(out):
        yield out.flush()


_TALLY = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each image that has links here: how many (``n``), and the least id (``root``) that those reach
    whose images are alike. So a group of near copies gives as many rows as images, not as pairs."""
    number: dict[int, int] = {}
    above: dict[int, int] = {}

    def top(i: int) -> int:
        while (up := above.get(i, i)) != i:
            above[i] = i = above.get(up, up)
        return i

    for batch in _links(batches):
        for a, b, alike in zip(*(c.to_pylist() for c in batch.columns)):
            number[a] = number.get(a, 0) + 1
            number[b] = number.get(b, 0) + 1
            if alike and (x := top(a)) != (y := top(b)):
                above[max(x, y)] = min(x, y)
    out = Writer(_TALLY)
    for i, n in number.items():
        if out.add(i, n, top(i)):
            yield out.flush()
    if len(out):
        yield out.flush()


def image_copies(spark: SparkSession, media: DataFrame) -> DataFrame:
    """``(media_id, n_corners, n_links, copy_id)`` for every row of ``media(media_id, image)``.

    ``n_links`` counts all images whose matches with the row's image agree, that is, at least
    ``MIN_MATCHES`` of all matches within ``MAX_BITS``; ``copy_id`` is the least ``media_id``
    reachable over those of the links whose transform holds beyond these matches (``_alike``) (equal images share one). Images are binary PGM or PPM; null and
    unreadable ones have no corners and are copies only of equal bytes (nulls of none). The
    number of rows with unreadable images is logged as a warning.
    Repeated rows come back repeated; rows with a null ``media_id`` come back with a null
    ``copy_id`` unless an equal or linked image has an id; an empty table gives no rows.
    """
    scratch = Scratch(spark)
    rows = scratch.keep(media.select(F.col("media_id").cast("long").alias("media_id"), "image").mapInArrow(_keypoints, "media_id long, sha binary, known boolean, n_corners long, place array<float>, word array<long>"))
    if unread := rows.where("sha is not null and not known").count():
        logging.getLogger(__name__).warning("%d rows have images that are neither binary PGM nor PPM: only equal bytes are sought", unread)
    groups = scratch.keep(rows.where("sha is not null").groupBy("sha").agg(F.min("media_id").alias("least")).withColumn("id", F.xxhash64("sha")))
    one = rows.join(groups, (rows["sha"] == groups["sha"]) & rows["media_id"].eqNullSafe(groups["least"])).select("id", "place", "word")
    # Groups are ranges of ids, so that all ids of a lower group are less.
    one = scratch.keep(one.where(F.size("word") >= WORDS * MIN_MATCHES).dropDuplicates(["id"]))
    n = max(LEAST_GROUPS, math.ceil((one.agg(F.sum(F.size("word"))).first()[0] or 0) / WORDS / GROUP))
    one = one.withColumn("g", F.least(F.floor((F.col("id").cast("double") / 2.0**64 + 0.5) * n), F.lit(n - 1)).cast("long"))
    low, high = F.least("g", "other"), F.greatest("g", "other")
    dealt = one.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    dealt = dealt.repartitionById(n * (n + 1) // 2, (high * (high + 1) / 2 + low).cast("int"))
    links = scratch.keep(dealt.mapInArrow(_tally, "id long, n long, root long"))
    degree = links.groupBy("id").agg(F.sum("n").alias("n_links"))
    found = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    named = groups.join(found, groups["id"] == found["node"], "left").select("sha", "least", "id", F.coalesce("root", "id").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("copy_id"))
    classes = scratch.keep(named.join(roots, "root").join(degree, "id", "left").select("sha", "copy_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    joined = rows.select("media_id", "sha", "n_corners").join(classes, "sha", "left")
    none = F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    return joined.select("media_id", "n_corners", none, F.when(F.col("sha").isNull(), F.col("media_id")).otherwise(F.col("copy_id")).alias("copy_id"))


def render(vector: list[float] | None, cell: int = 8) -> bytes | None:
    """A vector as a grey image: its values, scaled to its own range, as a square of cells."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, float)
    side = int(np.ceil(np.sqrt(len(v))))
    low, high = v.min(), v.max()
    grey = np.zeros(side * side)
    grey[: len(v)] = 255 * (v - low) / (high - low) if high > low else 128
    return pgm(np.kron(grey.reshape(side, side), np.ones((cell, cell))))


def rendered(vectors: DataFrame) -> DataFrame:
    """``(media_id, image)`` of ``vectors(vec_id, embedding)``: a media column to test with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [render(v) for v in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("media_id"), pa.array(images, pa.binary())], names=["media_id", "image"])

    return vectors.select(F.col("vec_id").cast("long").alias("media_id"), "embedding").mapInArrow(run, "media_id long, image binary")
