import random

import numpy as np

from quarrylake.llm import media, segment

from .test_text import odd_rows


def picture(seed, n=96):
    rng = np.random.default_rng(seed)
    img = np.kron(rng.integers(0, 256, (n // 8, n // 8)), np.ones((8, 8)))
    for _ in range(25):
        y, x, s = rng.integers(0, n - 10), rng.integers(0, n - 10), rng.integers(3, 10)
        img[y : y + s, x : x + s] = rng.integers(0, 256)
    return img


def test_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, media.pgm(picture(i))) for i in range(40)]
    edits = {
        100: (0, picture(0)[8:, 5:]),
        101: (1, np.clip(picture(1) * 0.8 + 20, 0, 255)),
        102: (2, np.clip(picture(2) + rng.normal(0, 3, (96, 96)), 0, 255)),
        103: (3, np.rot90(picture(3))),
        104: (4, picture(4)[10:90, 10:90]),
    }
    rows += [(i, media.pgm(img)) for i, (_, img) in edits.items()]
    rows += [(200, rows[7][1]), (7, rows[7][1]), (300, None), (301, b"junk"), (302, b"junk"), (303, media.pgm(np.zeros((64, 64)))), (None, rows[9][1]), (304, media.pgm(np.zeros((3, 3))))]
    df = spark.createDataFrame([(i, d, "x") for i, d in rows], "media_id long, image binary, sha string")
    got = {}
    for r in media.image_copies(spark, df).collect():
        got.setdefault(r["media_id"], []).append(r)
    assert {i: got[i][0]["copy_id"] for i in edits} == {i: a for i, (a, _) in edits.items()}
    assert [got[i][0]["copy_id"] for i in (200, 300, 301, 302, 303, 304, None)] == [7, 300, 301, 301, 303, 304, 9]
    assert len(got[7]) == 2
    assert all(got[i][0]["copy_id"] == i for i in range(40))
    assert media.image_copies(spark, spark.createDataFrame([], df.schema)).count() == 0


EDITS = {
    "crop": lambda x, rng: x[9:90, 12:],
    "brightness": lambda x, rng: np.clip(x * 0.75 + 30, 0, 255),
    "noise": lambda x, rng: np.clip(x + rng.normal(0, 4, x.shape), 0, 255),
    "quarter turn": lambda x, rng: np.rot90(x),
    "half size": lambda x, rng: x.reshape(len(x) // 2, 2, -1, 2).mean(axis=(1, 3)),
}


def test_recall_of_edits(spark):
    """Of each kind of edit nine copies in ten at least join their picture, and no two pictures meet."""
    rng = np.random.default_rng(6)
    n, edited = 80, 20
    rows = [(i, media.pgm(picture(1000 + i, 128))) for i in range(n)]
    for k, edit in enumerate(EDITS.values(), 1):
        rows += [(1000 * k + i, media.pgm(edit(picture(1000 + i, 128), rng))) for i in range(edited)]
    got = {r["media_id"]: r["copy_id"] for r in media.image_copies(spark, spark.createDataFrame(rows, "media_id long, image binary")).collect()}
    recall = {name: sum(got[1000 * k + i] == got[i] for i in range(edited)) / edited for k, name in enumerate(EDITS, 1)}
    assert min(recall.values()) >= 0.9, recall
    assert all(got[i] == i for i in range(n))
    assert all(got[1000 * k + i] in (i, 1000 * k + i) for k in range(1, len(EDITS) + 1) for i in range(edited))


def paths(v, text):
    marked, known, out = segment.MARK + text.replace(" ", segment.MARK), {v.sp.id_to_piece(int(i)): int(i) for i in v.ids}, []

    def go(at, acc, w):
        if at == len(marked):
            out.append((tuple(acc), w))
            return
        if marked[at] not in known:
            go(at + 1, [*acc, -1], w + v.fallback)
        for end in range(at + 1, len(marked) + 1):
            if marked[at:end] in known:
                go(end, [*acc, known[marked[at:end]]], w + v.log_weight[known[marked[at:end]]])

    go(0, [], 0.0)
    total = np.logaddexp.reduce([w for _, w in out])
    return {p: float(np.exp(w - total)) for p, w in out}


def test_samples_follow_their_law():
    v = segment.vocabulary(segment.model_path())
    n = 4000
    for text in ("a cat", "the ①en", "  x"):
        law = paths(v, text)
        keys = [int(x) for x in np.random.default_rng(1).integers(0, 1 << 62, n)]
        got = segment.Group(v, [text] * n, keys).sample(2)
        first, second, total = {}, {}, 0.0
        for own in got:
            assert len({tuple(p.tolist()) for p, _, _ in own}) == min(2, len(law))
            for p, logp, q in own:
                assert abs(np.exp(logp) - law[tuple(p.tolist())]) < 1e-9
                total += np.exp(logp) / q
            a, b = (tuple(x[0].tolist()) for x in own)
            first[a] = first.get(a, 0) + 1
            second[b] = second.get(b, 0) + 1
        assert all(abs(first.get(p, 0) / n - x) < 0.03 for p, x in law.items())
        assert all(abs(second.get(p, 0) / n - sum(law[a] * x / (1 - law[a]) for a in law if a != p)) < 0.03 for p, x in law.items())
        assert abs(total / n - 1) < 0.05  # inclusion scores make the estimate of a total unbiased


def test_all_segmentations_of_a_small_text():
    v = segment.vocabulary(segment.model_path())
    law = paths(v, "a cat")
    own = segment.Group(v, ["a cat"], [5]).sample(100)[0]
    assert {tuple(p.tolist()) for p, _, _ in own} == set(law)
    assert all(q == 1 for _, _, q in own)


def test_segments_do_not_matter(monkeypatch):
    v = segment.vocabulary(segment.model_path())
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdeé🙂") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(5)]
    whole = segment.Group(v, texts, list(range(5))).sample(3)
    monkeypatch.setattr(segment, "SEGMENT", 50)
    for i, t in enumerate(texts):
        own = segment.Group(v, [t], [i]).sample(3)[0]
        assert [(p.tolist(), round(q, 9)) for p, _, q in own] == [(p.tolist(), round(q, 9)) for p, _, q in whole[i]]


def test_query_and_round_trip(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, key int")
    got = segment.sample_segmentations(df, k=3).collect()
    v = segment.vocabulary(segment.model_path())
    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add(t or "")
    for r in got:
        assert r["exact"] and v.decode(r["ids"]).decode() in texts[r["doc_id"]]
        assert v.sp.decode(r["ids"]) in texts[r["doc_id"]]
        assert 0 < r["inclusion"] <= 1
    assert {r["doc_id"] for r in got} == set(texts)
    back = segment.decode(segment.encode(df)).collect()
    assert all(r["text"] in texts[r["doc_id"]] for r in back) and len(back) == len(rows)
    assert segment.sample_segmentations(df.limit(0)).count() == 0


def test_headers_and_resized_copies(spark, caplog):
    img = picture(0).astype(np.uint8)
    want = media.parse(media.pgm(img))
    body, colour = img.tobytes(), np.repeat(img[:, :, None], 3, axis=2).tobytes()
    assert (media.parse(b"P5\n96 96\n255\n" + body) == want).all()
    assert (media.parse(b"P5 # by hand\n# 1 2 3\n96\t96 # wide\n255\n" + body) == want).all()
    assert (media.parse(b"P6\n96 96\n255\n" + colour) == want).all()
    assert (media.parse(b"P5\n96 96\n65535\n" + (img.astype(">u2") * 257).tobytes()) == want).all()
    for bad in (None, b"P5\n96 96\n255\n" + body[1:], b"P5\n0 0\n255\n", b"P4\n8 8\n" + body, b"\x89PNG\r\n\x1a\n"):
        assert media.parse(bad) is None

    def larger(img, by):
        at = (np.arange(int(len(img) * by)) + 0.5) / by - 0.5
        low = np.clip(np.floor(at).astype(int), 0, len(img) - 2)
        part = np.clip(at - low, 0, 1)
        up = lambda x: x[low] * (1 - part)[:, None] + x[low + 1] * part[:, None]
        return up(up(img).T).T

    rows = [(i, media.pgm(picture(i))) for i in range(12)]
    rows += [(100 + i, b"P5\n# larger\n%d %d\n255\n" % (x := larger(picture(i), 1.5 if i % 2 else 3)).shape + np.rint(x).astype(np.uint8).tobytes()) for i in range(12)]
    df = spark.createDataFrame(rows + [(300, b"GIF89a"), (301, None)], "media_id long, image binary")
    got = {r["media_id"]: r["copy_id"] for r in media.image_copies(spark, df).collect()}
    assert got == {i: i % 100 for i in [*range(12), *range(100, 112)]} | {300: 300, 301: 301}
    assert "1 rows have images" in caplog.text


def test_tables_cover_the_radius(spark, monkeypatch):
    """Descriptors that differ in MAX_BITS bits, spread over all words, are found by their images."""
    rng = np.random.default_rng(4)
    words = rng.integers(0, 256, (6, 16), dtype=np.uint8)
    place = np.stack([rng.uniform(10, 90, 6), rng.uniform(10, 90, 6), np.zeros(6), np.ones(6)], axis=1)

    def drawn(batches):
        for batch in batches:
            out = media.Writer(media._KEY)
            for i in batch.column("media_id").to_pylist():
                own = words.copy()
                own[:, 0 : 2 * media.MAX_BITS * i : 2] ^= 1
                out.add(i, b"%d" % i, True, 6, place.ravel().tolist(), own.view(">u4").astype(np.int64).ravel().tolist())
            yield out.flush()

    monkeypatch.setattr(media, "_keypoints", drawn)
    df = spark.createDataFrame([(0, b""), (1, b"")], "media_id long, image binary").coalesce(1)
    got = {(r["media_id"], r["n_links"], r["copy_id"]) for r in media.image_copies(spark, df).collect()}
    assert got == {(0, 1, 0), (1, 1, 0)}


def test_own_image_does_not_hide_others():
    """A descriptor near one of its own image still leads those of others."""
    import pyarrow as pa

    def word(bits):
        return (1 << bits) - 1

    place = [[float(k), 0.0, 0.0, 1.0] for k in range(3)]
    batch = pa.record_batch([[0] * 3, [0] * 3, [1, 1, 2], [word(0), word(5), word(10)], [0] * 3, place], names=["t", "w", "id", "d1", "d2", "p"])
    got = [x for b in media._leaders(iter([batch])) for x in b.to_pylist()]
    assert [(x["a"], x["b"], x["pa"]) for x in got] == [(1, 2, place[1])]


def test_exact_is_told_by_decoding(spark, monkeypatch):
    """A fault in the ids shows in the column exact."""
    true = segment.ids_of
    monkeypatch.setattr(segment, "ids_of", lambda v, text, pieces: true(v, text, pieces)[:-1])
    run = {}

    class Frame:
        def __getattr__(self, name):
            return lambda *a, **k: self

        def mapInArrow(self, f, schema):
            run["f"] = f
            return self

    segment.sample_segmentations(Frame())
    import pyarrow as pa

    batch = pa.record_batch([[1, 2], [b"the cat \xe2\x91\xa0", b""], [5, 6]], names=["doc_id", "data", "key"])
    got = [(x["doc_id"], x["exact"]) for b in run["f"](iter([batch])) for x in b.to_pylist()]
    assert got == [(1, False), (1, False), (2, True)]


def brute_links(images):
    """Links of ``{id: image}`` by comparing every descriptor with every other; ids by hash as in image_copies()."""
    from pyspark.sql import functions as F

    told = {}
    for i, x in images.items():
        _, place, word = media.describe(media.parse(media.pgm(x))[None])
        told[i] = place.astype(np.float32).astype(float), (word[:, ::2] << 32 | word[:, 1::2]).view(np.uint64)
    import hashlib

    from pyspark.sql import SparkSession

    rows = SparkSession.getActiveSession().createDataFrame([(i, bytearray(hashlib.sha256(media.pgm(x)).digest())) for i, x in images.items()], "i long, sha binary")
    key = {r["i"]: r["h"] for r in rows.select("i", F.xxhash64("sha").alias("h")).collect()}
    links, by_id = set(), sorted(images, key=key.get)
    for n, i in enumerate(by_id):
        for j in by_id[n + 1 :]:
            (a, da), (b, db) = told[i], told[j]
            x, y = np.nonzero(np.bitwise_count(da[:, None] ^ db[None]).sum(axis=2) <= media.MAX_BITS)
            if len(x) >= media.MIN_MATCHES:
                both = np.unique(np.concatenate((a[x], b[y]), axis=1), axis=0)
                if media.consensus(both[:, :4], both[:, 4:]) >= media.MIN_MATCHES:
                    links.add((i, j))
    return links, told, key


def pool(n, edited):
    rng = np.random.default_rng(8)
    images = {i: picture(2000 + i, 64) for i in range(n)}
    images |= {1000 * k + i: edit(picture(2000 + i, 64), rng) for k, edit in enumerate(EDITS.values(), 1) for i in range(edited)}
    return images


def test_every_link_is_found(spark):
    """Links are those of brute force, one by one; every link of two copies joins them."""
    images = pool(40, 20)
    links, _, _ = brute_links(images)
    n_links, root = dict.fromkeys(images, 0), {i: i for i in images}
    for i, j in links:
        n_links[i] += 1
        n_links[j] += 1
    for _ in images:
        for i, j in links:
            if i % 1000 == j % 1000:
                root[i] = root[j] = min(root[i], root[j])
    rows = [(i, media.pgm(x)) for i, x in images.items()]
    df = spark.createDataFrame(rows + rows[:3], "media_id long, image binary")
    got = {r["media_id"]: (r["n_links"], r["copy_id"]) for r in media.image_copies(spark, df).collect()}
    assert len(links) > 100
    assert got == {i: (n_links[i], root[i]) for i in images}


def test_blocks_do_not_matter(spark, monkeypatch):
    """Neither the number of rows and matches held at a time nor the view of the bits changes a link."""
    import pyarrow as pa

    images = pool(24, 12)
    links, told, key = brute_links(images)
    words = {i: [int(w) for x in d.tolist() for y in x for w in (y >> 32, y & 0xFFFFFFFF)] for i, (_, d) in told.items()}
    own = [i for i in images if len(told[i][0])]
    columns = [[key[i] for i in own], [0] * len(own), [0] * len(own), [told[i][0].ravel().tolist() for i in own], [words[i] for i in own]]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.int64()))
    batch = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "g", "other", "place", "word"])
    want = sorted((key[i], key[j]) for i, j in links)
    for rows, held in ((6_000, 8_000_000), (50, 20), (1, 0)):
        monkeypatch.setattr(media, "ROWS", rows)
        monkeypatch.setattr(media, "HELD", held)
        got = [(x["a"], x["b"]) for part in media._links(iter([batch])) for x in part.to_pylist()]
        assert sorted(got) == want
    d = np.concatenate([told[i][1] for i in own])
    all_pairs = np.argwhere(np.bitwise_count(d[:, None] ^ d[None]).sum(axis=2) <= media.MAX_BITS)
    for view in (media._view(d), media._view(d[:1]), tuple(np.random.default_rng(2).integers(0, 1 << 63, 2, dtype=np.uint64) for _ in range(1)) + (np.zeros(2, np.uint64),) * 2):
        got = np.concatenate([np.stack(x, axis=1) for x in media._near(d, d, view)])
        assert np.array_equal(got[np.lexsort((got[:, 1], got[:, 0]))], all_pairs)


def test_query_encodes_decodes_and_samples(spark, tmp_path):
    """The registered query has the tokenizer's own ids of every text, and they decode to it."""
    import zlib

    import sentencepiece

    from quarrylake.llm import queries

    rows = [*odd_rows(), (7001, "the cat ① sat"), (7002, "a▁b"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    sp = sentencepiece.SentencePieceProcessor(model_file=segment.model_path())
    want = []
    for d, t in rows:
        ids = sp.encode(t or "")
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), "▁" not in (t or "")))
    got = queries.op10_segment(spark, str(tmp_path)).collect()
    firsts = [(r["doc_id"], r["enc_n_ids"], r["enc_ids_crc32"], r["enc_exact"]) for r in got if r["sample"] == 0]
    order = lambda r: (r[0] is None, r)
    assert sorted(firsts, key=order) == sorted(want, key=order)
    whole = segment.sample_segmentations(df, encoded=True).collect()
    assert all(r["enc_ids"] == sp.encode(t or "") for d, t in rows for r in whole if r["doc_id"] == d and d in (7001, 7002))
    assert {(r["doc_id"], r["sample"], r["n_ids"]) for r in got} == {(r["doc_id"], r["sample"], len(r["ids"])) for r in whole}


def test_near_copies_give_a_row_an_image(spark, monkeypatch):
    """No table that is written grows with the pairs of a group of near copies; all its links count."""
    rng = np.random.default_rng(12)
    n, base = 24, picture(3000, 64)
    images = {i: np.clip(base + rng.normal(0, 2, base.shape), 0, 255) for i in range(n)} | {100 + i: picture(3100 + i, 64) for i in range(6)}
    links, _, _ = brute_links(images)
    assert len(links) >= n * (n - 1) // 2
    written, keep = [], media.Scratch.keep

    def counted(self, df):
        out = keep(self, df)
        written.append(out.count())
        return out

    monkeypatch.setattr(media.Scratch, "keep", counted)
    monkeypatch.setattr(media, "LEAST_GROUPS", 1)
    df = spark.createDataFrame([(i, media.pgm(x)) for i, x in images.items()], "media_id long, image binary")
    got = {r["media_id"]: (r["n_links"], r["copy_id"]) for r in media.image_copies(spark, df).collect()}
    assert max(written) <= 2 * len(images), written
    assert got == {i: (sum(i in x for x in links), 0 if i < n else i) for i in images}


def test_pairs_at_once_as_one_by_one():
    """Many pairs of images judged at once come out as each alone does."""
    rng = np.random.default_rng(13)
    for m in (5, 9, 40):
        n = 30
        a = np.stack([rng.integers(0, 30, (n, m)) * 2.0, rng.integers(0, 30, (n, m)) * 2.0, rng.normal(0, 0.3, (n, m)), rng.choice([1, 1.5, 2, 3], (n, m))], axis=2)
        b = a + np.stack([rng.normal(3, 2.5, (n, m)), rng.normal(1, 2.5, (n, m)), rng.normal(0, 0.3, (n, m)), np.zeros((n, m))], axis=2)
        b[:, : m // 3, :2] = rng.uniform(0, 60, (n, m // 3, 2))
        number, which = media._agreed(a, b)
        assert list(zip(number.tolist(), which.tolist())) == [media._consensus(x, y) for x, y in zip(a, b)]
        sizes = rng.integers(5, m + 1, n)
        own = np.concatenate([np.arange(m) < s for s in sizes])
        d = rng.integers(0, 1 << 63, (n * m, 2), dtype=np.uint64)
        near = d ^ (np.uint64(1) << rng.integers(0, 64, (n * m, 2), dtype=np.uint64)) ^ (d >> np.uint64(45)) * (rng.random((n * m, 1)) < 0.5)
        left, right = (media.Side(np.arange(n), sizes, x.reshape(-1, 4)[own], y[own]) for x, y in ((a, d), (b, near)))
        which = np.minimum(which, sizes - 1)
        one, two = (x[np.arange(n), which] for x in (a, b))
        at_once = media._all_alike(left, np.arange(n), right, np.arange(n), one, two, number)
        assert at_once.tolist() == [media._alike(left, k, right, k, one[k], two[k], int(number[k])) for k in range(n)]


def test_words_are_encoded_once(spark, monkeypatch):
    """Ids joined from those of words are the tokenizer's own ids of the text; it sees a word once."""
    v = segment.Vocabulary(segment.model_path())
    assert v.apart
    rng = random.Random(9)
    units = ["the", "cat", " ", "  ", "\n", "\t", "▁", "é", "é", "́", "①", "🙂", "a", ".", " ", "　", "​", "ﬁ", "\x00", "\x7f", "漢字", "123", "x" * 70]
    texts = ["", " ", "  ", "a ", " a", "▁", "a▁ b", *("".join(rng.choice(units) for _ in range(rng.randint(1, 40))) for _ in range(400))]
    for size in (160_000, 50):
        monkeypatch.setattr(segment, "SEGMENT", size)
        got = segment.Group(v, texts, list(range(len(texts)))).encoded()
        assert [x.tolist() for x in got] == v.sp.encode(texts)
    for known in (0, 200_000):  # as little and as much remembered
        monkeypatch.setattr(segment, "KNOWN", known)
        assert [x.tolist() for x in segment.Group(v, texts[:50], list(range(50))).encoded()] == v.sp.encode(texts[:50])

    seen = []

    class Counted:
        def __getattr__(self, name):
            return getattr(sp, name)

        def encode(self, chunks, **more):
            seen.extend(chunks)
            return sp.encode(chunks, **more)

    sp, v.sp = v.sp, Counted()
    v.coded.clear()
    monkeypatch.setattr(segment, "vocabulary", lambda *a: v)
    run = {}

    class Frame:
        def __getattr__(self, name):
            return lambda *a, **k: self

        def mapInArrow(self, f, schema):
            run["f"] = f
            return self

    segment.sample_segmentations(Frame(), encoded=True)
    import pyarrow as pa

    batch = pa.record_batch([list(range(1200)), [b"the cat sat on the mat"] * 1200, list(range(1200))], names=["doc_id", "data", "key"])
    rows = [x for b in run["f"](iter([batch])) for x in b.to_pylist()]
    assert {x["doc_id"] for x in rows} == set(range(1200)) and all(x["enc_exact"] and x["enc_ids"] == sp.encode("the cat sat on the mat") for x in rows)
    assert sorted(seen) == ["cat", "mat", "on", "sat", "the"]


def drawn_batch(images):
    """Images ``{id: (places, descriptors)}`` of one group, as ``_links`` takes them."""
    import pyarrow as pa

    words = [[int(w) for x in d.tolist() for y in x for w in (y >> 32, y & 0xFFFFFFFF)] for _, d in images.values()]
    columns = [list(images), [0] * len(images), [0] * len(images), [p.ravel().tolist() for p, _ in images.values()], words]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.int64()))
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "g", "other", "place", "word"])


def test_repeated_descriptors_are_compared_once(monkeypatch):
    """Work grows with the different descriptors, and few pairs without a link are looked at in full; all links come out."""
    rng = np.random.default_rng(21)
    kinds = rng.integers(0, 1 << 63, (30, 2), dtype=np.uint64)
    images = {}
    for i in range(120):
        place = np.stack([rng.uniform(9, 87, 12), rng.uniform(9, 87, 12), rng.uniform(-np.pi, np.pi, 12), np.ones(12)], axis=1)
        if i % 6 == 5:  # a copy, shifted
            place = images[i - 1][0] + [3, -2, 0, 0]
        images[i] = place.astype(np.float32).astype(float), images[i - 1][1] if i % 6 == 5 else kinds[rng.integers(0, 30, 12)]
    want = set()
    for i in images:
        for j in range(i + 1, 120):
            (a, da), (b, db) = images[i], images[j]
            x, y = np.nonzero(np.bitwise_count(da[:, None] ^ db[None]).sum(axis=2) <= media.MAX_BITS)
            if len(x) >= media.MIN_MATCHES and media.consensus(a[x], b[y]) >= media.MIN_MATCHES:
                want.add((i, j))
    assert want >= {(i - 1, i) for i in range(5, 120, 6)}
    near, full, compared, looked = media._near, media._enough, [], []
    monkeypatch.setattr(media, "_near", lambda a, b, view: compared.append(len(a) * len(b)) or near(a, b, view))
    monkeypatch.setattr(media, "_enough", lambda a, b: looked.append(len(a)) or full(a, b))
    got = [(x["a"], x["b"]) for part in media._links(iter([drawn_batch(images)])) for x in part.to_pylist()]
    assert sorted(got) == sorted(want)
    assert sum(compared) <= 30 * 30, compared
    assert sum(looked) <= 2 * len(want), (looked, len(want))


def test_one_image_with_very_many_matches(monkeypatch):
    """An image whose corners all look alike is taken with some of the others at a time; links stay the same."""
    rng = np.random.default_rng(22)
    kind = rng.integers(0, 1 << 63, (1, 2), dtype=np.uint64)
    place = lambda n: np.stack([rng.uniform(9, 300, n), rng.uniform(9, 300, n), np.zeros(n), np.ones(n)], axis=1)
    images = {i: (place(n), np.repeat(kind, n, axis=0)) for i, n in enumerate((40, 6, 6, 6, 40, 6))}
    images[6] = images[1][0] + [5, 5, 0, 0], images[1][1]
    got = {}
    for held in (24_000_000, 2_000, 100):
        monkeypatch.setattr(media, "HELD", held)
        got[held] = sorted((x["a"], x["b"], x["alike"]) for part in media._links(iter([drawn_batch(images)])) for x in part.to_pylist())
    assert got[24_000_000] == got[2_000] == got[100]
    assert (1, 6, True) in got[100]
