import pytest
from pyspark.sql import functions as F

from quarrylake.llm import debruijn, repeats, simhash, suffix
from quarrylake.llm.common import Scratch

from . import brute

SCHEMA = "doc_id long, text string, lang string, data string, key int"


def frame(spark, rows):
    """Rows with other columns whose names clash with those used inside."""
    return spark.createDataFrame([(d, t, None, "x", 1) for d, t in rows], SCHEMA)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [5, 6])
def test_suffix_matches_brute_force(spark, seed):
    rows = brute.corpus(seed)
    got = rows_of(suffix.remove_repeats(spark, frame(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage")
    assert got == sorted(((*x, y[2]) for x, y in zip(brute.op7(rows), brute.op7(rows, suffix.PASSAGE))), key=str)


def test_suffix_split_shards(spark):
    rows = brute.corpus(8, 40)
    small = lambda s, f, u: suffix.hits(s, f, u, shard=300)
    got = rows_of(repeats.outcome(Scratch(spark), frame(spark, rows), repeats.Unit("byte", 100, 50), small), "doc_id", "n", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.op7(rows, 100), key=str)
    tiny = lambda s, f, u: suffix.hits(s, f, u, shard=40)
    got = rows_of(repeats.outcome(Scratch(spark), frame(spark, rows), repeats.Unit("word", 20, 10), tiny), "doc_id", "n", "n_removed", "kept_sha256")
    assert got == sorted(brute.op4(rows, 20), key=str)


def test_long_texts_cross_stretches(spark):
    """Texts that are hashed in several stretches lose the same."""
    rows = brute.corpus(4, 25)
    rows.append((900, " ".join(t or "" for _, t in rows)))
    got = rows_of(repeats.outcome(Scratch(spark), frame(spark, rows), repeats.Unit("byte", 400, 200, chunk=700), suffix.hits), "doc_id", "n", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.op7(rows), key=str)


@pytest.mark.parametrize("seed", [5, 7])
def test_debruijn_matches_brute_force(spark, seed):
    rows = brute.corpus(seed)
    got = rows_of(debruijn.remove_repeats(spark, frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.op4(rows), key=str)


def graph_corpus(seed):
    """Few words, so that passages overlap, branch, bulge and run in circles."""
    import random

    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [[word() for _ in range(rng.randint(50, 160))] for _ in range(6)]
    bulge = [*passage[0][:60], "other", *passage[0][61:]]
    rows = []
    for i in range(50):
        own = []
        for _ in range(rng.randint(1, 3)):
            p = rng.choice([*passage, bulge])
            a = rng.randint(0, len(p) // 2)
            own += [word() for _ in range(rng.randint(0, 25))] + p[a : rng.randint(a, len(p))]
        rows.append((i, " ".join(own)))
    circle = [word() for _ in range(40)] * 4
    return rows + [(60, " ".join(circle)), (61, "x " + " ".join(circle)), (62, "same " * 90), (63, rows[0][1]), (64, rows[0][1]), (None, None)]


@pytest.mark.parametrize(("shard", "seed"), [(None, 1), (200, 2), (2000, 1)])
def test_debruijn_graph_matches_brute_force(spark, shard, seed):
    """All columns, whatever the shards: paths branch, overlap and close where they should."""
    rows = graph_corpus(seed) + brute.corpus(seed, 20)[:20]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = rows_of(debruijn.remove_repeats(spark, frame(spark, rows), shard=shard), "doc_id", "n_words", "n_removed", "kept_sha256", "longest_path")
    longest = brute.longest_paths(rows)
    want = [(*x, longest[tuple(brute.words_of(t))]) for x, (_, t) in zip(brute.op4(rows), rows)]
    assert got == sorted(want, key=str)


def test_paths_join_pieces(spark):
    pieces = spark.createDataFrame([(1, 10, 5), (2, 20, 7), (3, 30, 1), (4, 40, 4), (5, 50, 2), (6, 60, 3)], "id long, last long, n long")
    links = spark.createDataFrame([(10, 2), (20, 3), (50, 6), (60, 5)], "a long, b long")
    got = {r["piece"]: (r["path"], r["path_words"]) for r in debruijn.paths(Scratch(spark), pieces, links).collect()}
    assert got == {1: (1, 13), 2: (1, 13), 3: (1, 13), 4: (4, 4), 5: (5, 5), 6: (5, 5)}


def test_repeated_rows_are_read_once(spark):
    """Thousands of equal rows give the stretches of one."""
    import random

    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(300)) + " z" * 200
    rows = [(7, text)] * 5000 + [(None, text)] * 50 + [(8, text[:900])]
    found = repeats.candidates(Scratch(spark), frame(spark, rows), debruijn.unit_of(35)).found
    assert found.count() < 100
    got = debruijn.remove_repeats(spark, frame(spark, rows))
    assert got.count() == len(rows) and got.where("n_removed = n_words").count() == len(rows)


def test_removed_text(spark):
    rows = [(1, "a" + "xyz" * 200), (2, "b" + "xyz" * 200), (3, "short"), (None, None), (None, "q" + "xyz" * 200)]
    got = suffix.without_repeats(spark, frame(spark, rows).withColumn("n_chars", F.length("text").cast("long")))
    assert got.columns == ["doc_id", "text", "lang", "data", "key", "n_chars"]
    assert rows_of(got, "doc_id", "text", "n_chars") == sorted([(1, "a", 1), (2, "b", 1), (3, "short", 5), (None, None, None), (None, "q", 1)], key=str)


def test_passages_leave_the_layout(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"One\n\n{passage}  two\nthree "), (2, f"{passage}"), (3, "x " * 20), (4, None), (5, f"a\t{passage}\n")]
    got = suffix.without_passages(spark, frame(spark, rows))
    assert rows_of(got, "doc_id", "text") == sorted([(1, "One\n\ntwo\nthree "), (2, ""), (3, "x " * 20), (4, None), (5, "a\t\n")], key=str)


@pytest.mark.parametrize("seed", [5, 6])
def test_simhash_matches_brute_force(spark, seed):
    rows = brute.corpus(seed)
    got = rows_of(simhash.near_duplicates(spark, frame(spark, rows)), "doc_id", "fingerprint", "component_id")
    assert got == sorted(brute.op1(rows), key=str)


def test_simhash_dense_cells(spark):
    import random

    rng = random.Random(2)
    fps = {0}
    while len(fps) < 400:
        x = rng.choice(list(fps))
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for block in (20, 10_000):
        root = {x: x for x in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in simhash.links(df, block).collect():
            assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
            root[find(a)] = find(b)
        for i, a in enumerate(signed):
            for b in signed[:i]:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                    assert find(a) == find(b)


def near_corpus(seed=1):
    import random

    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for n in (60, 120, 300):
        for share in (0.005, 0.01, 0.02, 0.03, 0.06):
            own = text(n)
            rows.append(" ".join(own).title())
            for _ in range(4):
                rows.append(" ".join(w if rng.random() > share else "new" + w for w in own))
    chain = text(200)
    for k in range(8):  # each near the next, the ends far apart
        chain = [*chain[4:], *text(4)]
        rows.append(" ".join(chain))
    rows = list(enumerate(rows))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  two"), (None, rows[0][1]), (None, "alone null"), (3, rows[3][1]), (5, "same id, other text"), (5, "same id, another text")]


@pytest.mark.parametrize("set_bytes", [None, 20_000])
def test_near_copies_match_brute_force(spark, monkeypatch, set_bytes):
    if set_bytes:
        monkeypatch.setattr(simhash, "SET_BYTES", set_bytes)
    rows = near_corpus()
    df = spark.createDataFrame([(d, t, 1, 2, "m") for d, t in rows], "doc_id long, text string, __rows int, mark int, row string")
    got = simhash.keep_one(spark, df)
    assert got.columns == df.columns
    kept = rows_of(got, "doc_id", "text")
    want = brute.near_firsts(rows)
    assert {d for d, _ in kept if d != 5} == {d for d, _ in want if d != 5} and len(kept) == len(want)
    assert simhash.keep_one(spark, df.limit(0)).count() == 0


def test_empty_table(spark):
    empty = frame(spark, [])
    for f in (simhash.near_duplicates, suffix.remove_repeats, debruijn.remove_repeats):
        assert f(spark, empty).count() == 0
