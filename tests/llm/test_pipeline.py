"""The whole corpus pipeline against plain Python, stage by stage."""

import random

import corpus_pipeline
from quarrylake.llm import packing, quality

from . import brute
from .test_secrets import ACCESS_HEX, ASSIGN
from .test_text import check_pieces


def documents(seed=11, n=70):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ra", "te", "lo", "né", "si", "mo", "ku"]) for _ in range(rng.randint(1, 4)))
    line = lambda k: " ".join(word() for _ in range(k)).capitalize() + ".\n"
    body = lambda k: "".join(line(rng.randint(8, 14)) for _ in range(k))
    shared = [body(8), body(12)]
    rows = []
    for i in range(n):
        text, kind = body(rng.randint(8, 25)), rng.random()
        if kind < 0.2:
            text += rng.choice(shared) + body(6)
        elif kind < 0.35 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.5 and rows:
            text = rng.choice(rows)[1] + "One more line of words here.\n"
        elif kind < 0.65:
            text += 'The token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(32)) + '" and AKIA' + "ABCDEFGH23456789 it is.\n" + body(3)
        elif kind < 0.75:
            text = "Home | About | News | Contact | Sitemap\n" + text
        elif kind < 0.8:
            text = "a | b | c | d | e\n" * 3 + "".join(f"x{k} | y{k} | z{k} | u{k}\n" for k in range(30))
        elif kind < 0.85:
            text = "too short"
        rows.append((i, text))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, body(900))]


def redacted(text):
    spans = [(m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), m.end()) for p, least in ACCESS_HEX for m in p.finditer(text) if len(m[0]) >= least]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def without(text, gone):
    """A text without the words that are gone and the white space behind them."""
    out, n, drop = "", -1, False
    for k, c in enumerate(text):
        if c in brute.SPACES:
            out += "" if drop and n < len(gone) - 1 else c
        else:
            if k == 0 or text[k - 1] in brute.SPACES:
                n += 1
                drop = gone[n]
            out += "" if drop else c
    return out


def expected(rows):
    """What is left of the documents in front of the packing stage."""
    judged = [(d, quality.judge((t or "").encode())) for d, t in rows]
    kept = [(d, j[-1].decode()) for d, j in judged if j[6]]
    first = brute.near_firsts(kept)
    left = [without(t, gone) for (_, t), gone in zip(first, brute.repeats([brute.words_of(t) for _, t in first], 50))]
    assert len(rows) > len(kept) > len(first) and any(len(a) > len(b) for (_, a), b in zip(first, left))
    assert any(redacted(t) != t for t in left)
    return [(d, redacted(t)) for (d, _), t in zip(first, left)]


def test_run_matches_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = documents()
    made = [(d, t, "xx", f"src{d % 3}", len(t) if t is not None else None) for d, t in rows]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(packing.tokenizer_path())
    check_pieces(expected(rows), got, lambda x: t.encode(x, add_special_tokens=False).ids)


def test_stages_keep_columns(spark, tmp_path):
    """Each stage but the last returns the columns of its input, also of an empty table and with
    names that the stages use themselves."""
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    clashing = plain + ", spans int, key string, row int, __rows int, mark int, sha string, data string, fresh int, base int, n int, sequence_id int"
    for schema, n in ((clashing, 12), (plain, 0)):
        rows = [(d, t, "xx", "s", len(t or ""), *[None] * (schema.count(",") - 4)) for d, t in documents(3, 12)[: n or 0]]
        df = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
            assert out.count() <= len(rows)
        assert (corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() == 0) == (not rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_text", "secrets", "packing"]
