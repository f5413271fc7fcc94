import math
import random
import re
import zlib

import numpy as np

from quarrylake.llm import language, licenses, packing, quality

from .brute import words_of


def frame(spark, rows, lang=None):
    return spark.createDataFrame([(d, t, lang, b"z") for d, t in rows], "doc_id long, text string, lang string, data binary")


def odd_rows(seed=3, n=60):
    rng = random.Random(seed)
    pool = ["the", "Ünder", "a.", "🙂", "x|y", "##", "MIT", "under", "license", "cc", "by-nc", "\x0b", "end\n", "tab\there", "\xa0", "…"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 120)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "\n\n \n"), (None, "a b c a b c"), (3, "again"), (n + 3, "go " * 5000), (n + 4, "line one here\nline one here\n\n\nline one here")]


def repeat_words(words):
    seen, gone = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                gone |= {i, i + 1, i + 2}
    return len(gone)


def test_quality_base(spark):
    rows = odd_rows()
    want = []
    for d, t in rows:
        t = t or ""
        w = words_of(t)
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if words_of(line):
                dup += line in seen
                seen.add(line)
        rep = repeat_words(w)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    got = quality.quality(frame(spark, rows)).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(want, key=str)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.quality(frame(spark, [])).count() == 0


def test_quality_sql(spark):
    """The SQL gives the same on texts made of what the line rules look for."""
    import duckdb

    rng = random.Random(21)
    pool = ["|", ">", "»", "a|b", "Home", "read more", "READ", "ABC", "x", "x", "é.", "##", "!!!", "$$%", "{", "const x;", "(c)", "ends.", " ", "\t", "\x0b", "…", "privacy policy", "🙂"]
    line = lambda: rng.choice(["", " ", "\t"]) + " ".join(rng.choice(pool[: rng.choice((4, 10, 24))]) for _ in range(rng.randint(0, 14))) + rng.choice(["", " ", "\r", "."])
    rows = odd_rows() + [(500 + i, "\n".join(line() for _ in range(rng.randint(0, 25)))) for i in range(300)]
    got = quality.quality(frame(spark, rows))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(quality.SQL)
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_quality_lines(spark):
    rng = random.Random(12)
    good = "".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(9)) + ".\n" for _ in range(20))
    nav = "Home | About | News | Contact | Sitemap | Login\n"
    rows = [(1, good), (2, nav * 1 + "".join(f"a{i} | b{i} | c{i} | d{i} | e{i}\n" for i in range(30))), (3, nav + good), (4, " ".join(f"w{i}&&& x{i}###" for i in range(60)))]
    got = {r["doc_id"]: r for r in quality.quality(frame(spark, rows)).collect()}
    assert [got[i]["kept"] for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert (got[3]["n_lines_failed"], got[3]["line_rules"]) == (1, "navigation")
    kept = {r["doc_id"]: r["text"] for r in quality.keep_clean(frame(spark, rows)).collect()}
    assert kept == {1: good, 3: good}


def test_licenses(spark):
    texts = ["Released under the MIT License.", "CC BY-NC 4.0", "Licensed under the Apache License, Version 2.0", "under the\nmit--license under the mit license"]
    texts += ["You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"]
    rows = odd_rows() + [(100 + i, t) for i, t in enumerate(texts)]
    want = []
    for d, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        hits = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        want.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    got = licenses.scan_licenses(frame(spark, rows)).collect()
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(want, key=str)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert "gpl-3" in {r["doc_id"]: r for r in got}[104]["labels"].split(",")


def test_automaton_matches_brute_force():
    rng = random.Random(1)
    seqs = [[rng.randrange(4) for _ in range(rng.randint(1, 25))] for _ in range(5)]
    runs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    a = licenses.Automaton(seqs)
    for _ in range(50):
        ids = [rng.randrange(5) for _ in range(40)]
        longest = [max(n for n in range(e + 1) if n == 0 or tuple(ids[e - n : e]) in runs) for e in range(1, 41)]
        want = {(e - n, e) for e, n in zip(range(1, 41), longest) if n >= 3 and (e == 40 or longest[e] != n + 1)}
        assert {(s, e) for s, e, _ in a.matches(ids, 0, 3)} == want
        for s, e, ends in a.matches(ids, 0, 3):
            for t, seq in enumerate(seqs):
                places = [i + e - s - 1 for i in range(len(seq)) if seq[i : i + e - s] == ids[s:e]]
                assert sorted(ends.get(t, [])) == places


def test_chains_match_brute_force():
    """The best chain to every run is that of all chains."""
    rng = random.Random(5)
    for _ in range(200):
        size, words = rng.randint(10, 60), rng.randint(10, 90)
        start, runs = 0, set()
        for _ in range(rng.randint(1, 6)):
            start += rng.randint(1, 20)
            n = rng.randint(4, 9)
            end = max(start + n, max((r[1] + 1 for r in runs), default=0))
            for _ in range(rng.randint(1, 3)):
                if end <= words and end - start <= size:
                    runs.add((start, end, rng.randint(0, size - (end - start))))
        runs = sorted(runs)
        text, template = ([0, *(np.cumsum([rng.random() < 0.04 for _ in range(n)]).tolist())] for n in (words, size))
        fine = lambda a, b: a[1] <= b[0] <= a[1] + licenses.MAX_GAP and a[2] + a[1] - a[0] <= b[2] and text[a[1]] == text[b[0]] and template[a[2] + a[1] - a[0]] == template[b[2]]

        def best(k):
            own = runs[k][1] - runs[k][0]
            options = [own] if not template[runs[k][2]] else []
            return max(options + [best(j) + own for j in range(k) if fine(runs[j], runs[k]) and best(j) > 0], default=-1)

        want = sorted((best(k), r[1]) for k, r in enumerate(runs) if best(k) > 0 and template[r[2] + r[1] - r[0]] == template[size])
        assert sorted((n, e) for n, _, e in licenses.chains(runs, text, template)) == want


def test_licenses_are_told_apart():
    s = licenses.Scanner()
    labels = lambda t: s.scan(t.encode())[5]
    notice = lambda name, v: licenses._notice(name, v)
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    assert [labels(cc.format(x)) for x in ("", "-NoDerivatives", "-ShareAlike", "-NonCommercial", "-NonCommercial-NoDerivatives")] == ["cc-by", "cc-by-nd", "cc-by-sa", "cc-by-nc", "cc-by-nc-nd"]
    assert [labels(f"Text licensed under CC BY{x}.") for x in ("", "-SA 4.0", "-ND 4.0", "-NC-SA 4.0")] == ["cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc,cc-by-nc-sa"]
    gpl = "General Public License"
    assert [labels(f"Foo: {notice(n, v)}.") for n, v in ((gpl, "2"), (gpl, "3"), (gpl, "9"), (f"Lesser {gpl}", "3"), (f"Affero {gpl}", "3"))] == ["gpl-2", "gpl-3", "", "lgpl-3", "agpl-3"]
    assert [labels(f"under the terms of the GNU {gpl} version {v}") for v in "239"] == ["gpl-2", "gpl-3", ""]
    two, third, end = licenses._TWO, licenses._THIRD, licenses._DISCLAIMER
    assert [labels(x) for x in (two + end, two + third + end, two + "Some other words here. " + third + end)] == ["bsd-2", "bsd-3", "bsd-3"]
    assert labels(two + third + end + " And for the other file: " + "filler " * 40 + two + end) == "bsd-2,bsd-3"
    assert labels("Licensed under the Apache License, Version 1.1") == ""
    numbered = two.replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in")
    assert labels(numbered + "3. " + third + end) == "bsd-3"


def test_language(spark):
    rng = random.Random(2)
    parts = {"aa": ["the", "ing", "and", "er"], "bb": ["sch", "ung", "ei", "und"], "cc": ["que", "eau", "les", "é"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(40)), k) for i, k in enumerate(rng.choice(list(parts)) for _ in range(300))]
    rows += [(900, None, "aa"), (901, "12 34 !?", "bb"), (902, "", None), (None, "the and", "aa"), (903, "quequeeau lesque", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(spark, df).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows if i is not None)
    held = [(got[i]["lang_pred"], k) for i, _, k in rows[:300] if got[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "cc"]
    assert got[None]["held_out"] is False
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify(spark, empty).count() == 0


def gram_counts(data):
    """Counts of hashed two- and three-byte grams, gram by gram."""
    b = [32, *[c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in data], 32]
    out = [0] * language.BUCKETS
    for i in range(len(b) - 1):
        two = b[i] * 257 + b[i + 1]
        out[(two * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        if i + 2 < len(b):
            out[((two * 263 + b[i + 2]) * 2246822519 & 0xFFFFFFFF) >> 20] += 1
    return out


def test_language_matches_brute_force(spark):
    """Predictions and scores of every row are those of plain Python, from the definitions."""
    rng = random.Random(12)
    parts = {"aa": ["the", "ing", "and", "er"], "bb": ["sch", "ing", "ei", "und"], "cc": ["que", "ing", "and", "é"], "dd": ["the", "ei", "les", "日"]}
    rows = []
    for i in range(160):
        k = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[rng.choice([k, k, "aa"])]) for _ in range(2)) for _ in range(rng.randint(1, 12))), k))
    rows += [(500, "the " * 3000, "aa"), (501, "THE-And", None)]
    known = [(t, k) for d, t, k in rows if k and zlib.crc32(str(d).encode()) % 5]
    langs = sorted({k for _, k in known})
    p = []
    for lang in langs:
        c = [0.5 + sum(x) for x in zip(*(gram_counts(t.encode()) for t, k in known if k == lang))]
        p.append([x / sum(c) for x in c])
    bits = []  # every split of the languages in two, the first always on the plus side
    for number in range((1 << (len(langs) - 1)) - 1):
        sign = [1, *[1 if number >> j & 1 else -1 for j in range(len(langs) - 1)]]
        mean = lambda s: [sum(x) / sign.count(s) for x in zip(*(p[j] for j in range(len(langs)) if sign[j] == s))]  # noqa: E731, B023
        weight = [math.log(a) - math.log(b) for a, b in zip(mean(1), mean(-1))]
        at = [sum(a * b for a, b in zip(own, weight)) for own in p]
        low, high = min(x for x, s in zip(at, sign) if s > 0), max(x for x, s in zip(at, sign) if s < 0)
        bits.append((sign, weight, (low + high) / 2, max((low - high) / 2, 1e-3)))
    trust = sum(b[3] for b in bits)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(spark, df).collect()}
    for d, t, _ in rows:
        x = gram_counts(t.encode())
        loss = [0.0] * len(langs)
        for sign, weight, centre, scale in bits:
            margin = (sum(n * w for n, w in zip(x, weight)) / sum(x) - centre) / scale
            for j, s in enumerate(sign):
                loss[j] += math.log1p(math.exp(-2 * max(-30.0, min(30.0, s * margin)))) * scale / trust
        first, second = sorted(loss)[:2]
        score = (second - first) / max(second + first, 1e-12)
        assert got[d]["lang_pred"] == langs[loss.index(first)] and abs(got[d]["score"] - score) < 1e-9
        assert got[d]["ambiguous"] == (score < language.AMBIGUOUS)


def test_grams_of_long_texts(monkeypatch):
    """Texts are counted in stretches, whose borders lose no gram."""
    data = "The quick brown é fox 日本 jumps. ".encode() * 7
    want = gram_counts(data)
    for step in (1 << 20, 2, 3, 17, 64):
        monkeypatch.setattr(language, "_STEP", step)
        assert language.grams(data).tolist() == want


def test_codewords_are_apart():
    for n in (2, 3, 5, 9, 40):
        c = language.codewords(n)
        assert (abs(c.sum(axis=0)) < n).all()
        assert (c @ c.T)[~np.eye(n, dtype=bool)].max() <= c.shape[1] * 0.6


def check_pieces(rows, got, ids_of, tokens=2048):
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= tokens
    want = []
    for d, t in rows:
        ids = ids_of(t or "") + [0]
        for k in range(0, len(ids), tokens):
            part = np.array(ids[k : k + tokens], "<u4")
            want.append((d, k // tokens, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    return len(by), sum(w[3] for w in want)


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(6)
    rows = odd_rows() + [(200 + i, " ".join(rng.choice(["Alpha", "betá", "it's", "x2y", "<|endoftext|>", "日本", "ΣΑΣ"]) for _ in range(rng.randint(1, 900)))) for i in range(80)]
    got = packing.pack(spark, frame(spark, rows)).collect()
    n, total = check_pieces(rows, got, lambda x: t.encode(x, add_special_tokens=False).ids)
    assert n <= -(-total // 2048) + 1
    assert packing.pack(spark, frame(spark, [])).count() == 0


def test_plan_keeps_all_limits():
    rng = random.Random(8)
    counts = {rng.randint(1, 300): rng.randint(1, 40) for _ in range(60)}
    for rule in ("norm", "dot"):
        for docs, cost in ((None, None), (4, None), (None, 60_000), (5, 70_000)):
            runs = packing.plan(counts, 300, docs, cost, rule)
            seqs, seen = {}, {}
            order = {n: sorted(r for r in runs.tolist() if r[0] == n) for n in counts}
            for n, own in order.items():
                for k, (_, rank, seq, off) in enumerate(own):
                    until = own[k + 1][1] if k + 1 < len(own) else counts[n]
                    for x in range(until - rank):
                        seqs.setdefault(seq + x, []).append((off, n))
                        seen[n] = seen.get(n, 0) + 1
            assert seen == counts
            for own in seqs.values():
                at = 0
                for off, n in sorted(own):
                    assert off == at
                    at += n
                assert at <= 300 and len(own) <= (docs or 300)
                assert len(own) == 1 or sum(n * n for _, n in own) <= (cost or 90_000)


def test_long_words_are_not_remembered():
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    text = "ab " + "x" * 5000 + " ab " + "x" * 5000 + " " + "é" * 300
    assert np.frombuffer(w.encode(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert list(w.known) == [b"ab"]


def test_words_equal_tokenizer():
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path(), cache=500)
    rng = random.Random(1)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCXYZéèêçÄßñÉ0123456789.,;'#$%\"-_|<>()\x01\x1c·¼²ªİΣσς日́İ"
    for _ in range(4000):
        x = "".join(rng.choice(alphabet[: rng.choice((8, 26, 45, len(alphabet)))]) for _ in range(rng.randint(1, 12)))
        assert np.frombuffer(w.encode(x.encode()), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x
