"""Line-first quality rules: lines are judged and removed, then documents that lost too much go.

A line with a word fails if it looks like navigation (several short fields between bars or
arrows), is boilerplate (stock phrases of cookie bars, scripts and footers), carries decoration
(many words stuck to symbols, or words with piled-up punctuation), shouts, repeats one word, or
lacks closing punctuation while being too short for a sentence. Lines without a word never
count. A document is rejected if it fails the base rules (fewer than 50 words, or more than
half of its words in repeated three-word windows) or if the failed lines hold more than
``max_loss`` of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Writer, rows_of, text_bytes

MIN_WORDS, MAX_LOSS = 50, 0.4
_SPACES_AND_TAILS = b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))
_NOT_SYMBOLS = bytes(x for x in range(256) if x not in b"#*$%&|<>")
_NAV = re.compile(rb"\s(?:\||>|\xc2\xbb|\xe2\x80\xba|\xe2\x86\x92|\xc2\xb7|/)(?=\s)")
_STOCK = re.compile(
    rb"(?i)\b(?:enable javascript|javascript (?:is|must)|accept (?:all )?cookies|uses cookies|cookie (?:policy|settings)|privacy policy|terms of (?:use|service)|"
    rb"all rights reserved|click here|read more|sign in|log in|subscribe (?:now|to)|skip to (?:main )?content|lorem ipsum|share (?:on|this)|back to top)\b|[{}]\s*$|^\s*(?:function|var|const)\b.*[;{]"
)
_PILED = re.compile(rb"[#*$%&|<>]{2,}|[.,!?]{3,}")
_CLOSE = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", b"\xe2\x80\xa6", b"\xe2\x80\x9d", b"\xc2\xbb", b"\xe3\x80\x82")
RULES = ("navigation", "boilerplate", "decoration", "shouting", "one_word", "no_close")


def line_fault(line: bytes, words: list[bytes]) -> int:
    """0, or 1 + the index in RULES of the first rule that a line with words fails."""
    n = len(words)
    bars = len(_NAV.findall(line))
    if bars >= 3 and 4 * bars >= n:
        return 1
    if n <= 25 and _STOCK.search(line):
        return 2
    if 5 * len(_PILED.findall(line)) > n + 4:
        return 3
    if n >= 4 and line == line.upper() and re.search(rb"[A-Z]{2}", line):
        return 4
    if n >= 6 and len(set(words)) * 4 <= n:
        return 5
    if n < 4 and not line.rstrip().endswith(_CLOSE):
        return 6
    return 0


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur at least twice, first ones included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    key = w[:n]
    for k in range(1, size):
        if key.max() >= (1 << 62) // (len(ids) + 1):
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(ids) + w[k : k + n]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def judge(data: bytes, max_loss: float = MAX_LOSS) -> tuple:
    """Counts, verdicts and the cleaned text of one document."""
    words = data.split()
    n = len(words)
    chars = len(data.translate(None, _SPACES_AND_TAILS))
    symbols = len(data.translate(None, _NOT_SYMBOLS))
    seen: set[bytes] = set()
    dup = lost = bad = 0
    faults = [0] * len(RULES)
    kept_lines = []
    for line in data.split(b"\n"):
        parts = line.split()
        if parts:
            if line in seen:
                dup += 1
            else:
                seen.add(line)
            if fault := line_fault(line, parts):
                faults[fault - 1] += 1
                lost += len(parts)
                bad += 1
                continue
        kept_lines.append(line)
    repeats = repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * repeats > 50 * n
    kept = not base_failed and lost <= max_loss * n
    return n, chars, symbols, dup, repeats, base_failed, kept, bad, lost, ",".join(r for r, f in zip(RULES, faults) if f), b"\n".join(kept_lines)


_OUT = pa.schema(
    [("doc_id", pa.int64())]
    + [(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_lines_failed", pa.int64()), ("n_words_lost", pa.int64()), ("line_rules", pa.string())]
)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_failed long, n_words_lost long, line_rules string"


def quality(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """Counts and verdicts for every row of ``docs(doc_id, text)``; one scan, no shuffle.

    A null or empty text has no words and fails the base rules; repeated rows come back
    repeated; a null ``doc_id`` stays null; an empty table gives no rows. Other columns are
    ignored. n_lines_failed, n_words_lost and line_rules tell what the line rules removed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(_OUT)
        for doc, data in rows_of(batches, "doc_id", "data"):
            if out.add(doc, *judge(data, max_loss)[:-1]):
                yield out.flush()
        if len(out):
            yield out.flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data")).mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """The rows of ``docs`` that pass, each with its failed lines removed from ``text``.

    Every other column passes through; ``n_chars``, where there is one, is counted anew.
    """
    schema, names = docs.schema, docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [judge(x.encode("utf-8") if x else b"", max_loss) for x in batch.column(at).to_pylist()]
            keep = pa.array([j[6] for j in judged], pa.bool_())
            texts = pa.array([j[-1].decode("utf-8", "replace") for j in judged], pa.string())
            cols = [texts if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(keep)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


#: The query ``op3_quality`` in DuckDB. A bar of navigation is a word of its own with white
#: space on both sides; rows are numbered, as ids may repeat.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
v AS (SELECT r, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS n FROM v WHERE z IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM c CROSS JOIN (VALUES (0), (1), (2)) AS s(k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
lf AS (
    SELECT r, line, len(ws) AS n,
        len(list_filter(ws, lambda x: x IN ('|', '>', '»', '›', '→', '·', '/')))
            - CASE WHEN ws[1] IN ('|', '>', '»', '›', '→', '·', '/') AND NOT regexp_matches(line, '^[\x20\x09-\x0D]') THEN 1 ELSE 0 END
            - CASE WHEN ws[-1] IN ('|', '>', '»', '›', '→', '·', '/') AND NOT regexp_matches(line, '[\x20\x09-\x0D]$') AND (len(ws) > 1 OR regexp_matches(line, '^[\x20\x09-\x0D]')) THEN 1 ELSE 0 END AS bars,
        len(list_distinct(ws)) AS apart, right(ws[-1], 1) AS ending
    FROM lw WHERE len(ws) > 0),
f AS (
    SELECT r, line, n, CASE
        WHEN bars >= 3 AND 4 * bars >= n THEN 1
        WHEN n <= 25 AND regexp_matches(line, '(?i)\b(?:enable javascript|javascript (?:is|must)|accept (?:all )?cookies|uses cookies|cookie (?:policy|settings)|privacy policy|terms of (?:use|service)|all rights reserved|click here|read more|sign in|log in|subscribe (?:now|to)|skip to (?:main )?content|lorem ipsum|share (?:on|this)|back to top)\b|[{}][\x20\x09-\x0D]*$|^[\x20\x09-\x0D]*(?:function|var|const)\b.*[;{]') THEN 2
        WHEN 5 * len(regexp_extract_all(line, '[#*$%&|<>]{2,}|[.,!?]{3,}')) > n + 4 THEN 3
        WHEN n >= 4 AND NOT regexp_matches(line, '[a-z]') AND regexp_matches(line, '[A-Z]{2}') THEN 4
        WHEN n >= 6 AND 4 * apart <= n THEN 5
        WHEN n < 4 AND ending NOT IN ('.', '!', '?', ':', ';', '"', chr(39), ')', '…', '”', '»', '。') THEN 6
        ELSE 0 END AS fault
    FROM lf),
b AS (
    SELECT r, count(*) FILTER (fault > 0) AS bad, coalesce(sum(n) FILTER (fault > 0), 0) AS lost, count(*) - count(DISTINCT line) AS dup,
        list_sort(list(DISTINCT fault) FILTER (fault > 0)) AS faults
    FROM f GROUP BY r),
j AS (
    SELECT d.doc_id, len(w.ws) AS n, coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0) AS chars, len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS symbols,
        coalesce(b.dup, 0) AS dup, coalesce(rep.n, 0) AS repeats, coalesce(b.bad, 0) AS bad, coalesce(b.lost, 0) AS lost, b.faults
    FROM d JOIN w USING (r) LEFT JOIN b USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
    CAST(repeats AS BIGINT) AS n_repeat_words, n < 50 OR 100 * repeats > 50 * n AS base_failed,
    NOT (n < 50 OR 100 * repeats > 50 * n) AND lost <= CAST(0.4 AS DOUBLE) * n AS kept, CAST(bad AS BIGINT) AS n_lines_failed, CAST(lost AS BIGINT) AS n_words_lost,
    coalesce(array_to_string(list_transform(faults, lambda k: ['navigation', 'boilerplate', 'decoration', 'shouting', 'one_word', 'no_close'][k]), ','), '') AS line_rules
FROM j
"""
