"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

All of it is built-in functions. Patterns find assignments, access keys and long hex runs.
Beyond these, every token of at least ``MIN_TOKEN`` characters is taken for text in the
narrowest encoding that its characters allow (digits, hex, base32, lower-case or mixed
letters and digits, base64 and its URL form) and tested for looking random in it:

* chi-squared: the characters are spread evenly over the alphabet (Wilson-Hilferty);
* runs: values above and below the middle alternate as chance has them do;
* serial correlation: neighbouring values are not correlated.

The three p-values of a token are combined (Bonferroni, valid whatever their dependence), and
Benjamini-Hochberg among tokens of about the same length dismisses those that don't look random,
so of the dismissed tokens a share of at most ``ALPHA`` was random. One that stays is a secret
rather than a word if ordinary text would hardly produce it: the likelihood ratio of uniform to
ordinary character frequencies is ``e**T``, and by Markov's inequality ``e**-T`` bounds the
probability of so large a ratio in ordinary text of any length. These p-values go through
Benjamini-Hochberg too, at the rate ``FDR`` and by length. Both work on one histogram of bounded
size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters or more in all
HEX = r"[0-9a-f]{16,}"
MIN_TOKEN = 20
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}+"
#: False-discovery rates of secrets, and of tokens dismissed as not random.
FDR, ALPHA = 0.01, 0.001
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
}
#: Rounded letter frequencies of European prose; capitals, digits and signs are rare in tokens.
_LETTERS = dict(zip("etaonishrdlcumwfgypbvkjxqz", (120, 85, 80, 75, 72, 70, 65, 52, 62, 42, 42, 30, 29, 27, 20, 21, 20, 19, 19, 15, 11, 8, 3, 3, 2, 2)))
#: Matches of a text that are numbered together, and characters of a stretch that is cut as a whole.
BLOCK, STRETCH = 256, 1024
#: Strata of length, and bins of the two p-values: tenths of a power of ten.
STRATA, BINS, FLAWS = 6, 400, 40


def ordinary() -> dict[str, float]:
    """Character probabilities of ordinary tokens, every character of the alphabets included."""
    raw = {c: 0.0 for c in ALPHABETS["mixed"]}
    for c, w in _LETTERS.items():
        raw[c], raw[c.upper()] = 0.93 * w, 0.03 * w
    for c in raw:
        raw[c] = max(raw[c], 1.0)
    total = sum(raw.values())
    return {c: w / total for c, w in raw.items()}


def _spans(text: Column, pattern: str, kind: str, matches: Column, good: Column | None = None) -> Column:
    """Structs (start, end, kind) of the matches, in code points; ``good`` holds which count."""
    order = KINDS.index(kind)
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(gaps.alias("g"), matches.alias("m"), (good if good is not None else F.transform(matches, lambda m: F.lit(True))).alias("ok"))

    def all_of(rows: Column) -> Column:
        before = _before(rows, 0, lambda at, x: at + F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0)), _plus)
        placed = F.zip_with(rows, before, lambda x, at: F.struct((at + F.length(x["g"])).alias("s"), F.length(x["m"]).alias("n"), x["ok"].alias("ok")))
        return F.transform(F.filter(placed, lambda x: x["ok"]), lambda x: F.struct(x["s"].alias("start"), (x["s"] + x["n"]).alias("end"), F.lit(order).alias("kind")))

    return F.when(F.size(matches) > 0, _bind(rows, all_of)).otherwise(none)


def _before(items: Column, first: int, step, join) -> Column:
    """For each item what ``step(total, item)`` makes, from ``first``, of those before it.

    Arrays grow by copying, so the totals are gathered in blocks, and ``join`` takes the totals of
    blocks together: a text with very many matches takes time in proportion to them.
    """

    def totals(xs: Column, start: Column, add) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def parts(blocks: Column) -> Column:
        each = F.transform(blocks, lambda b: F.aggregate(b, F.lit(first), step))
        return F.flatten(F.zip_with(blocks, totals(each, F.lit(first), join), lambda b, at: totals(b, at, step)))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))
    return F.when(F.size(items) <= BLOCK, totals(items, F.lit(first), step)).otherwise(_bind(cut, parts))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 2 * F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def encoding(token: Column) -> Column:
    """Struct (k, at) of the narrowest alphabet that has all characters of the token: its size, and
    by character code the place of each of its characters, from 1."""

    def told(alphabet: str) -> Column:
        return F.struct(F.lit(float(len(alphabet))).alias("k"), _by_code({c: i + 1.0 for i, c in enumerate(alphabet)}).alias("at"))

    out = told(ALPHABETS["mixed"])
    for name in reversed(list(ALPHABETS)[:-1]):
        signs = ALPHABETS[name].replace("-", r"\-")
        out = F.when(token.rlike(f"^[{signs}]+$"), told(ALPHABETS[name])).otherwise(out)
    return out


def _by_code(values: dict[str, float]) -> Column:
    """An array of numbers by character code, 0 where there is none."""
    return F.array(*[F.lit(float(values.get(chr(i), 0.0))) for i in range(128)])


def battery(token: Column) -> Column:
    """Struct (p_chi, p_runs, p_serial, t): uniformity p-values and the log-likelihood ratio.

    A token with all values on one side of the middle fails the runs test, a constant one the
    serial test too (p = 0).
    """
    logs = _by_code({c: math.log(q) for c, q in ordinary().items()})

    def of(e: Column) -> Column:
        codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
        return _bind(codes, lambda signs: _bind(F.transform(signs, lambda c: F.get(e["at"], c)), lambda v: tests(v, e["k"], signs)))

    def tests(v: Column, k: Column, signs: Column) -> Column:
        n = F.size(v).cast("double")
        squares = F.aggregate(
            F.array_sort(v),
            F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
            lambda a, x: F.struct(
                x.alias("last"),
                F.when(x == a["last"], a["run"] + 1).otherwise(F.lit(1.0)).alias("run"),
                # squares grow by 2 * run + 1 as a run grows by one
                (a["sum"] + F.when(x == a["last"], 2 * a["run"] + 1).otherwise(F.lit(1.0))).alias("sum"),
            ),
            lambda a: a["sum"],
        )
        chi = k * squares / n - n
        df = k - 1
        p_chi = _upper((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        high = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.when(x > k / 2, 1.0).otherwise(0.0))
        runs = F.aggregate(
            v,
            F.struct(F.lit(None).cast("boolean").alias("last"), F.lit(0.0).alias("n")),
            lambda a, x: F.struct((x > k / 2).alias("last"), (a["n"] + F.when(a["last"].eqNullSafe(x > k / 2), 0.0).otherwise(1.0)).alias("n")),
            lambda a: a["n"],
        )
        cross = 2 * high * (n - high)
        p_runs = F.when(cross > 0, _normal_tail((runs - cross / n - 1) / F.sqrt(F.greatest(cross * (cross - n) / (n * n * (n - 1)), F.lit(1e-9))))).otherwise(F.lit(0.0))
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        moments = _bind(
            mean,
            lambda m: F.aggregate(
                v,
                F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("xy")),
                lambda a, x: F.struct(x.alias("last"), (a["xx"] + (x - m) * (x - m)).alias("xx"), (a["xy"] + F.coalesce((a["last"] - m) * (x - m), F.lit(0.0))).alias("xy")),
            ),
        )
        p_serial = F.when(moments["xx"] > 0, _normal_tail((moments["xy"] / moments["xx"] + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0))
        t = F.aggregate(signs, F.lit(0.0), lambda a, c: a - F.get(logs, c)) - n * F.log(k)
        return F.struct(p_chi.alias("p_chi"), p_runs.alias("p_runs"), p_serial.alias("p_serial"), t.alias("t"))

    return _bind(encoding(token), of)


def _upper(z: Column) -> Column:
    """Upper tail of the normal distribution."""
    half = _normal_tail(z) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, base, tokens)``: pattern spans, and tested tokens (start, end, stratum,
    flaw, bin).

    ``flaw`` is ``-10 * log10`` of the combined p-value of the battery cut to 0..FLAWS, ``bin`` is
    ``10 * T / ln(10)`` cut to 0..BINS: a token's p-values are ``10**(-flaw / 10)`` and
    ``10**(-bin / 10)`` at most.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return _scan_rows(rows, ["doc_id"])


def _scan_rows(rows: DataFrame, carry: list[str]) -> DataFrame:
    text = F.col("text")
    rows = rows.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(n) for n, p in (("m_assign", ASSIGN), ("m_access", ACCESS), ("m_hex", HEX), ("m_token", TOKEN))])
    value = F.when(F.size("m_assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>"))
    long_enough = F.transform(value, lambda v: F.length(v) >= 12)
    base = F.array_sort(
        F.concat(_spans(text, ASSIGN, "assign", F.col("m_assign"), long_enough), _spans(text, ACCESS, "access", F.col("m_access")), _spans(text, HEX, "hex", F.col("m_hex"))),
        _in_order,
    )
    tested = F.zip_with(
        _spans(text, TOKEN, "random", F.col("m_token")),
        F.col("m_token"),
        lambda s, m: _bind(
            battery(m),
            lambda b: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.least(F.floor(F.log2(F.length(m) / MIN_TOKEN)), F.lit(STRATA - 1)).cast("int").alias("stratum"),
                _tenths(-F.log10(F.greatest(3 * F.least(b["p_chi"], b["p_runs"], b["p_serial"]), F.lit(1e-9))), FLAWS).alias("flaw"),
                _tenths(b["t"] / math.log(10), BINS).alias("bin"),
            ),
        ),
    )
    return rows.select(*carry, "text", base.alias("base"), tested.alias("tokens"))


def _tenths(x: Column, most: int) -> Column:
    return F.least(F.greatest(F.floor(10 * x), F.lit(0)), F.lit(most)).cast("int")


def step_up(counts: dict[int, int], total: int, rate: float) -> int | None:
    """Benjamini-Hochberg on bins: the least bin whose members are all discoveries, if any is."""
    found, out = 0, None
    for b in sorted((b for b in counts if b > 0), reverse=True):
        found += counts[b]
        if 10 ** (-b / 10) <= rate * found / total:
            out = b
    return out


def thresholds(tested: DataFrame, fdr: float = FDR, alpha: float = ALPHA) -> dict[int, tuple[int, int]]:
    """By length stratum: the least flaw that dismisses a token, and the least bin that makes
    one of those left a secret.

    The histogram has at most STRATA * (FLAWS + 1) * (BINS + 1) rows and is made by a
    pre-aggregated sum.
    """
    counts = tested.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.flaw", "t.bin").agg(F.count(F.lit(1)).alias("n"))
    by: dict[int, dict[tuple[int, int], int]] = {}
    for r in counts.collect():
        by.setdefault(r["stratum"], {})[r["flaw"], r["bin"]] = r["n"]
    out = {}
    for stratum, cells in by.items():
        total = sum(cells.values())
        flaws: dict[int, int] = {}
        for (flaw, _), n in cells.items():
            flaws[flaw] = flaws.get(flaw, 0) + n
        dismissed = step_up(flaws, total, alpha)
        dismissed = FLAWS + 1 if dismissed is None else dismissed
        bins: dict[int, int] = {}
        for (flaw, b), n in cells.items():
            if flaw < dismissed:
                bins[b] = bins.get(b, 0) + n
        least = step_up(bins, total, fdr)
        if least is not None:
            out[stratum] = dismissed, least
    return out


def _found(limits: dict[int, tuple[int, int]]) -> Column:
    """Base spans and discoveries that overlap none of them, in order."""
    if not limits:
        return F.col("base")
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    flaw, least = (F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v[i])]) for i in (0, 1))
    extra = F.transform(
        F.filter("tokens", lambda t: (t["flaw"] < F.coalesce(flaw[t["stratum"]], F.lit(0))) & (t["bin"] >= F.coalesce(least[t["stratum"]], F.lit(BINS + 1)))),
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit(KINDS.index("random")).alias("kind")),
    )
    both = _bind(F.array_sort(F.concat("base", F.coalesce(extra, none)), _in_order), _apart)
    return F.when(F.size("tokens") > 0, both).otherwise(F.col("base"))


def _in_order(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["kind"] - b["kind"])).cast("int")


def _apart(spans: Column) -> Column:
    """Ordered spans without the random ones that overlap a base span: no base span before one
    ends after its start, and none after it starts before its end."""
    random, far = KINDS.index("random"), 2**31 - 1
    ends = _before(spans, 0, lambda at, x: F.when(x["kind"] == random, at).otherwise(F.greatest(at, x["end"])), F.greatest)
    starts = F.reverse(_before(F.reverse(spans), far, lambda at, x: F.when(x["kind"] == random, at).otherwise(F.least(at, x["start"])), F.least))
    told = F.zip_with(F.arrays_zip(spans.alias("x"), ends.alias("e")), starts, lambda x, s: F.struct(x["x"].alias("x"), ((x["x"]["kind"] != random) | (x["e"] <= x["x"]["start"]) & (s >= x["x"]["end"])).alias("ok")))
    return F.transform(F.filter(told, lambda x: x["ok"]), lambda x: x["x"])


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Spans of secrets in every row of ``docs(doc_id, text)``.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random. Offsets are code
    points, ends exclusive. A null text is empty and has no spans; repeated rows come back
    repeated; a null ``doc_id`` stays null; an empty table gives no rows; a token of any length is
    one array of its characters in its row; other columns are ignored, whatever their names.
    """
    scratch = Scratch(spark)
    rows = scratch.keep(scan(docs).drop("text"))
    spans = _found(thresholds(rows))
    count = lambda kind, col: F.size(F.filter(col, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    out = rows.select("doc_id", "base", spans.alias("found"))
    return out.select(
        "doc_id",
        *[count(k, "base").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        count("random", "found").alias("n_random"),
    )


def _marked(parts: Column, size: Column, spans: Column, mark: str) -> Column:
    """The text of stretches ``parts`` with a mark for every run of overlapping spans.

    What stands between them is taken from its own stretches, not counted from the text's start."""

    def between(a: Column, b: Column) -> Column:
        low, high = (F.floor(x / STRETCH).cast("int") for x in (a, b - 1))
        return F.substr(F.array_join(F.slice(parts, low + 1, high - low + 1), ""), a - low * STRETCH + 1, b - a)

    ends = _before(spans, 0, lambda at, x: F.greatest(at, x["end"]), F.greatest)
    gaps = F.filter(F.zip_with(spans, ends, lambda x, at: F.struct(at.alias("a"), x["start"].alias("b"))), lambda g: g["a"] <= g["b"])
    rest = between(F.array_max(F.transform(spans, lambda x: x["end"])), size)
    return F.array_join(F.concat(F.transform(gaps, lambda g: between(g["a"], g["b"])), F.array(rest)), mark)


def redact(spark: SparkSession, docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; other columns pass through,
    whatever their names, ``n_chars`` counted anew. Overlapping spans become one mark; a null text
    stays null; repeated rows come back repeated; an empty table gives no rows."""
    scratch = Scratch(spark)
    held = docs.select(F.struct(*docs.columns).alias("row"), docs["text"].isNotNull().alias("had"), F.coalesce("text", F.lit("")).alias("text"))
    rows = scratch.keep(_scan_rows(held, ["row", "had"]).drop("text"))  # scanned once; the thresholds need all rows
    spans = rows.select("row", F.coalesce("row.text", F.lit("")).alias("text"), "had", _found(thresholds(rows)).alias("found"))
    text = F.when(F.col("had") & (F.size("found") > 0), _bind(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{STRETCH}}}"), F.lit(0)), lambda parts: _marked(parts, F.length("text"), F.col("found"), mark))).otherwise(F.col("row.text"))
    out = spans.select("row", text.alias("__text")).select(*[F.col("__text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

