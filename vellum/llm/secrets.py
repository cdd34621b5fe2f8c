"""Secret scan: base patterns, and a randomness test battery with length-aware control of false discoveries.

DataFrame functions only. One pass over whole texts gives for each document the spans of the base patterns and of the
candidate tokens (runs of 20 or more characters of base64 alphabets), with statistics of each token; texts are not
kept. Each token gets an encoding from its characters (hex, base32, alphanumeric, base64), and with it an alphabet of
k symbols. Three tests look at the token's symbols:

* chi-squared of the symbol counts against the uniform distribution;
* runs (Wald-Wolfowitz) of symbols in the upper and lower half of the alphabet;
* serial correlation of neighbouring symbols.

What isn't random is ordinary text or ordered, and both must be ruled out. Ordinary text has a known excess of chi-squared:
the sum of squared shares of its letters (``TEXT_SQUARES`` for each encoding) is larger than 1/k, so the statistic is about
noncentral chi-squared with a noncentrality that grows with the length. In an ordered token (an alphabet, a pattern that
alternates) the squared scores of runs and serial correlation are noncentral too, about ``ORDER`` squared times the length
each, and their sum has two degrees of freedom; a random token's is central. Each of the two p-values is the probability
that such a token of this length and encoding looks as random as this one does, by Sankaran's approximation; the battery's
is the larger of the two. Then Benjamini-Hochberg at ``FDR`` is applied within each stratum of encoding and length (powers
of sqrt 2) over the whole corpus, so that many short tokens can't spend the errors of the long ones. Ranks come from a
histogram of -log10 p in steps of 0.01, whose size is bounded, not from a sort.

Places of matches, and what lies before and after a span, are running sums, maxima and minima over blocks (``running``):
no array of a text's matches is copied for each match.

Spans are kind:start:end in code points, the end exclusive; found tokens have the kind ``random`` and are left out
where they overlap a base span. A null text is an empty one and has no spans; repeated rows are scanned alike; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import shared_checkpoint, table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
FDR = 0.001
ORDER = 0.9
#: Values in a block of a running combination, and levels of blocks; at three, the last has 4096 at most for any text.
STEP, LEVELS = 256, 3
#: Name, pattern of the whole token, alphabet. The first that fits is the encoding.
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", r"^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Sums of squared shares of the symbols of ordinary text: decimal numbers for hex, English letters for the others.
TEXT_SQUARES = {"hex": 0.1, "base32": 0.066, "alnum": 0.066, "base64": 0.062}


def running(values: Column, join, levels: int = LEVELS) -> Column:
    """The array whose places hold ``join`` of all values up to there; ``join`` is associative. Arrays are cut into
    blocks of ``STEP`` values, whose totals are combined in the same way, so a block is all that is copied for a value."""

    def of_block(block: Column) -> Column:
        add = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(join(F.element_at(acc, -1), x))))
        return F.aggregate(block, F.array().cast("array<int>"), add)

    def of_blocks(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(v), F.lit(STEP)), lambda i: of_block(F.slice(v, i, STEP)))

        def joined(parts: Column) -> Column:
            before = running(F.transform(parts, lambda p: F.element_at(p, -1)), join, levels - 1)
            later = lambda p, t: F.transform(p, lambda x: join(t, x))
            return F.concat(parts[0], F.flatten(F.zip_with(F.slice(parts, F.lit(2), F.size(parts)), F.slice(before, F.lit(1), F.size(parts) - 1), later)))

        return F.transform(F.array(cut), joined)[0]

    if levels == 1:
        return of_block(values)
    return F.transform(F.array(values), lambda v: F.when(F.size(v) <= STEP, of_block(v)).otherwise(of_blocks(v)))[0]


NO_SPANS = "array<struct<start:int,kind:int,end:int,match:string>>"


def spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start, kind, end, match>> of all matches of ``pattern``, leftmost first, that ``keep`` holds for."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda hit, gap: F.length(gap) + F.length(hit))
    placed = F.zip_with(found, running(steps, lambda a, b: a + b), lambda hit, end: F.struct((end - F.length(hit)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), hit.alias("match")))
    good = placed if keep is None else F.filter(placed, lambda s: keep(s["match"]))
    return F.when(text.rlike(pattern), good).otherwise(F.array().cast(NO_SPANS))


def untouched(tokens: Column, base: Column) -> Column:
    """The tokens that no base span overlaps. In the order of all spans, the largest end of the base spans so far and
    the least start of those to come tell."""
    every = F.array_sort(F.concat(base, tokens))
    is_base = lambda s: s["kind"] < 3
    ends = running(F.transform(every, lambda s: F.when(is_base(s), s["end"]).otherwise(-1)), lambda a, b: F.greatest(a, b))
    starts = F.reverse(running(F.reverse(F.transform(every, lambda s: F.when(is_base(s), s["start"]).otherwise((1 << 31) - 1))), lambda a, b: F.least(a, b)))
    told = F.arrays_zip(every.alias("span"), ends.alias("before"), starts.alias("next"))
    free = F.filter(told, lambda t: ~is_base(t["span"]) & (t["before"] <= t["span"]["start"]) & (t["next"] >= t["span"]["end"]))
    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(F.transform(free, lambda t: t["span"]))


def base_spans(text: Column) -> list[Column]:
    assign = spans(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8)
    access = spans(text, ACCESS, 1, lambda m: F.length(m) >= 16)
    return [assign, access, spans(text, HEX, 2)]


def encoding(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern, _ in reversed(ENCODINGS):
        out = F.when(token.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def by_encoding(name: Column, values: dict[str, object]) -> Column:
    out = F.lit(None)
    for key, value in values.items():
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out


def symbols(token: Column, name: Column) -> Column:
    """The token without padding, in the letters of its alphabet."""
    plain = F.regexp_replace(token, "=+$", "")
    return F.when(name == "hex", F.lower(plain)).otherwise(F.translate(plain, "_-", "/+"))


def statistics(tokens: Column) -> Column:
    """From (start, kind, end, match): array of structs of encoding, size, chi (chi-squared) and order (the sum of the
    squared scores of runs and serial correlation), with the place of the token."""
    x = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end"), t["match"].alias("match"), encoding(t["match"]).alias("encoding")))
    x = F.transform(
        x,
        lambda t: F.struct(
            *(t[c].alias(c) for c in ("start", "kind", "end", "encoding")),
            symbols(t["match"], t["encoding"]).alias("plain"),
            by_encoding(t["encoding"], {n: a for n, _, a in ENCODINGS}).alias("alphabet"),
        ),
    )

    x = F.transform(
        x,
        lambda t: F.struct(
            *(t[c].alias(c) for c in ("start", "kind", "end", "encoding", "plain")),
            F.length(t["plain"]).cast("double").alias("size"),
            F.length(t["alphabet"]).cast("double").alias("k"),
            upper_half(t).alias("halves"),
            F.transform(F.split(t["plain"], ""), lambda c: F.instr(t["alphabet"], c).cast("double")).alias("values"),
        ),
    )
    x = F.transform(
        x,
        lambda t: F.struct(
            *(t[c].alias(c) for c in ("start", "kind", "end", "encoding", "size", "k", "halves", "values")),
            F.aggregate(F.array_distinct(F.split(t["plain"], "")), F.lit(0.0), lambda s, c: s + F.pow(t["size"] - F.length(F.replace(t["plain"], c, F.lit(""))), F.lit(2.0))).alias("squares"),
            F.length(F.replace(t["halves"], F.lit("0"), F.lit(""))).cast("double").alias("ones"),
            (F.aggregate(t["values"], F.lit(0.0), lambda s, v: s + v) / t["size"]).alias("average"),
        ),
    )
    x = F.transform(
        x,
        lambda t: F.struct(
            *(t[c].alias(c) for c in ("start", "kind", "end", "encoding", "size", "ones")),
            (t["squares"] * t["k"] / t["size"] - t["size"]).alias("chi"),
            ((2 * t["size"] - F.length(F.replace(t["halves"], F.lit("01"), F.lit(""))) - F.length(F.replace(t["halves"], F.lit("10"), F.lit("")))) / 2.0 + 1).alias("seen"),
            (2 * t["ones"] * (t["size"] - t["ones"]) / t["size"] + 1).alias("mean"),
            F.aggregate(t["values"], F.lit(0.0), lambda s, v: s + (v - t["average"]) * (v - t["average"])).alias("spread"),
            F.aggregate(
                F.zip_with(F.slice(t["values"], F.lit(1), F.size(t["values"]) - 1), F.slice(t["values"], F.lit(2), F.size(t["values"]) - 1), lambda a, b: (a - t["average"]) * (b - t["average"])),
                F.lit(0.0),
                lambda s, v: s + v,
            ).alias("lagged"),
        ),
    )
    x = F.transform(
        x,
        lambda t: F.struct(
            *(t[c].alias(c) for c in ("start", "kind", "end", "encoding", "size", "chi")),
            F.when((t["ones"] == 0) | (t["ones"] == t["size"]), F.lit(99.0)).otherwise((t["seen"] - t["mean"]) / F.sqrt(F.greatest((t["mean"] - 1) * (t["mean"] - 2) / (t["size"] - 1), F.lit(1e-9)))).alias("runs"),
            F.when(t["spread"] > 1e-9, t["lagged"] / t["spread"] * F.sqrt(t["size"])).otherwise(F.lit(99.0)).alias("serial"),
        ),
    )
    return F.transform(x, lambda t: F.struct(*(t[c].alias(c) for c in ("start", "kind", "end", "encoding", "size")), F.greatest(t["chi"], F.lit(0.0)).alias("chi"), (t["runs"] * t["runs"] + t["serial"] * t["serial"]).alias("order")))


def upper_half(t: Column) -> Column:
    """The token with 0 for the symbols of the lower half of its alphabet and 1 for the others."""
    out = F.lit(None).cast("string")
    for n, _, a in ENCODINGS:
        out = F.when(t["encoding"] == n, F.translate(t["plain"], a, "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2))).otherwise(out)
    return out


def upper_tail(z: Column) -> Column:
    """-log10 of the normal upper tail at z, by Börjesson and Sundberg's bound; at most 0.3 % off."""
    x = F.abs(z)
    tail = F.log10(0.661 * x + 0.339 * F.sqrt(x * x + 5.510)) + (x * x / 2) / math.log(10) + 0.5 * math.log10(2 * math.pi)
    return F.when(z >= 0, tail).otherwise(-F.log10(1 - F.pow(F.lit(10.0), -tail)))


def surprises(tested: Column) -> Column:
    """From ``statistics``: start, kind, end, stratum and step, which is 100 * -log10 of the battery's p."""
    own = ("start", "kind", "end", "encoding", "size")

    def for_tests(x: Column, change) -> Column:
        return F.transform(x, lambda t: F.struct(*(t[c].alias(c) for c in own), F.transform(t["tests"], change).alias("tests")))

    excess = lambda t: t["size"] * by_encoding(t["encoding"], {n: max(len(a) * TEXT_SQUARES[n] - 1, 0.0) for n, _, a in ENCODINGS})
    degrees = lambda t: by_encoding(t["encoding"], {n: len(a) - 1.0 for n, _, a in ENCODINGS})
    test = lambda x, df, excess: F.struct(x.alias("x"), df.alias("df"), excess.alias("excess"))
    both = lambda t: F.array(test(t["chi"], degrees(t), excess(t)), test(t["order"], F.lit(2.0), t["size"] * (2 * ORDER**2)))
    x = F.transform(tested, lambda t: F.struct(*(t[c].alias(c) for c in own), both(t).alias("tests")))
    x = for_tests(
        x,
        lambda u: F.struct(
            (u["x"] / (u["df"] + u["excess"])).alias("ratio"),
            (1 - 2 * (u["df"] + u["excess"]) * (u["df"] + 3 * u["excess"]) / (3 * F.pow(u["df"] + 2 * u["excess"], F.lit(2.0)))).alias("h"),
            ((u["df"] + 2 * u["excess"]) / F.pow(u["df"] + u["excess"], F.lit(2.0))).alias("p"),
        ),
    )
    x = for_tests(x, lambda u: F.struct(*(u[c].alias(c) for c in ("ratio", "h", "p")), ((u["h"] - 1) * (1 - 3 * u["h"])).alias("m")))
    z = lambda u: (F.pow(u["ratio"], u["h"]) - (1 + u["h"] * u["p"] * (u["h"] - 1 - 0.5 * (2 - u["h"]) * u["m"] * u["p"]))) / (u["h"] * F.sqrt(2 * u["p"]) * (1 + 0.5 * u["m"] * u["p"]))
    x = for_tests(x, lambda u: -z(u))
    return F.transform(
        x,
        lambda t: F.struct(
            *(t[c].alias(c) for c in ("start", "kind", "end")),
            F.concat(t["encoding"], F.lit(":"), F.floor(2 * F.log2(t["size"])).cast("string")).alias("stratum"),
            F.least(F.floor(upper_tail(F.array_min(t["tests"])) * 100), F.lit(30_000)).cast("int").alias("step"),
        ),
    )


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans in order, and the candidate tokens that touch none of them, with their surprise."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", *(c.alias(k) for c, k in zip(base_spans(text), KINDS)), spans(text, TOKEN, 3).alias("tokens"))
    base = F.array_sort(F.concat(*KINDS[:3]))
    out = out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), base.alias("base"), "tokens")
    out = out.withColumn("free", untouched(F.col("tokens"), F.col("base")))
    tested = F.when(F.size("free") > 0, surprises(statistics(F.col("free")))).otherwise(F.array())
    bare = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", bare.alias("base"), tested.alias("tested"))


def thresholds(scan: DataFrame, fdr: float = FDR) -> dict[str, int]:
    """The least step that Benjamini-Hochberg lets through, for each stratum where it lets any through. There are a
    few strata for each power of two of the token length, and 30,001 steps at most in each."""
    counts = scan.select(F.explode("tested").alias("t")).groupBy("t.stratum", "t.step").count()
    up = Window.partitionBy("stratum").orderBy(F.desc("step"))
    ranked = counts.select("stratum", "step", F.sum("count").over(up).alias("rank"), F.sum("count").over(Window.partitionBy("stratum")).alias("tests"))
    passed = ranked.filter(F.pow(F.lit(10.0), -F.col("step") / 100.0) <= fdr * F.col("rank") / F.col("tests"))
    return {r["stratum"]: r["least"] for r in passed.groupBy("stratum").agg(F.min("step").alias("least")).collect()}


def digest(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base and found: spans as arrays of (start, kind, end)."""
    seen = shared_checkpoint(scanned(docs.select("doc_id", "text")))
    least = thresholds(seen, fdr)
    table_ = F.create_map(*(F.lit(x) for kv in least.items() for x in kv)) if least else None
    good = F.filter("tested", lambda t: t["step"] >= F.coalesce(F.try_element_at(table_, t["stratum"]), F.lit(1 << 30))) if least else F.filter("tested", lambda t: F.lit(False))
    random = F.transform(good, lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))
    return seen.withColumn("random", random).select("doc_id", "n_assign", "n_access", "n_hex", F.size("random").cast("long").alias("n_random"), "base", F.array_sort(F.concat("base", "random")).alias("found"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_random", F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"))
