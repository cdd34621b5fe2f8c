"""Measurement units: the catalogue, repairs of misread units, reports of unknown ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T

# Prefixes, units, denominators and misreadings of the domain.
PREFIXES = ("M", "k", "K", "h", "H", "da", "D", "d", "c", "m", "µ", "μ", "u", "n", "p", "f", "")
PREFIXED = (
    "g", "mol", "M", "val", "Eq", "eq", "Osm", "osm", "osmol", "Osmol", "l", "L", "m", "s", "Pa", "bar", "J", "cal",
    "kat", "Bq", "Ci", "Gy", "rd", "A", "V", "W", "Hz", "U", "UI", "IU", "Da",
)
UNPREFIXED = (
    "mmHg", "Torr", "atm", "°C", "°F", "K", "%", "‰", "ppm", "ppb", "ppt", "t", "D", "cc", "min", "h", "d", "día", "dia",
    "gr", "grain", "dr", "oz", "lb", "lbs", "pt", "qt", "gal", "gi", "minim", "gota", "gotas", "gts", "tab", "comp",
    "UFC", "ufc", "mcg", "gm", "grams", "unit", "units", "Units", "mmoles", "PNU", "vez", "veces", "lat", "rev",
    "microl", "CFU", "AU", "EU", "spz", "gram", "Unit", "moles", "cells", "beats", "tomas", "horas", "litros", "ui", "Ui",
)
DENOMINATORS = ("kg", "lb", "l", "L", "dl", "dL", "ml", "mL", "m2", "m²", "h", "min", "día", "dia", "d")
MISREAD = {
    "Ul": ("UI", "OCR: I → l"), "mUl": ("mUI", "OCR: I → l"),
    "rng": ("mg", "OCR: m → rn"), "rnl": ("ml", "OCR: m → rn"), "rnL": ("mL", "OCR: m → rn"), "mrnol": ("mmol", "OCR: m → rn"),
    "rnmol": ("mmol", "OCR: m → rn"), "rnEq": ("mEq", "OCR: m → rn"),
    "mmoi": ("mmol", "OCR: l → i"), "mmo": ("mmol", "OCR: letra perdida"), "mEg": ("mEq", "OCR: q → g"), "meg": ("mcg", "OCR: c → e"),
    "llg": ("µg", "OCR: µ mal leída"), "IJg": ("µg", "OCR: µ mal leída"), "jig": ("µg", "OCR: µ mal leída"), "jUg": ("µg", "OCR: µ mal leída"),
    "jg": ("µg", "OCR: µ mal leída"), "xg": ("µg", "OCR: µ mal leída"), "wg": ("µg", "OCR: µ mal leída"), "Ug": ("µg", "OCR: µ mal leída"),
    "prg": ("µg", "OCR: µ mal leída"), "pcg": ("µg", "OCR: µ mal leída"), "yg": ("µg", "OCR: µ mal leída"),
}
BEFORE, AFTER = 30, 10  # characters around an unknown unit
DOSING_WORDS = r"IV|IM|SC|VO|PO|IO|CRI|bolo|bolus|dosis|dose|cada|q\p{Nd}{1,2}h|infusi[oó]n|infusion"

#: What stands before a dose's unit, from the beginning of a run of digits, marks and white space of any script to its
#: last digit; then white space and at most one bar.
RUN = rf"\p{{Nd}}.,\-{T.WS_IN}"
QUANTITY = rf"(?<![{RUN}])([{RUN}]*\p{{Nd}}{T.WS}*+\|?+{T.WS}*+)"
COMPOUND = (
    rf"(\p{{Nd}}[|{T.WS_IN}]*+)(1[a-zA-Z]{{1,2}}|[A-Za-zµμ°%‰][A-Za-zµμ²]{{0,5}})/("
    + "|".join(sorted(DENOMINATORS, key=len, reverse=True))
    + r")(?![A-Za-z])"
)
EDGE_BEFORE, EDGE_AFTER = rf"(?<!{T.WORD})", rf"(?!{T.WORD})"
DOSING = rf"(?iu)(?:{EDGE_BEFORE}(?:{DOSING_WORDS}){EDGE_AFTER}|/(?:h|min){EDGE_AFTER})"


def catalogue(spark: SparkSession) -> DataFrame:
    """unit: all known units, the two signs for micro as one."""
    rows = lambda xs, name: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    made = rows(PREFIXES, "p").join(rows(PREFIXED, "b")).select(F.concat("p", "b").alias("unit"))  # 17 x 31 literals
    return made.unionAll(rows(UNPREFIXED, "unit")).select(one_micro(F.col("unit")).alias("unit")).distinct()


def one_micro(c: Column) -> Column:
    return F.translate(c, "μ", "µ")


KNOWN = sorted({(p + b).replace("μ", "µ") for p in PREFIXES for b in PREFIXED} | set(UNPREFIXED))


def is_known(unit: Column) -> Column:
    """In the catalogue, or all capitals and there in lower case."""
    own = one_micro(unit)
    capitals = (F.length(own) > 1) & (own == F.upper(own)) & (own != F.lower(own))
    return own.isin(*KNOWN) | (capitals & F.lower(own).isin(*sorted({u.lower() for u in KNOWN})))


def has_dosing_context(line: Column) -> Column:
    return line.rlike(DOSING)


def micro_rule(written: str, denominator: str) -> str:
    return QUANTITY + f"({written})(?=({denominator}))"


UG = micro_rule("ug", "/[A-Za-z²]+")
GREEK = micro_rule("μg", "/[A-Za-z²]+")
OCR_MICRO = micro_rule("pg|1g", "/kg")


def unit_of(match: Column) -> Column:
    return F.regexp_extract(match, COMPOUND, 2)


def misread_map() -> Column:
    return F.create_map(*(F.lit(x) for k, (real, _) in MISREAD.items() for x in (k, real)))


def rule_map() -> Column:
    return F.create_map(*(F.lit(x) for k, (_, rule) in MISREAD.items() for x in (k, rule)))


def repaired(match: Column) -> Column:
    """A compound unit with the real unit in place of a misread one."""
    real = F.try_element_at(misread_map(), unit_of(match))
    parts = [F.regexp_extract(match, COMPOUND, k) for k in (1, 3)]
    return F.when(real.isNull(), match).otherwise(F.concat(parts[0], real, F.lit("/"), parts[1]))


def repair_misread(text: Column) -> Column:
    """Each match once: a chain of replacements would read its own results."""
    return T.replace_each(text, COMPOUND, repaired)


def misread_log(text: Column) -> Column:
    """array<struct<original, replacement, rule>> of the repairs."""
    hits = F.filter(F.regexp_extract_all(text, F.lit(COMPOUND), F.lit(0)), lambda m: F.try_element_at(misread_map(), unit_of(m)).isNotNull())
    return F.transform(hits, lambda m: F.struct(m.alias("original"), repaired(m).alias("replacement"), F.try_element_at(rule_map(), unit_of(m)).alias("rule")))


def micro_log(text: Column, pattern: str, rule: str) -> Column:
    """Repairs of one micro rule, with the denominator that the rule only looks at."""
    denominator = pattern[pattern.rindex("(?=(") + 4 : -2]
    whole = pattern[: pattern.rindex("(?=(")] + f"({denominator})"
    hits = F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(0)), lambda m: F.regexp_replace(m, rf"\A[^\p{{Nd}}]++", ""))
    return F.transform(hits, lambda m: F.struct(m.alias("original"), F.regexp_replace(m, whole, "$1µg$3").alias("replacement"), F.lit(rule).alias("rule")))


def unknown_units(text: Column) -> Column:
    """Contexts of compound units that the catalogue doesn't have: a unit with BEFORE characters before it and AFTER
    characters behind it, which come from the ends and beginnings of the pieces around it. A piece with a unit has four
    characters at least, so a few pieces are enough."""
    found = F.struct(F.split(text, COMPOUND, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(COMPOUND), F.lit(0)).alias("hits"))
    joined = lambda p: F.struct(p["gaps"].alias("gaps"), p["hits"].alias("hits"), F.zip_with(p["gaps"], p["hits"], lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit("")))).alias("pieces"))
    ends = lambda p: F.struct(p["gaps"].alias("gaps"), p["hits"].alias("hits"), F.transform(p["pieces"], lambda x: F.right(x, F.lit(BEFORE))).alias("tails"), F.transform(p["pieces"], lambda x: F.left(x, F.lit(AFTER))).alias("heads"))
    shared = F.transform(F.transform(F.array(found), joined), ends)  # each step once, as the next ones read it several times

    def around(p: Column, hit: Column, i: Column) -> Column:
        near = lambda name, steps: [F.coalesce(F.get(p[name], i + k), F.lit("")) for k in steps]
        before = F.right(F.concat(*near("tails", range(-(BEFORE // 4) - 1, 0)), *near("gaps", [0])), F.lit(BEFORE))
        after = F.left(F.concat(*near("heads", range(1, AFTER // 4 + 2))), F.lit(AFTER))
        return F.when(~is_known(unit_of(hit)), T.collapse_ws(F.concat(before, hit, after)))

    told = F.transform(shared, lambda p: F.array_compact(F.transform(p["hits"], lambda hit, i: around(p, hit, i))))[0]
    return F.when(text.rlike(COMPOUND), told).otherwise(F.array().cast("array<string>"))


def has_unknown_units(text: Column) -> Column:
    """Whether ``unknown_units`` finds any."""
    return F.exists(F.regexp_extract_all(text, F.lit(COMPOUND), F.lit(2)), lambda unit: ~is_known(unit))
