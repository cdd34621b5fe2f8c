"""Text expressions with one meaning everywhere: Unicode white space, lines, tokens, hashes, names.

Patterns here and in the operators take work in proportion to the text, whatever it holds: repetitions are of single
classes, possessive where nothing can be given back, and begin only where a run begins.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: All white space of Unicode, which trim() and \s of Java don't cover.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_IN = WS[1:-1]  # for use inside a class
WS_CHARS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
BREAK = r"(?:[\n\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029](?:(?<=\r)\n)?+)"  # a class first: no branch is tried at each character
OTHER_BREAK = r"[\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029]"
WORD = r"[\p{L}\p{N}_]"


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    """There is nothing but white space."""
    return ~c.rlike(rf"[^{WS_IN}]")


def rstrip_ws(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    return strip_ws(F.regexp_replace(c, f"{WS}+", " "))


def split_lines(c: Column) -> Column:
    """The lines of a text; a break at the end opens no further line and an empty text has none."""
    bare = F.when(c.endswith("\n"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    lines = F.when(c.rlike(OTHER_BREAK), F.split(F.regexp_replace(c, rf"{BREAK}\z", ""), BREAK, -1)).otherwise(F.split(bare, "\n", -1))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(lines)


def count_tokens(c: Column, chars: int = 4) -> Column:
    """Estimated tokens: a quarter of the characters, at least 1, but 0 for a blank text."""
    return F.when(is_blank(c), F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(c) / chars).cast("int")))


def readable_title(c: Column) -> Column:
    return collapse_ws(F.regexp_replace(c, "[+_]", " "))


def tidy_blank_lines(c: Column) -> Column:
    """No space at the ends of lines, one blank line in a row at most."""
    lines = F.transform(split_lines(c), rstrip_ws)
    return strip_ws(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def fingerprint(c: Column) -> Column:
    """Of a text's content, whatever its case and spacing."""
    return F.sha1(F.lower(collapse_ws(c)))


def chunk_id(source: Column, index: Column) -> Column:
    return F.substring(F.sha1(F.concat(source, F.lit("#"), index.cast("string"))), 1, 16)


def readable_sample(c: Column, size: int = 200) -> Column:
    return F.substring(collapse_ws(c), 1, size)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed form, stripped; Spark has no function for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).strip())


@F.pandas_udf(StringType())
def unaccented(s: pd.Series) -> pd.Series:
    """Compatibility form without combining marks."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def plain_name(c: Column) -> Column:
    """Lower case, without accents, separators as single spaces. Names of ASCII only skip the Python step's work."""
    return strip_ws(F.regexp_replace(F.lower(unaccented(c)), rf"[_\-.{WS_IN}]++", " "))


def replace_each(c: Column, pattern: str, change) -> Column:
    """``change``(match) in place of each match, in one pass."""
    hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(F.split(c, pattern, -1), hits, lambda gap, hit: F.concat(gap, F.when(hit.isNull(), "").otherwise(change(hit))))
    return F.when(c.rlike(pattern), F.array_join(pieces, "")).otherwise(c)
