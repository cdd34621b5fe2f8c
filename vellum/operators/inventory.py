"""Corpus inventory: names, content type, language, text quality, duplicates, signals, recommendation, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.tables import free_name, in_ranges

# The domain's thresholds, extensions and word lists.
MIN_PAGE_CHARS = 200
TEXT_SHARE = 0.8
SCANNED_SHARE = 0.2
MIN_LANGUAGE_WORDS = 20
LANGUAGE_SHARE = 0.8
MIN_QUALITY = 0.7
FEW_PAGES = 2
HASH_LENGTH = 16
SAMPLED_PAGES = 12
PDF = (".pdf",)
DOCUMENT = (".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".odt", ".rtf", ".epub", ".html")
ARCHIVE = (".zip", ".rar", ".7z")
NOISE_WORDS = ("certificado", "constancia", "convocatoria", "calendario", "peluqueria", "estetica canina", "factura", "recibo", "curriculum", "inscripcion", "horario")
GENERIC_NAMES = ("doc", "documento", "document", "archivo", "file", "descarga", "download", "scan")
SPANISH = (
    "de la que el en los del las por con una para es se su al lo como más pero sus le ya fue este ha porque esta son "
    "entre cuando muy sin sobre también hasta hay donde desde todo nos durante todos uno les ni contra otros ese eso "
    "ante ellos esto antes algunos unos otro otras otra tanto esa estos mucho nada muchos cual poco ella estas algunas "
    "puede pueden así debe animales perro gato"
).split()
ENGLISH = (
    "the of and to in is that for it with as was on are be by this from at or an which have not has but were their its "
    "can been these also more may other than such into some only when there they all between after both each most used "
    "should animals dog cat"
).split()
LANGUAGE_WORD = "[a-záéíóúüñ]+"
VALID_TOKEN = r"\A([A-Za-zÁÉÍÓÚÜÑáéíóúüñ]{2,25}|\p{Nd}+([.,]\p{Nd}+)?)\z"
PUNCTUATION = ".,;:()[]{}\"'¿?¡!«»-–—%/"
COPY_SUFFIX = rf"(?<!{T.WS}){T.WS}*+\(\p{{Nd}}++\)\z"
NO_FOLDER = "(sin carpeta)"


def sample_indices(pages: Column, wanted: int = SAMPLED_PAGES) -> Column:
    """At most ``wanted`` page numbers from 0, evenly spread, halves rounded to even."""
    few = F.when(pages > 0, F.sequence(F.lit(0), pages.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.rint(i * ((pages - 1) / (wanted - 1))).cast("int"))
    return F.when(pages <= wanted, few).otherwise(F.array_sort(F.array_distinct(spread)))


def specialty(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit(NO_FOLDER))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^/.]+)\z", 1))


def route(ext: Column) -> Column:
    return F.when(ext.isin(*PDF), "pdf").when(ext.isin(*DOCUMENT), "documento").when(ext.isin(*ARCHIVE), "comprimido").otherwise("no_soportado")


def is_noise_name(plain: Column) -> Column:
    """``plain``: the name in the form of ``plain_name``."""
    found = F.lit(False)
    for word in NOISE_WORDS:
        found = found | plain.contains(word)
    return found


def without_copy_suffix(name: Column) -> Column:
    return T.strip_ws(F.regexp_replace(name, COPY_SUFFIX, ""))


def is_nondescript(name: Column, plain: Column) -> Column:
    """``plain``: the name without its copy suffix, in the form of ``plain_name``."""
    base = without_copy_suffix(name)
    hashlike = (F.length(base) >= HASH_LENGTH) & base.rlike(r"\A[\p{L}\p{N}]+\z") & base.rlike(r"\p{Nd}") & base.rlike(r"\p{L}")
    return (base == "") | base.rlike(r"\A\p{Nd}+\z") | plain.isin(*GENERIC_NAMES) | hashlike


def language_words(text: Column) -> tuple[Column, Column]:
    words = F.regexp_extract_all(F.lower(text), F.lit(LANGUAGE_WORD), F.lit(0))
    count = lambda own: F.size(F.filter(words, lambda w: w.isin(*own)))
    return count(SPANISH), count(ENGLISH)


def language_of(spanish: Column, english: Column) -> Column:
    total = spanish + english
    return (
        F.when(total < MIN_LANGUAGE_WORDS, "desconocido")
        .when(spanish / total >= LANGUAGE_SHARE, "es")
        .when(english / total >= LANGUAGE_SHARE, "en")
        .otherwise("mixto")
    )


def detect_language(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds spanish_words, english_words and language."""
    spanish, english = language_words(F.col(text))
    df = df.withColumns({"spanish_words": spanish, "english_words": english})
    return df.withColumn("language", language_of(F.col("spanish_words"), F.col("english_words")))


def text_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds valid_tokens, tokens and text_quality, which is null where there is no token."""
    marks = "[" + "".join("\\" + c if c in "[]-\\^&" else c for c in PUNCTUATION) + "]"
    tokens = F.transform(F.split(F.col(text), f"{T.WS}+", -1), lambda t: F.regexp_replace(t, rf"\A{marks}++|(?<!{marks}){marks}++\z", ""))
    df = df.withColumn("_tokens", F.filter(tokens, lambda t: t != ""))
    df = df.withColumns({"tokens": F.size("_tokens"), "valid_tokens": F.size(F.filter("_tokens", lambda t: t.rlike(VALID_TOKEN)))}).drop("_tokens")
    return df.withColumn("text_quality", F.try_divide(F.col("valid_tokens"), F.col("tokens")))


def content_type(pages: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """doc, content_type, mean_chars, text_share from one row for each sampled page."""
    size = F.length(T.strip_ws(F.col(text)))
    out = pages.groupBy(doc).agg(F.avg(size).alias("mean_chars"), F.avg((size >= MIN_PAGE_CHARS).cast("double")).alias("text_share"))
    return out.withColumn("content_type", F.when(F.col("text_share") >= TEXT_SHARE, "texto").when(F.col("text_share") <= SCANNED_SHARE, "escaneado").otherwise("mixto"))


def sample_text(pages: DataFrame, doc: str = "doc", order: str = "page", text: str = "text") -> DataFrame:
    """doc, sample: 200 characters of the page with most text, the first of several. Only the choice is shuffled in
    whole: partial aggregates keep one page a task and document."""
    best = F.min_by(T.readable_sample(F.col(text)), F.struct((-F.length(T.strip_ws(F.col(text)))).alias("size"), F.col(order)))
    return pages.groupBy(doc).agg(best.alias("sample"))


def signals(kind: Column, noise: Column, nondescript: Column, content: Column, quality: Column, pages: Column, error: Column) -> Column:
    """Signals of one file before duplicates are known; ``kind`` is ``route``'s value."""
    readable = (kind == "pdf") & error.isNull()
    return F.array_compact(
        F.array(
            F.when(noise, F.lit("nombre_ruido")),
            F.when(nondescript, F.lit("nombre_no_descriptivo")),
            F.when(kind == "comprimido", F.lit("archivo_comprimido")),
            F.when(kind == "no_soportado", F.lit("formato_no_soportado")),
            F.when((kind == "pdf") & error.isNotNull(), F.lit("error_lectura")),
            F.when(readable & (content != "escaneado") & (quality < MIN_QUALITY), F.lit("texto_baja_calidad")),
            F.when(readable & (pages <= FEW_PAGES), F.lit("pocas_paginas")),
        )
    )


DISCARD = ("nombre_ruido", "duplicado", "formato_no_soportado")


def recommend(found: Column) -> Column:
    return F.when(F.arrays_overlap(found, F.array(*map(F.lit, DISCARD))), "descartar").when(F.size(found) > 0, "revisar").otherwise("conservar")


def mark_duplicates(files: DataFrame, path: str = "path", stem: str = "stem", sha: str = "sha256") -> DataFrame:
    """Adds duplicate_of: null for the file of each content that stays, else the path of that file.

    The one that stays has no copy suffix, then the shortest path, then the least one. The election is a min of a
    struct, which partial aggregates make before the shuffle, so a content of very many copies is no hot group; the
    winners are joined back, which adaptive execution can split. A file without a hash duplicates nothing.
    """
    rank = F.struct(F.col(stem).rlike(COPY_SUFFIX).alias("copy"), F.length(path).alias("size"), F.col(path).alias("path"))
    elected = files.filter(F.col(sha).isNotNull()).groupBy(sha).agg(F.min(rank).alias("_best"))
    out = files.join(elected, sha, "left")
    return out.withColumn("duplicate_of", F.when(F.col(path) != F.col("_best.path"), F.col("_best.path"))).drop("_best")


def totals(inventory: DataFrame) -> DataFrame:
    gb = F.sum("size") / 1_073_741_824
    return inventory.agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("pages", F.lit(0))).alias("pages"), F.round(gb, 6).alias("gb"))


def count_by(inventory: DataFrame, field: str, order: str) -> DataFrame:
    """Files and pages for each value, most files first, ties by first appearance."""
    out = inventory.groupBy(field).agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("pages", F.lit(0))).alias("pages"), F.min(order).alias("first_seen"))
    return out.orderBy(F.desc("files"), "first_seen")


def summary(inventory: DataFrame, *fields: str) -> DataFrame:
    """Files and pages by each of the fields, in one pass over the inventory."""
    view = inventory.select(*fields, F.coalesce("pages", F.lit(0)).alias("pages"))
    sets = [[F.col(f)] for f in fields]
    out = view.groupingSets(sets, *map(F.col, fields)).agg(F.count(F.lit(1)).alias("files"), F.sum("pages").alias("pages"), *(F.grouping(f).alias(f"_{f}") for f in fields))
    field, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f in fields:
        field, value = F.when(F.col(f"_{f}") == 0, f).otherwise(field), F.when(F.col(f"_{f}") == 0, F.col(f)).otherwise(value)
    return out.select(field.alias("field"), value.alias("value"), "files", "pages")


def by_specialty(inventory: DataFrame) -> DataFrame:
    count = {d: F.count_if(F.col("recommendation") == d).alias(d) for d in ("conservar", "revisar", "descartar")}
    return inventory.groupBy("specialty").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("pages", F.lit(0))).alias("pages"), *count.values()).orderBy("specialty")


def listing(inventory: DataFrame, recommendation: str) -> DataFrame:
    return inventory.filter(F.col("recommendation") == recommendation).select("path", "specialty", F.array_join("signals", ", ").alias("signals")).orderBy("path")


def ocr_mode(kind: Column, quality: Column) -> Column:
    return F.when(kind == "documento", "no_aplica").when(quality < MIN_QUALITY, "rehacer").when(kind.isin("escaneado", "mixto"), "completar").otherwise("no_necesario")


def numbered(df: DataFrame, order: str, name: str = "ord") -> DataFrame:
    """Position in ``order`` without a global window: ranges written once, then counts before each range. Rows of equal
    ``order`` come in any order. A column of this name is replaced."""
    df = df.drop(name) if name != order else df
    part, at, before = (free_name(df, x) for x in ("_part", "_at", "_before"))
    placed = in_ranges(df, order, part=part, at=at)
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))  # a row for each range
    start = F.coalesce(before, F.raise_error(F.lit("a range without a count")).cast("long"))
    return placed.join(F.broadcast(starts), part, "left").withColumn(name, start + F.col(at)).drop(part, at, before)
