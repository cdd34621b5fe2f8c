"""From selected files to cleaned chunks: text of pages through a port, front matter, manifests, and the chain of steps.

A port is a Python callable that reads one file; it runs in Arrow batches where the file's bytes are, and what it raises
becomes the message of the file's row. Outputs that are there already are not made again: steps take the table of them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import chunking as K
from vellum.operators import cleaning as C
from vellum.operators import inventory as I

# States and messages of the manifests.
SKIPPED, DONE, THERE, FAILED, CONVERTED = "omitido", "procesado", "ya_existia", "error", "convertido"
NOT_IN_MANIFEST = "No está en el manifiesto del OCR: corre primero el paso 'ocr'"
OCR_COLUMNS = ("ruta_relativa", "modo", "estado", "ruta_fuente", "segundos", "mensaje")
CONVERSION_COLUMNS = ("ruta_relativa", "estado", "ruta_markdown", "paginas", "paginas_vacias", "paginas_texto_plano", "caracteres", "segundos", "mensaje")
PAGES = "path string, pages array<string>, plain int, seconds double, error string"


def json_value(value: Column) -> Column:
    """A value as JSON, out of an object that holds nothing else."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def front_matter(fields: dict[str, Column]) -> Column:
    """The header that ``cleaning.split_header`` and ``chunking.header_fields`` read: a line for each field, its value in JSON."""
    lines = [F.concat(F.lit(f"{name}: "), F.when(value.isNull(), "null").otherwise(json_value(value))) for name, value in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"))


def joined_pages(texts: Column) -> Column:
    """Pages under their marks, from 1."""
    page = lambda text, i: T.rstrip_ws(F.concat(F.format_string(C.PAGE_MARK, (i + 1).cast("string")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    return F.concat(F.array_join(F.transform(texts, page), "\n\n"), F.lit("\n"))


def page_texts(files: DataFrame, parser: Callable[[bytes], list[str]], fallback: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """PAGES' columns from files (path, content): ``parser`` gives a file's pages, null or empty where it can't, and
    ``fallback`` the plain text of such a page (bytes, place). A file that can't be read is a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a file at a time
                path, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                began, pages, plain, error = time.perf_counter(), None, 0, None
                try:
                    pages = [(p or "").strip() for p in parser(content)]
                    for n, p in enumerate(pages):
                        if not p and fallback:
                            pages[n] = (fallback(content, n) or "").strip()
                            plain += bool(pages[n])
                except Exception as e:  # whatever the port raises is the file's message
                    pages, error = None, str(e) or type(e).__name__
                yield pa.record_batch([pa.array([path]), pa.array([pages], pa.list_(pa.string())), pa.array([plain], pa.int32()), pa.array([round(time.perf_counter() - began, 2)]), pa.array([error], pa.string())], names=["path", "pages", "plain", "seconds", "error"])

    return files.select("path", "content").mapInArrow(run, PAGES)


def ocr_manifest(selected: DataFrame, processed: DataFrame, existing: DataFrame, folder: str) -> DataFrame:
    """OCR_COLUMNS from the selection (ruta_relativa, tipo_contenido, calidad_texto), what the port did (path, seconds,
    error) and the outputs that were there (path). Files that need none are skipped and keep their source."""
    mode = I.ocr_mode(F.col("tipo_contenido"), F.col("calidad_texto"))
    done = processed.select(F.col("path").alias("ruta_relativa"), "seconds", "error", F.lit(True).alias("ran"))
    there = existing.select(F.col("path").alias("ruta_relativa"), F.lit(True).alias("there")).distinct()
    df = selected.withColumn("modo", mode).join(there, "ruta_relativa", "left").join(done, "ruta_relativa", "left")
    state = F.when(F.col("modo").isin("no_aplica", "no_necesario"), SKIPPED).when(F.col("there"), THERE).when(F.col("ran") & F.col("error").isNull(), DONE).otherwise(FAILED)
    source = F.when(state.isin(DONE, THERE), F.concat(F.lit(folder.rstrip("/") + "/"), "ruta_relativa")).otherwise(F.col("ruta_relativa"))
    return df.select("ruta_relativa", "modo", state.alias("estado"), source.alias("ruta_fuente"), F.coalesce("seconds", F.lit(0.0)).alias("segundos"), F.coalesce("error", F.lit("")).alias("mensaje"))


def to_ocr(selected: DataFrame, existing: DataFrame) -> DataFrame:
    """The selected files that need OCR and have no output yet."""
    mode = I.ocr_mode(F.col("tipo_contenido"), F.col("calidad_texto"))
    wanted = selected.filter(mode.isin("completar", "rehacer"))
    return wanted.join(existing.select(F.col("path").alias("ruta_relativa")), "ruta_relativa", "left_anti")


def to_convert(selected: DataFrame, manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """The selected files with a source in the OCR manifest and no Markdown yet: with ruta_fuente."""
    known = manifest.select("ruta_relativa", "ruta_fuente")
    return selected.join(known, "ruta_relativa").join(existing.select(F.col("path").alias("ruta_relativa")), "ruta_relativa", "left_anti")


def converted(selected: DataFrame, texts: DataFrame) -> DataFrame:
    """ruta_relativa, markdown, pages, empty, plain, seconds and error of the files that ``page_texts`` read, whose
    path is ruta_relativa. Office documents (tipo_contenido documento) have no page marks."""
    df = selected.join(texts.withColumnRenamed("path", "ruta_relativa"), "ruta_relativa")
    paged = F.col("tipo_contenido") != "documento"
    stem = F.regexp_replace(F.element_at(F.split("ruta_relativa", "/"), -1), r"(?<=.)\.[^.]*+\z", "")
    count = F.when(paged, F.size("pages"))
    header = front_matter({"documento": stem, "especialidad": F.col("especialidad"), "idioma": F.col("idioma"), "fuente": F.col("ruta_relativa"), "paginas": count})
    body = F.when(paged, joined_pages(F.col("pages"))).otherwise(F.concat(T.strip_ws(F.array_join("pages", "\n")), F.lit("\n")))
    empty = F.when(paged, F.size(F.filter("pages", lambda p: p == ""))).otherwise(0)
    return df.select("ruta_relativa", F.when(F.col("error").isNull(), F.concat(header, body)).alias("markdown"), F.when(F.col("error").isNull(), count).alias("pages"), empty.alias("empty"), "plain", F.length(body).alias("chars"), "seconds", "error")


def conversion_manifest(selected: DataFrame, manifest: DataFrame, made: DataFrame, existing: DataFrame) -> DataFrame:
    """CONVERSION_COLUMNS, a row for each selected file."""
    known = manifest.select("ruta_relativa", F.lit(True).alias("known")).distinct()
    there = existing.select(F.col("path").alias("ruta_relativa"), F.lit(True).alias("there")).distinct()
    df = selected.select("ruta_relativa").join(known, "ruta_relativa", "left").join(there, "ruta_relativa", "left").join(made.withColumn("made", F.lit(True)), "ruta_relativa", "left")
    state = F.when(F.col("known").isNull(), FAILED).when(F.col("there"), THERE).when(F.col("made") & F.col("error").isNull(), CONVERTED).otherwise(FAILED)
    message = F.when(F.col("known").isNull(), NOT_IN_MANIFEST).otherwise(F.coalesce("error", F.lit("")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    path = F.when(state.isin(THERE, CONVERTED), F.concat("ruta_relativa", F.lit(".md"))).otherwise("")
    return df.select("ruta_relativa", state.alias("estado"), path.alias("ruta_markdown"), "pages", zero("empty").alias("paginas_vacias"), zero("plain").alias("paginas_texto_plano"), zero("chars").alias("caracteres"), F.coalesce("seconds", F.lit(0.0)).alias("segundos"), message.alias("mensaje")).withColumnRenamed("pages", "paginas")


def paired(chunks: DataFrame, vectors: DataFrame, *place: str) -> DataFrame:
    """Chunks with their vectors by ``place`` (batch and position); a chunk without a vector, or a vector without a
    chunk, raises, as two lists of different lengths do."""
    both = chunks.withColumn("_chunk", F.lit(True)).join(vectors.withColumn("_vector", F.lit(True)), list(place), "full")
    whole = F.coalesce("_chunk", F.lit(False)) & F.coalesce("_vector", F.lit(False))
    return both.filter(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("chunks and vectors don't pair one to one")).cast("boolean"))).drop("_chunk", "_vector")


def ingest(selected: DataFrame, manifest: DataFrame, files: DataFrame, existing: DataFrame, parser: Callable[[bytes], list[str]], fallback: Callable[[bytes, int], str] | None = None) -> dict[str, DataFrame]:
    """The chain: conversion of what isn't there yet, cleaning, chunks without repeated ones; with manifest and log.

    ``selected`` has ruta_relativa, especialidad, tipo_contenido and idioma; ``manifest`` is the OCR manifest; ``files``
    has path and content of the sources in it; ``existing`` has path and markdown of earlier conversions. Documents are
    numbered by path in a table that goes with the results (``documents``: doc_id, ruta_relativa)."""
    wanted = to_convert(selected, manifest, existing)
    sources = wanted.select(F.col("ruta_fuente").alias("path"), "ruta_relativa").join(files, "path").select(F.col("ruta_relativa").alias("path"), "content")
    made = converted(selected, page_texts(sources, parser, fallback))
    whole = made.filter("error is null").select("ruta_relativa", "markdown").unionByName(existing.select(F.col("path").alias("ruta_relativa"), "markdown"))
    redone = manifest.filter(F.col("modo").isin("completar", "rehacer") & F.col("estado").isin(DONE, THERE)).select("ruta_relativa", F.lit(True).alias("with_ocr"))
    documents = I.numbered(selected.select("ruta_relativa").distinct(), "ruta_relativa", "doc_id")
    docs = documents.join(whole, "ruta_relativa", "left").join(redone, "ruta_relativa", "left")
    cleaned, log = C.clean_documents(docs.select("doc_id", "markdown", "with_ocr"))
    chunks = K.chunk_documents(cleaned.filter("markdown is not null").select("doc_id", "markdown"))
    return {
        "documents": documents, "conversion": conversion_manifest(selected, manifest, made, existing), "markdown": whole, "cleaned": cleaned, "log": log,
        "cleaning": C.manifest(log), "chunks": chunks, "kept": K.keep_first(chunks, "doc_id", "chunk_no"),
    }
