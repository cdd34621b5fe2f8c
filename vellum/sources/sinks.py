"""Sinks: the inventory and its report, manifests, chunks, resumable loads with a ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import batching
from vellum.operators import inventory as I

# Titles and columns of the report and the inventory.
REPORT = "# Resumen de la clasificación del corpus"
COUNTED = (("Por recomendación", "recommendation"), ("Por tipo de contenido", "content_type"), ("Por idioma", "language"))
INVENTORY_COLUMNS = {
    "ruta_relativa": "path", "especialidad": "specialty", "extension": "ext", "tamano_mb": "size", "paginas": "pages", "tipo_contenido": "content_type",
    "caracteres_por_pagina": "mean_chars", "proporcion_paginas_con_texto": "text_share", "idioma": "language", "calidad_texto": "text_quality",
    "duplicado_de": "duplicate_of", "senales": "signals", "recomendacion": "recommendation", "decision": "recommendation", "muestra_texto": "sample",
    "error": "error", "sha256": "sha256",
}
BYTE_ORDER_MARK = "\ufeff"


def write_csv(df: DataFrame, path: str, joined: tuple[str, ...] = (), mark: bool = False) -> None:
    """CSV with a header; arrays in ``joined`` with | between; with ``mark`` a byte order mark begins each file. The
    committer publishes whole results only."""
    out = df.withColumns({c: F.array_join(c, "|") for c in joined})
    if mark:
        out = out.withColumnRenamed(out.columns[0], BYTE_ORDER_MARK + out.columns[0])
    out.write.mode("overwrite").csv(path, header=True)


def inventory_rows(inventory: DataFrame) -> DataFrame:
    """The inventory's columns as text; the decision begins as the recommendation. Columns that aren't there are empty."""

    def text(own: str):
        if own not in inventory.columns:
            return F.lit("")
        value = F.col(own)
        if own == "size":
            return F.format_string("%.1f", value / 1_048_576)
        return F.coalesce(F.array_join(value, "|") if own == "signals" else value.cast("string"), F.lit(""))

    return inventory.select(*(text(own).alias(name) for name, own in INVENTORY_COLUMNS.items()))


def write_inventory(inventory: DataFrame, path: str) -> None:
    write_csv(inventory_rows(inventory), path, mark=True)


def report_lines(inventory: DataFrame, order: str) -> DataFrame:
    """The report in Markdown: section, part, rank and name, which order it, and line. Totals, three counts (most files
    first, ties by first appearance in ``order``), specialties, and the files to discard and to look at, however many."""

    def head(section: int, *lines: str) -> DataFrame:
        return inventory.sparkSession.createDataFrame([(section, 0, n, "", x) for n, x in enumerate(lines)], "section int, part int, rank long, name string, line string")

    def titled(section: int, title: str, *names: str) -> DataFrame:
        return head(section, title, "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names))

    def row(*cells) -> F.Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("")) for c in cells)), F.lit(" |"))

    def body(df: DataFrame, section: int, rank, name, line, part: int = 1) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.lit(part).alias("part"), rank.cast("long").alias("rank"), name.alias("name"), line.alias("line"))

    def ended(section: int) -> DataFrame:
        return head(section, "").withColumn("part", F.lit(2))

    total = inventory.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), (F.coalesce(F.sum("size"), F.lit(0)) / 1_073_741_824).alias("gb"))
    lines = F.array(F.concat(F.lit("- **Archivos analizados:** "), F.col("files").cast("string")), F.concat(F.lit("- **Páginas (PDF):** "), F.format_number("pages", 0)), F.format_string("- **Tamaño total:** %.1f GB", "gb"))
    out = [head(0, REPORT, ""), body(total.select(F.posexplode(lines).alias("n", "line")), 0, F.col("n"), F.lit(""), F.col("line")), ended(0)]
    for section, (title, field) in enumerate(COUNTED, 1):
        counts = inventory.groupBy(field).agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("pages", F.lit(0))).alias("pages"), F.min(order).alias("first"))
        place = counts.select("*", F.struct(-F.col("files"), "first").alias("o"))
        ranked = I.numbered(place, "o", "n")
        out += [titled(section, f"## {title}", "Valor", "Archivos", "Páginas"), body(ranked, section, F.col("n"), F.lit(""), row(F.col(field), F.col("files"), F.col("pages"))), ended(section)]
    names = ("Especialidad", "Archivos", "Páginas", "Conservar", "Revisar", "Descartar")
    own = I.by_specialty(inventory)
    out += [titled(4, "## Por especialidad", *names), body(own, 4, F.lit(0), F.col("specialty"), row(*map(F.col, ("specialty", "files", "pages", "conservar", "revisar", "descartar")))), ended(4)]
    for section, kind in ((5, "descartar"), (6, "revisar")):
        chosen = inventory.filter(F.col("recommendation") == kind)
        title = chosen.agg(F.count(F.lit(1)).alias("n")).select(F.format_string(f"## Archivos a {kind} (%d)", "n").alias("line"))
        cells = row(F.concat(F.lit("`"), "path", F.lit("`")), F.array_join("signals", ", "), F.col("content_type"), F.col("pages"))
        out += [body(title, section, F.lit(0), F.lit(""), F.col("line"), part=-1), titled(section, "", "Archivo", "Señales", "Tipo", "Páginas").filter("rank > 0"), body(chosen, section, F.lit(0), F.col(order).cast("string"), cells), ended(section)]
    return reduce(DataFrame.unionByName, out)


def write_report(inventory: DataFrame, path: str, order: str) -> None:
    """The report as text files, whose names are in its order."""
    report_lines(inventory, order).orderBy("section", "part", "rank", "name").select("line").write.mode("overwrite").text(path)


#: Columns of chunks in files, by their names in tables.
CHUNK_NAMES = {
    "id": "id", "title": "documento", "source": "fuente", "specialty": "especialidad", "language": "idioma", "path": "ruta_titulos", "first_page": "pagina_inicio", "last_page": "pagina_fin",
    "tokens": "tokens", "text": "texto", "embed_text": "texto_para_embedding", "dubious_units": "unidades_dudosas",
}


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Lines of JSON in place of what ``path`` held, as ``files.read_chunks`` reads them: the columns of
    ``chunk_documents`` by their names in files; nulls are left out, other columns aren't written."""
    chunks.select(*(F.col(own).alias(name) for own, name in CHUNK_NAMES.items())).write.mode("overwrite").json(path)


def load_batch(new: DataFrame, batch_id: int, store: str, ledger: str, model: str) -> int:
    """Appends the rows that the store doesn't have, then the ledger's row; both are safe to repeat: rows by id, the
    ledger by the batch. Usable as the body of foreachBatch."""
    spark = new.sparkSession
    found = lambda path, schema: spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    stored = found(store, new.schema)
    fresh = batching.pending(new.dropDuplicates(["id"]), stored)
    fresh.write.mode("append").parquet(store)
    rows = found(ledger, "batch long, model string, chunks long, tokens long")
    if rows.filter(F.col("batch") == batch_id).isEmpty():
        own = new.agg(F.lit(batch_id).cast("long").alias("batch"), F.lit(model).alias("model"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))
        own.write.mode("append").parquet(ledger)
    return spark.read.schema(new.schema).parquet(store).count() if exists(spark, store) else 0


def exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def create_tables(spark) -> None:
    """The store's tables, for sessions that keep a catalogue."""
    spark.sql("CREATE TABLE IF NOT EXISTS chunks (id STRING, documento STRING, fuente STRING, especialidad STRING, idioma STRING, ruta_titulos ARRAY<STRING>, pagina_inicio INT, pagina_fin INT, tokens INT, texto STRING, unidades_dudosas ARRAY<STRING>, embedding ARRAY<FLOAT>, creado TIMESTAMP) USING parquet")
    spark.sql("CREATE TABLE IF NOT EXISTS embedding_use (batch BIGINT, model STRING, chunks BIGINT, tokens BIGINT) USING parquet")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small aggregate as a Markdown table; one of over ``most`` rows raises."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them as a table of their own")
    out = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(out + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
