"""Sources: libraries of files, inventories, lists, manifests, Markdown, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T

INVENTORY = "ruta_relativa string, especialidad string, tipo_contenido string, idioma string, calidad_texto double, paginas int, decision string"
OCR_MANIFEST = "ruta_relativa string, modo string, estado string, ruta_fuente string, segundos double, mensaje string"
CHUNK = "id string, documento string, fuente string, especialidad string, idioma string, ruta_titulos array<string>, pagina_inicio int, pagina_fin int, tokens int, texto string, texto_para_embedding string, unidades_dudosas array<string>"


def scan_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path (below ``root``), size, modified, and content or its sha256; no hidden parts, no README.md."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    path = F.expr(f"url_decode(replace(path, '+', '%2B'))")
    files = files.withColumn("path", F.substring_index(F.substring(path, F.locate(base, path) + len(base), F.length(path)), "?", 1))
    visible = files.filter(~F.col("path").rlike(r"(\A|/)\.") & ~F.col("path").rlike(r"(\A|/)README\.md\z"))
    return visible.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("content") if content else F.sha2("content", 256).alias("sha256"))


def library_root(files: DataFrame) -> str:
    """The folder that holds everything, if there is exactly one and nothing beside it; else the root itself."""
    first = F.split("path", "/")
    found = files.select(F.when(F.size(first) > 1, first[0]).alias("top")).distinct().limit(2).collect()
    return found[0]["top"] + "/" if len(found) == 1 and found[0]["top"] else ""


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and maybe a byte order mark; an empty field is null."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)


def select_keep(inventory: DataFrame) -> DataFrame:
    chosen = inventory.filter(F.lower(T.strip_ws(F.col("decision"))) == "conservar")
    return chosen.withColumns({c: T.nfc(F.col(c)) for c in ("ruta_relativa", "especialidad")}).drop("decision")


def pilot_list(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(T.nfc(F.col("value")).alias("path"))
    return lines.filter((F.col("path") != "") & ~F.col("path").startswith("#")).distinct()


def pilot(selected: DataFrame, wanted: DataFrame) -> DataFrame:
    """The selected documents of a list; one that isn't selected raises."""
    missing = wanted.join(selected, wanted.path == selected.ruta_relativa, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"not in the selection: {[r['path'] for r in missing]}")
    return selected.join(wanted, selected.ruta_relativa == wanted.path, "left_semi")


def ocr_documents(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.col("modo").isin("completar", "rehacer") & F.col("estado").isin("procesado", "ya_existia")).select("ruta_relativa").distinct()


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path and markdown, a row for each file. Spark's readers pass over files without a byte."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown"))


def read_chunks(spark: SparkSession, path: str, sources: DataFrame | None = None) -> DataFrame:
    chunks = spark.read.schema(CHUNK).json(path)
    return chunks if sources is None else chunks.join(sources, T.nfc(chunks.fuente) == sources.path, "left_semi")


def markdown_path(path: Column) -> Column:
    return F.concat(path, F.lit(".md"))


def grids(spark: SparkSession, worlds: list[dict]) -> DataFrame:
    """Grid worlds as nested rows: name, width, height, pits, gold, wumpus."""
    schema = "name string, width int, height int, pits array<array<int>>, gold array<int>, wumpus array<int>, max_steps int"
    return spark.createDataFrame([tuple(w.get(k) for k in ("name", "width", "height", "pits", "gold", "wumpus", "max_steps")) for w in worlds], schema)
