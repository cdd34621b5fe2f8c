"""Chunks' columns and summary against plain versions, chunks and Markdown written and read, centres painted."""

import hashlib
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vellum.operators import chunking as K
from vellum.operators import clustering as M
from vellum.plans import documents as D
from vellum.plans.cleaning import markdown
from vellum.sources import files, sinks


@pytest.fixture(scope="module")
def chunks(spark, sf_dir):
    out = K.chunk_documents(markdown(spark, sf_dir)).cache()
    yield out
    out.unpersist()


def estimate(text):
    return max(1, len(text) // 4) if text.strip() else 0


def test_columns(spark, sf_dir, chunks):
    headers = {}
    for r in markdown(spark, sf_dir).collect():
        head = r["markdown"].split("\n---\n", 1)[0] if r["markdown"].startswith("---\n") else ""
        pairs = [line.split(":", 1) for line in head.split("\n") if ":" in line]
        values = {k.strip(): v.strip() for k, v in pairs}
        headers[r["doc_id"]] = {k: json.loads(v) if v.startswith('"') else "" if v == "null" else v for k, v in values.items()}
    folded = {(r["doc_id"], r["chunk_no"]): r for r in K.chunk_fold(K.blocks(markdown(spark, sf_dir))).collect()}
    rows = chunks.collect()
    assert {(r["doc_id"], r["chunk_no"]) for r in rows} == {k for k, r in folded.items() if estimate(r["text"]) >= K.MIN_CHUNK}
    for r in rows:
        own, head = folded[r["doc_id"], r["chunk_no"]], headers[r["doc_id"]]
        source = head.get("fuente", "")
        assert r["id"] == hashlib.sha1(f"{source}#{r['chunk_no']}".encode()).hexdigest()[:16] and r["source"] == source
        stem = source.rsplit("/", 1)[-1]
        stem = stem[: stem.rindex(".")] if "." in stem[1:] else stem
        title = " ".join((head.get("documento") or stem).replace("+", " ").replace("_", " ").split())
        assert r["title"] == title and r["specialty"] == head.get("especialidad", "") and r["tokens"] == estimate(own["text"])
        section = "\nSección: " + " > ".join(own["path"]) if own["path"] else ""
        assert r["embed_text"] == f"Documento: {title} | Especialidad: {r['specialty']}{section}\n---\n{own['text']}"
        assert (r["text"], r["path"], r["first_page"], r["last_page"]) == (own["text"], own["path"], own["first_page"], own["last_page"])


def test_summary(spark, sf_dir, chunks):
    kept = {}
    rows = sorted(chunks.collect(), key=lambda r: (r["doc_id"], r["chunk_no"]))
    for r in rows:
        kept.setdefault(" ".join(r["text"].split()).lower(), r)
    documents = markdown(spark, sf_dir).count()
    want = Row(documents, documents - len({r["doc_id"] for r in kept.values()}), len(kept), len(rows) - len(kept), sum(r["tokens"] for r in kept.values()), sum(estimate(r["embed_text"]) for r in kept.values()), sum(bool(r["dubious_units"]) for r in kept.values()))
    assert tuple(D.chunk_summary(spark, sf_dir).first()) == tuple(want)


def test_chunks_round_trip(spark, tmp_path, chunks):
    path = str(tmp_path / "chunks")
    for _ in range(2):  # a second writing replaces the first
        sinks.write_chunks(chunks, path)
    names = list(sinks.CHUNK_NAMES)
    key = lambda r: (r[2], r[0], r[9])
    got = sorted((tuple(r) for r in files.read_chunks(spark, path).collect()), key=key)
    assert got == sorted((tuple(r) for r in chunks.select(*names).collect()), key=key) and files.read_chunks(spark, path).columns == list(sinks.CHUNK_NAMES.values())
    some = chunks.select(F.col("source").alias("path")).orderBy("source").limit(1)
    one = files.read_chunks(spark, path, some)
    assert one.count() == chunks.join(some, chunks.source == some.path, "left_semi").count() > 0
    sinks.write_chunks(chunks.limit(0), path)
    assert files.read_chunks(spark, path).count() == 0


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    texts = {"uno.md": "# Uno\n\ntexto", "a/dos.md": "", "a/tres.md": "ñ\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    found = {r["path"].split(tmp_path.name + "/", 1)[1]: r["markdown"] for r in files.read_markdown(spark, str(tmp_path)).collect()}
    assert found == {k: v for k, v in texts.items() if v}, "files without a byte give no row"


def test_ocr_documents(spark):
    rows = [("a", "completar", "procesado"), ("a", "completar", "ya_existia"), ("b", "rehacer", "ya_existia"), ("c", "nada", "procesado"), ("d", "rehacer", "error"), ("e", None, None)]
    own = spark.createDataFrame(rows, "ruta_relativa string, modo string, estado string")
    assert sorted(r[0] for r in files.ocr_documents(own).collect()) == ["a", "b"]


def test_painted_and_elbow(spark):
    pixels = spark.createDataFrame([(i, [float(x), float(y)]) for i, (x, y) in enumerate([(0, 0), (1, 0), (9, 9), (10, 10), (5, 5)])], "id int, embedding array<double>")
    found = {r["id"]: tuple(r["colour"]) for r in M.painted(pixels, [[0.0, 0.0], [10.0, 10.0]]).collect()}
    assert found == {0: (0, 0), 1: (0, 0), 2: (10, 10), 3: (10, 10), 4: (0, 0)}, "ties go to the first centre"
    costs = dict(M.elbow(pixels, 4))
    assert list(costs) == [2, 3, 4] and costs[2] >= costs[3] >= costs[4] >= 0 and costs[4] <= 1
