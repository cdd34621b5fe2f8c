"""Files, lists and manifests; loads that can be repeated; streams."""

import pytest
from pyspark.sql import functions as F

from vellum.sources import files, sinks
from vellum.streaming import limits, threads


def test_scan(spark, tmp_path):
    for name in ("Mi biblioteca/Infecciosas/Parvo virus.pdf", "Mi biblioteca/Infecciosas/Parvo virus(1).pdf", "Mi biblioteca/.DS_Store", "Mi biblioteca/README.md", "Mi biblioteca/video+1.mov"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"same" if "Parvo" in name else name.encode())
    found = files.scan_files(spark, str(tmp_path))
    rows = {r["path"]: r["sha256"] for r in found.collect()}
    assert set(rows) == {"Mi biblioteca/Infecciosas/Parvo virus.pdf", "Mi biblioteca/Infecciosas/Parvo virus(1).pdf", "Mi biblioteca/video+1.mov"}
    assert len(set(rows.values())) == 2 and files.library_root(found) == "Mi biblioteca/"


def test_selection(spark, tmp_path):
    (tmp_path / "inv.csv").write_text("﻿ruta_relativa,especialidad,tipo_contenido,idioma,calidad_texto,paginas,decision\nñ/a.pdf,x,texto,es,,3, Conservar \nb.pdf,x,texto,es,0.5,1,descartar\n", encoding="utf-8")
    kept = files.select_keep(files.read_csv(spark, str(tmp_path / "inv.csv"), files.INVENTORY))
    row = kept.collect()
    assert len(row) == 1 and row[0]["ruta_relativa"] == "\xf1/a.pdf" and row[0]["calidad_texto"] is None and row[0]["paginas"] == 3
    (tmp_path / "pilot.txt").write_text("# list\n\n\xf1/a.pdf\n", encoding="utf-8")
    wanted = files.pilot_list(spark, str(tmp_path / "pilot.txt"))
    assert files.pilot(kept, wanted).count() == 1
    with pytest.raises(ValueError):
        files.pilot(kept.filter("false"), wanted)


def test_loads_can_be_repeated(spark, tmp_path):
    store, ledger = str(tmp_path / "store"), str(tmp_path / "ledger")
    rows = lambda *ids: spark.createDataFrame([(i, 10) for i in ids], "id string, tokens int")
    assert sinks.load_batch(rows("a", "b"), 0, store, ledger, "m") == 2
    assert sinks.load_batch(rows("a", "b"), 0, store, ledger, "m") == 2
    assert sinks.load_batch(rows("b", "c"), 1, store, ledger, "m") == 3
    assert spark.read.parquet(ledger).agg(F.sum("tokens")).first()[0] == 40


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_type")
    events.write.parquet(str(tmp_path / "events"))
    own = limits.failures(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), least=1)
    q = own.writeStream.format("memory").queryName("failures").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = {tuple(r) for r in limits.failures(events, least=1).collect()}
    assert {tuple(r) for r in spark.table("failures").collect()} <= batch

    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    messages.write.parquet(str(tmp_path / "messages"))
    memory = threads.thread_memory(spark.readStream.schema(messages.schema).parquet(str(tmp_path / "messages")), most=2)
    q = memory.writeStream.format("memory").queryName("memory").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("memory").count() == messages.count() and spark.table("memory").filter(F.size("history") > 2).count() == 0
