"""Cleaning and the chunk fold against plain versions, lines of a million characters, rows without values, and the steps
of the ingestion."""

import time
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from vellum.functions import tables
from vellum.functions import text as T
from vellum.operators import chunking as K
from vellum.operators import cleaning as C
from vellum.operators import graphs as G
from vellum.operators import ingestion as N
from vellum.operators import inventory as I
from vellum.operators import units as U
from vellum.sources import files, sinks


def py(pattern):
    return regex.compile(pattern.replace(r"\z", r"\Z"))


NW = r"[^\p{L}\p{N}_]"
DENOMINATORS = "|".join(sorted(U.DENOMINATORS, key=len, reverse=True))
UNIT = regex.compile(rf"\p{{Nd}}[|\s]*(1[a-zA-Z]{{1,2}}|[A-Za-zµμ°%‰][A-Za-zµμ²]{{0,5}})/(?:{DENOMINATORS})(?![A-Za-z])")


def key_of(line):
    key = " ".join(line.split())
    key = regex.sub(rf"\p{{Nd}}+(?={NW}*\Z)", "#", key, count=1)
    return regex.sub(rf"\A({NW}*)\p{{Nd}}+", r"\1#", key)


def known(unit):
    own = unit.replace("μ", "µ")
    return own in U.KNOWN or (len(own) > 1 and own == own.upper() and own != own.lower() and own.lower() in {u.lower() for u in U.KNOWN})


def cleaned_by_hand(markdown, ocr):
    header = ""
    if markdown.startswith("---\n"):
        end = markdown.index("\n---\n", 4) + 5
        header, markdown = markdown[:end], markdown[end:]
    parts = regex.split(r"<!-- pagina: (\p{Nd}+) -->", markdown)
    pages = [(int(n), t.splitlines()) for n, t in zip(parts[1::2], parts[2::2])] or [(None, markdown.splitlines())]
    log, count, first = [], Counter(), {}
    guarded = lambda x: not x.strip() or x.lstrip().startswith("|")
    for _, lines in pages:
        for k in {key_of(x): x for x in reversed(lines) if not guarded(x)}.items():
            count[k[0]] += 1
            first.setdefault(*k)
    gone = {k for k, n in count.items() if len(pages) >= 5 and n >= len(pages) / 2}
    log += [("linea_repetida", first[k].strip(), "", None, count[k]) for k in gone]
    rules = [(py(C.LABEL), None), (py(C.EMAIL), None), (py(C.PHONE_LABEL), None), (py(C.PHONE), regex.compile(r"(19|20)\d\d\s*[-–]\s*(19|20)\d\d"))]
    team, name, with_id, number = map(py, (C.TEAM, C.NAME_LINE, C.NAME_WITH_ID, C.PAGE_NUMBER))
    blocks = []
    for no, lines in pages:
        out, listing = [], False
        for line in lines:
            if not guarded(line) and key_of(line) in gone:
                continue
            is_team, is_name = bool(team.search(line)), bool(name.search(line))
            own = line
            if (listing and is_name and line.strip()) or (not is_team and with_id.search(line)):
                own = C.MARK
                log.append(("dato_personal", line.strip(), C.MARK, no, 1))
            elif not is_team:
                for pattern, unless in rules:
                    hits = [m for m in pattern.finditer(own) if not (unless and unless.search(m[0]))]
                    log += [("dato_personal", m[0], C.MARK, no, 1) for m in hits]
                    own = pattern.sub(lambda m: m[0] if unless and unless.search(m[0]) else C.MARK, own)
            listing = True if is_team else listing and (not line.strip() or is_name)
            for written, below, when in (("ug", "/[A-Za-z²]+", True), ("μg", "/[A-Za-z²]+", True), ("pg|1g", "/kg", ocr and py(U.DOSING).search(own))):
                pattern = regex.compile(rf"(\p{{Nd}}(?:[\p{{Nd}}.,\s-]*\p{{Nd}})?\s*\|?\s*)({written})(?=({below}))")
                if when:
                    log += [("unidad_corregida", m[0] + m[3], m[1] + "µg" + m[3], no, 1) for m in pattern.finditer(own)]
                    own = pattern.sub(r"\1µg", own)
            fixed = lambda m: m[0] if m[1] not in U.MISREAD else m[0][: m.start(1) - m.start()] + U.MISREAD[m[1]][0] + m[0][m.end(1) - m.start() :]
            log += [("unidad_corregida", m[0], fixed(m), no, 1) for m in UNIT.finditer(own) if m[1] in U.MISREAD]
            own = UNIT.sub(fixed, own)
            log += [("unidad_sospechosa", " ".join(own[max(0, m.start() - 30) : m.end() + 10].split()), "", no, 1) for m in UNIT.finditer(own) if not known(m[1])]
            if own.strip() and number.search(own):
                log.append(("numero_pagina", own.strip(), "", no, 1))
                continue
            out.append(own.rstrip())
        text = regex.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()
        blocks.append(text if no is None else f"<!-- pagina: {no} -->\n{text}".rstrip())
    return header + "\n\n".join(blocks) + "\n", Counter(log)


HARD = [
    "---\na: b\n---\n" + "\n\n".join(f"<!-- pagina: {n} -->\nMANUAL {n}\n|fila {n}|\nIntegrantes:\nRosa Vela\n\nMANUAL {n}\nHugo Paz Rey 7654321\nfin {'xyzuvw'[n]}\n— {n} —" for n in range(1, 6)),
    "<!-- pagina: 3 -->\nAlumna: Eva Ruz, grupo 4; tel 55-1234-5678 y luz@mar.org.mx.\n2 ug/kg o 3 μg/ml, 7 | Ul/ml y 4 zz/kg y 5 qq/ml al día\n4 pg/kg cada 8 h\n<!-- pagina: 4 -->\nMANUAL\nPág. 4",
    "<!-- pagina: 1 -->\nsolo\n" + "\n".join(f"<!-- pagina: {n} -->\nsolo" for n in range(2, 9)),
    "texto sin marcas\r\n\r\n\r\n\r\n(55) 1234-5678 y 1999-2004\x0cotra  \n\n\n",
    "",
]


def test_clean_documents(spark, sf_dir):
    from vellum.plans.cleaning import markdown

    extra = spark.createDataFrame([(10**6 + 2 * n + o, t, bool(o)) for n, t in enumerate(HARD) for o in (0, 1)], "doc_id long, markdown string, with_ocr boolean")
    docs = markdown(spark, sf_dir).unionByName(extra)
    out, log = C.clean_documents(docs)
    want = {r["doc_id"]: cleaned_by_hand(r["markdown"], r["with_ocr"]) for r in docs.collect() if r["markdown"] is not None}
    got = {r["doc_id"]: r["markdown"] for r in out.collect() if r["markdown"] is not None}
    assert set(got) == set(want)
    for i, (text, _) in want.items():
        assert got[i] == text, i
    rows = Counter()
    for r in log.collect():
        rows[r["doc_id"], (r["kind"], r["original"], r["replacement"], r["page"], r["times"])] += 1
    told = Counter({(i, c): n for i, (_, changes) in want.items() for c, n in changes.items()})
    assert rows == told, list((rows - told).items())[:3] + list((told - rows).items())[:3]


def folded_by_hand(found):
    """Chunks as lists of texts; one piece after another."""
    size = lambda texts: sum(K.tokens(t) for t in texts)
    out, current, handed = [], [], 0
    for kind, text in found:
        if kind == "titulo":
            if len(current) > handed and size(t for _, t in current) < K.MIN_SECTION:
                continue
            if len(current) > handed:
                out.append([t for _, t in current])
            current, handed = [], 0
            continue
        parts = [text] if K.tokens(text) <= K.TARGET else (K.split_table if kind == "tabla" else K.split_paragraph)(text)
        for part in parts:
            if len(current) > handed and size([*(t for _, t in current), part]) > K.TARGET:
                out.append([t for _, t in current])
                last, own = current[-1]
                if last == "tabla":
                    current = []
                elif K.tokens(own) <= K.OVERLAP:
                    current = [(last, own)]
                else:
                    kept = []
                    for sentence in reversed(K.SENTENCE_END.split(own)):
                        if len(" ".join([sentence, *kept])) > 4 * K.OVERLAP + 3:
                            break
                        kept.insert(0, sentence)
                    current = [("parrafo", " ".join(kept))] if kept else []
                handed = len(current)
            current.append((kind, part))
    if len(current) > handed:
        out.append([t for _, t in current])
    return ["\n\n".join(c) for c in out]


def test_chunk_fold(spark, sf_dir):
    from vellum.plans.cleaning import markdown

    found = K.blocks(markdown(spark, sf_dir))
    own = {}
    for r in found.orderBy("doc_id", "block_no").collect():
        own.setdefault(r["doc_id"], []).append((r["kind"], r["text"]))
    got = {}
    for r in K.chunk_fold(found).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    want = {i: folded_by_hand(blocks) for i, blocks in own.items()}
    assert sum(map(len, want.values())) > 500 and got == {i: w for i, w in want.items() if w}


MILLION = 1_000_000
LONG = {
    "digits": "7" * MILLION, "digits and blanks": "7 " * (MILLION // 2), "blanks": "a" + " " * MILLION + "b", "names": "Ana " * (MILLION // 4) + "x", "pipes": "|" * MILLION + "x", "marks": "-" * MILLION + "x",
    "label": "Nombre:" + " " * MILLION + ",", "phone": "tel" + " " * MILLION + ":x", "team": "Equipo" + " " * MILLION + "x", "dots": "a." * (MILLION // 2), "mail": "a@b" + ".c" * (MILLION // 2) + "!", "page": "pag. 5" + " " * MILLION + "x",
    "hashes": "# a" + "# " * (MILLION // 2) + "b", "unit": "5" + " |" * (MILLION // 2) + "mg/x", "units": "5 zz/kg " * (MILLION // 8), "number and letter": "7" * MILLION + "x",
}


def test_lines_of_a_million_characters(spark):
    df = spark.createDataFrame(sorted(LONG.items()), "name string, line string").repartition(4)
    line = F.col("line")
    rules = {
        "label": C.all_marked(line, C.LABEL), "mail": C.all_marked(line, C.EMAIL), "tel": C.all_marked(line, C.PHONE_LABEL), "phone": C.marked_phones(line), "team": line.rlike(C.TEAM), "names": line.rlike(C.NAME_LINE), "ids": line.rlike(C.NAME_WITH_ID),
        "page": C.is_page_number(line), "key": C.line_key(line), "ug": F.regexp_replace(line, U.UG, "$1µg"), "micro": F.regexp_replace(line, U.OCR_MICRO, "$1µg"), "misread": U.repair_misread(line), "unknown": F.size(U.unknown_units(line)), "dose": U.has_dosing_context(line),
        "title": K.heading_title(line), "tidy": T.tidy_blank_lines(line), "collapsed": T.collapse_ws(line), "suffix": I.without_copy_suffix(line),
    }
    began = time.time()
    rows = {r["name"]: r for r in df.select("name", *(e.alias(k) for k, e in rules.items())).collect()}
    assert time.time() - began < 300 and len(rows) == len(LONG)
    assert rows["units"]["unknown"] == MILLION // 8 and rows["mail"]["mail"] == C.MARK + "!" and not rows["team"]["team"] and rows["phone"]["tel"] == LONG["phone"]
    assert rows["digits"]["key"] == "#" and rows["number and letter"]["key"] == "#x" and rows["blanks"]["collapsed"] == "a b"
    df = spark.createDataFrame([(1, "\n".join(LONG.values()), True)], "doc_id long, markdown string, with_ocr boolean")
    assert C.clean_documents(df)[0].first()["markdown"] and K.blocks(df).count()


def test_rows_without_hash_or_text(spark):
    rows = [("a.pdf", "a", "h"), ("a(1).pdf", "a(1)", "h"), ("b.pdf", "b", None), ("c.pdf", "c", None)]
    found = {r["path"]: r["duplicate_of"] for r in I.mark_duplicates(spark.createDataFrame(rows, "path string, stem string, sha256 string")).collect()}
    assert found == {"a.pdf": None, "a(1).pdf": "a.pdf", "b.pdf": None, "c.pdf": None}
    chunks = spark.createDataFrame([(2, "Hola  mundo", "x"), (1, "hola mundo ", "y"), (1, "hola mundo ", "y"), (1, "HOLA mundo", "z"), (3, None, "n"), (3, None, "n"), (4, "", "e")], "doc_id long, text string, more string")
    kept = sorted((r["doc_id"], r["text"] or "", r["more"]) for r in K.keep_first(chunks, "doc_id").collect())
    assert kept == [(1, "HOLA mundo", "z"), (3, "", "n"), (3, "", "n"), (4, "", "e")] and K.keep_first(chunks, "doc_id").columns == chunks.columns


def test_spread(spark):
    assert tables.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(10).repartition(9)
    assert tables.spread(many) is many


def test_paths_converge_or_raise(spark):
    edges = spark.createDataFrame([(str(k), str(k + 1), 1) for k in range(12)], "src string, dst string, w int")
    assert G.best_paths(edges, "0").count() == 13
    with pytest.raises(ValueError):
        G.best_paths(edges, "0", most=5)
    with pytest.raises(ValueError):
        sinks.markdown_table(spark.range(30), most=20)


SELECTED = [("s/uno.pdf", "s", "texto", "es", 0.9), ("s/dos.pdf", "s", "escaneado", "es", None), ("s/mal.pdf", "s", "texto", "en", 0.8), ("s/doc.docx", "s", "documento", "en", None), ("s/ya.pdf", "s", "mixto", "es", 0.9), ("s/no.pdf", "s", "texto", "es", 0.9)]


def test_ingestion(spark):
    selected = spark.createDataFrame(SELECTED, "ruta_relativa string, especialidad string, tipo_contenido string, idioma string, calidad_texto double")
    none = spark.createDataFrame([], "path string, markdown string")
    ready = spark.createDataFrame([("s/ya.pdf",)], "path string")
    assert {r["ruta_relativa"] for r in N.to_ocr(selected, ready).collect()} == {"s/dos.pdf"}
    ran = spark.createDataFrame([("s/dos.pdf", 1.5, None)], "path string, seconds double, error string")
    manifest = N.ocr_manifest(selected, ran, ready, "ocr")
    rows = {r["ruta_relativa"]: r for r in manifest.collect()}
    assert tuple(manifest.columns) == N.OCR_COLUMNS and {k: r["estado"] for k, r in rows.items()} == {"s/uno.pdf": "omitido", "s/dos.pdf": "procesado", "s/mal.pdf": "omitido", "s/doc.docx": "omitido", "s/ya.pdf": "ya_existia", "s/no.pdf": "omitido"}
    assert rows["s/dos.pdf"]["ruta_fuente"] == "ocr/s/dos.pdf" and rows["s/uno.pdf"]["ruta_fuente"] == "s/uno.pdf"

    def parser(content):
        if content == b"bad":
            raise OSError("broken file")
        return content.decode().split("|")

    contents = [("s/uno.pdf", b"# Uno\n\nEl perro come bien. " + b"palabra " * 60 + b"||Tercera"), ("ocr/s/dos.pdf", b"una|dos"), ("s/mal.pdf", b"bad"), ("s/doc.docx", b"un informe"), ("ocr/s/ya.pdf", b"other")]
    sources = spark.createDataFrame([(p, bytearray(c)) for p, c in contents], "path string, content binary")
    before = none.unionAll(spark.createDataFrame([("s/ya.pdf", "hecho antes\n")], "path string, markdown string"))
    listed = manifest.filter("ruta_relativa <> 's/no.pdf'")
    got = N.ingest(selected, listed, sources, before, parser, lambda content, n: "plain" if n == 1 else "")
    made = {r["ruta_relativa"]: r["markdown"] for r in got["markdown"].collect()}
    assert set(made) == {"s/uno.pdf", "s/dos.pdf", "s/doc.docx", "s/ya.pdf"} and made["s/ya.pdf"] == "hecho antes\n"
    assert made["s/dos.pdf"] == '---\ndocumento: "dos"\nespecialidad: "s"\nidioma: "es"\nfuente: "s/dos.pdf"\npaginas: 2\n---\n\n<!-- pagina: 1 -->\nuna\n\n<!-- pagina: 2 -->\ndos\n'
    assert made["s/doc.docx"].endswith("paginas: null\n---\n\nun informe\n") and "<!-- pagina: 2 -->\nplain\n" in made["s/uno.pdf"]
    rows = {r["ruta_relativa"]: r for r in got["conversion"].collect()}
    assert tuple(got["conversion"].columns) == N.CONVERSION_COLUMNS and {k: r["estado"] for k, r in rows.items()} == {"s/uno.pdf": "convertido", "s/dos.pdf": "convertido", "s/mal.pdf": "error", "s/doc.docx": "convertido", "s/ya.pdf": "ya_existia", "s/no.pdf": "error"}
    assert rows["s/mal.pdf"]["mensaje"] == "broken file" and rows["s/no.pdf"]["mensaje"] == N.NOT_IN_MANIFEST and rows["s/uno.pdf"]["paginas_texto_plano"] == 1 and rows["s/uno.pdf"]["paginas"] == 3
    assert got["cleaned"].filter("message <> ''").count() == 2 and {r["source"] for r in got["kept"].collect()} >= {"s/uno.pdf"}


def test_front_matter_can_be_read(spark):
    values = ['plain', 'a "quoted": b', "ñandú / x", "", None, "back\\slash"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    head = N.front_matter({"uno": F.col("x"), "dos": F.col("i")})
    rows = df.select("x", "i", K.header_fields(C.split_header(F.concat(head, F.lit("body")))[0]).alias("f")).collect()
    assert all(r["f"]["uno"] == r["x"] and r["f"]["dos"] == str(r["i"]) for r in rows)


def test_vectors_pair_strictly(spark):
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "batch int, at int, text string")
    vectors = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0])], "batch int, at int, vector array<double>")
    assert sorted(map(tuple, N.paired(chunks, vectors, "batch", "at").collect())) == [(1, 0, "a", [1.0]), (1, 1, "b", [2.0])]
    for a, b in ((chunks, vectors.filter("at = 0")), (chunks.filter("at = 0"), vectors)):
        with pytest.raises(Exception, match="pair one to one"):
            N.paired(a, b, "batch", "at").collect()


def test_report_and_inventory(spark, sf_dir, tmp_path):
    from vellum.plans.inventory import inventory

    own = inventory(spark, sf_dir).withColumn("content_type", F.col("kind"))
    sinks.write_report(own, str(tmp_path / "report"), "doc_id")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report")).select("value", F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("n")).orderBy("f", "n").collect()]
    rows = sorted(own.collect(), key=lambda r: r["doc_id"])
    assert lines[0] == sinks.REPORT and f"- **Archivos analizados:** {len(rows)}" in lines and f"- **Páginas (PDF):** {sum(r['pages'] or 0 for r in rows):,}" in lines
    kinds = Counter(r["recommendation"] for r in rows).most_common()
    at = lines.index("## Por recomendación")
    assert [x.split(" | ")[0] for x in lines[at + 4 : at + 4 + len(kinds)]] == [f"| {k}" for k, _ in kinds]
    gone = [r for r in rows if r["recommendation"] == "descartar"]
    at = lines.index(f"## Archivos a descartar ({len(gone)})")
    assert lines[at + 1 : at + 4] == ["", "| Archivo | Señales | Tipo | Páginas |", "|---|---|---|---|"] and sum(x.startswith("| `") for x in lines[at : lines.index(next(x for x in lines if x.startswith("## Archivos a revisar")))]) == len(gone)
    sinks.write_inventory(own, str(tmp_path / "csv"))
    assert all(p.read_bytes().startswith(b"\xef\xbb\xbfruta_relativa,") for p in (tmp_path / "csv").glob("part-*"))
    back = files.read_csv(spark, str(tmp_path / "csv"), ", ".join(f"{c} string" for c in sinks.INVENTORY_COLUMNS))
    assert back.count() == len(rows) and back.filter("decision = recomendacion").count() == len(rows)
