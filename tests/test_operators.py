"""Row-level expectations of the operators, and properties of the folds."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import agent as A
from vellum.operators import batching as B
from vellum.operators import chunking as K
from vellum.operators import cleaning as C
from vellum.operators import graphs as G
from vellum.operators import inventory as I
from vellum.operators import units as U
from vellum.operators import vectors as V


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_names(spark):
    noise = column(spark, ["certificado antibiótico ", "enfermedades de los gatos ", "Estética_Canina-2"], lambda c: I.is_noise_name(T.plain_name(c)))
    assert noise == [True, False, True]
    names = ["90817263", "doc", "a" * 20 + "1" * 20, "Lagos_7b(2)", "", "scan (3)", "abcdefghijklmnopqrst"]
    assert column(spark, names, lambda c: I.is_nondescript(c, T.plain_name(I.without_copy_suffix(c)))) == [True, True, True, False, True, True, False]


def test_text_helpers(spark):
    assert column(spark, [" \n a \t", "\xa0x ", ""], T.strip_ws) == ["a", "x", ""]
    assert column(spark, ["a\nb\n", "\n", "", "a\r\nb\x0bc d"], T.split_lines) == [["a", "b"], [""], [], ["a", "b", "c", "d"]]
    assert column(spark, ["", "  ", "abc", "a" * 9], T.count_tokens) == [0, 0, 1, 2]
    assert column(spark, ["ñ "], T.nfc) == ["\xf1"]


def test_language_and_quality(spark):
    es, en = "el perro de la casa y los gatos que " * 6, "the dog and the cat of this house with " * 6
    df = spark.createDataFrame([(0, es), (1, en), (2, es + en), (3, "")], "i int, text string")
    assert [r["language"] for r in I.detect_language(df).orderBy("i").collect()] == ["es", "en", "mixto", "desconocido"]
    q = spark.createDataFrame([(0, "Hola, mundo 3,5 l1I|:~ y"), (1, " \n"), (2, "...")], "i int, text string")
    assert [r["text_quality"] for r in I.text_quality(q).orderBy("i").collect()] == [0.6, None, None]


def test_content_type(spark):
    text = "x" * 200
    rows = [("texto", text)] * 10 + [("escaneado", "")] * 10 + [("mixto", text)] * 5 + [("mixto", " ")] * 5
    df = spark.createDataFrame(rows, "doc string, text string")
    assert all(r["doc"] == r["content_type"] for r in I.content_type(df).collect())


def test_sample_indices(spark):
    assert column(spark, [0, 3, 500], I.sample_indices, "int")[:2] == [[], [0, 1, 2]]
    found = column(spark, [500], I.sample_indices, "int")[0]
    assert len(found) == 12 and found[0] == 0 and found[-1] == 499
    assert column(spark, [100], lambda c: I.sample_indices(c, 5), "int") == [[0, 25, 50, 74, 99]]


def test_duplicates(spark):
    rows = [("b/x(1).pdf", "x(1)", "h"), ("b/longer.pdf", "longer", "h"), ("b/y.pdf", "y", "h"), ("z.pdf", "z", "k")]
    found = {r["path"]: r["duplicate_of"] for r in I.mark_duplicates(spark.createDataFrame(rows, "path string, stem string, sha256 string")).collect()}
    assert found == {"b/x(1).pdf": "b/y.pdf", "b/longer.pdf": "b/y.pdf", "b/y.pdf": None, "z.pdf": None}


def test_numbered(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 300)], "k int")
    rows = sorted((r["k"], r["ord"]) for r in I.numbered(df, "k").collect())
    assert [o for _, o in rows] == list(range(300))


KEPT = ["Otros nombres: Galgo Nórdico", "Rev Zoo (318) 2003-2007", "|150 4800 9100|", "descrita con el nombre: cirrosis", "Especie: Equina", "Paciente: yegua gris"]


def cleaned(spark, pages, with_ocr=False):
    text = "\n\n".join(f"<!-- pagina: {n} -->\n{p}" for n, p in enumerate(pages, 1))
    docs = spark.createDataFrame([(1, text, with_ocr)], "doc_id long, markdown string, with_ocr boolean")
    out, log = C.clean_documents(docs)
    return out.first()["markdown"], log.collect()


def test_personal_data(spark):
    text, log = cleaned(spark, ["Nombre: Truco Especie: Equina Raza: Criolla\nEquipo:\nAna López Díaz\n\nLuis Pérez 1234567\nTítulo normal aquí\nMaría Gómez Ruiz 123456\nescribe a ana@uni.edu.mx o Tel. 81-1234-5678\n(81) 1234-5678 y +52 81 1234 5678\n" + "\n".join(KEPT)])
    m = C.MARK
    for line in (f"{m} Especie: Equina Raza: Criolla", f"Equipo:\n{m}\n\n{m}\nTítulo normal aquí\n{m}", f"escribe a {m} o {m}", f"{m} y {m}", *KEPT):
        assert line in text, line
    assert sum(r["kind"] == "dato_personal" for r in log) == 8


def test_units(spark):
    text, log = cleaned(spark, ["240 IJg/ml (61 Ul/ml)\n5 rng/kg y 51Ug/ml y 3 ug/kg/h\n5-10 pg/kg IV\n2 ma/kg\n5 mg/kg"], with_ocr=True)
    for line in ("240 µg/ml (61 UI/ml)", "5 mg/kg y 51Ug/ml y 3 µg/kg/h", "5-10 µg/kg IV", "2 ma/kg"):
        assert line in text, line
    assert {r["original"] for r in log if r["kind"] == "unidad_sospechosa"} == {"5 rng/kg y 51Ug/ml y 3 ug/kg/h".replace("rng", "mg").replace("ug/", "µg/"), "2 ma/kg"} or any("ma/kg" in r["original"] for r in log)
    assert "5-10 pg/kg IV" in cleaned(spark, ["5-10 pg/kg IV"])[0]


def test_page_numbers_and_repeated_lines(spark):
    pages = [f"Manual {n}\nTexto de la hoja {'abcdefg'[n]}\n{n}\n|Manual|" for n in range(1, 7)]
    text, log = cleaned(spark, pages)
    assert "Manual 1" not in text and text.count("|Manual|") == 6 and text.count("Texto de la hoja") == 6
    assert {(r["kind"], r["times"]) for r in log} == {("linea_repetida", 6)}
    assert "Manual 1" in cleaned(spark, pages[:4])[0]
    assert column(spark, ["12", "- 12 -", "Página 12", "pág. 3", "12 de 40", "Pagina 7/42", "12345", "x 1", ""], C.is_page_number) == [True] * 6 + [False] * 3


def test_missing_markdown(spark):
    out, log = C.clean_documents(spark.createDataFrame([(1, None, None), (2, "sin páginas", None)], "doc_id long, markdown string, with_ocr boolean"))
    found = {r["doc_id"]: (r["markdown"], bool(r["message"])) for r in out.collect()}
    assert found == {1: (None, True), 2: ("sin páginas\n", False)} and log.count() == 0


def test_known_units(spark):
    assert column(spark, ["mval", "MG", "ma", "1a", "μg", "M"], U.is_known) == [True, True, False, False, True, True]


DOC = '---\nfuente: "a/b.pdf"\ndocumento: "Mi_libro"\nespecialidad: "x"\nidioma: "es"\n---\n<!-- pagina: 1 -->\n# Uno\nhola mundo\n\n## Dos\n|a|b|\n|---|---|\n|1|2|\n<!-- pagina: 2 -->\n# Tres\nfin'


def test_blocks(spark):
    df = spark.createDataFrame([(1, DOC)], "doc_id long, markdown string")
    rows = [(r["kind"], r["text"], r["page"], r["path"]) for r in K.blocks(df).orderBy("block_no").collect()]
    assert rows == [
        ("titulo", "Uno", 1, ["Uno"]), ("parrafo", "hola mundo", 1, ["Uno"]), ("titulo", "Dos", 1, ["Uno", "Dos"]),
        ("tabla", "|a|b|\n|---|---|\n|1|2|", 1, ["Uno", "Dos"]), ("titulo", "Tres", 2, ["Tres"]), ("parrafo", "fin", 2, ["Tres"]),
    ]
    chunk = K.chunk_documents(df, least=1).collect()
    assert len(chunk) == 1 and chunk[0]["title"] == "Mi libro" and chunk[0]["first_page"] == 1 and chunk[0]["last_page"] == 2 and chunk[0]["language"] == "es"


def test_table_split():
    rows = [f"|{n}|{'x' * 40}|" for n in range(400)]
    parts = K.split_table("\n".join(["|a|b|", "|---|---|", *rows]))
    assert all(p.startswith("|a|b|\n|---|---|\n") and K.tokens(p) <= K.TARGET for p in parts)
    assert [r for p in parts for r in p.split("\n")[2:]] == rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["parrafo", "tabla", "titulo"]), st.integers(1, 5000)), max_size=25))
def test_packing_loses_nothing(spec):
    found = [(kind, f"{n}" + "x" * (min(size, 3000) if kind == "tabla" else size), None, []) for n, (kind, size) in enumerate(spec)]  # a row is never cut
    groups = list(K.packed(found))
    texts = [b[1] for g in groups for b in g]
    assert all(any(t == p[1] for t in texts) for p in K.pieces(found) if p[0] != "titulo")
    assert all(sum(K.tokens(b[1]) for b in g) <= K.TARGET + K.OVERLAP for g in groups)


def test_greedy_batches(spark):
    rng = random.Random(5)
    for most_texts, most_tokens, rows in ((7, 100, 500), (1000, 300, 60), (3, 10**9, 40)):
        items = [(i, rng.choice([1, 5, 20, 90, 250])) for i in range(rows)]
        batch, texts, tokens, want = 0, 0, 0, []
        for _, t in items:
            if texts and (texts >= most_texts or tokens + t > most_tokens):
                batch, texts, tokens = batch + 1, 0, 0
            texts, tokens = texts + 1, tokens + t
            want.append(batch)
        df = spark.createDataFrame(rng.sample(items, rows), "id int, tokens int")
        assert [r["batch"] for r in B.greedy_batches(df, most_texts=most_texts, most_tokens=most_tokens).orderBy("id").collect()] == want


def test_citations(spark):
    df = spark.createDataFrame([("Uno [2], dos [1] [2]; inventada [8] [99999999999].",)], "t string")
    assert df.select(A.citations(F.col("t"), F.lit(3))).first()[0] == [2, 1]
    assert df.select(A.sources(F.lit("nada"), F.array(F.lit(1), F.lit(2)))).first()[0] == [1, 2]


def test_ports():
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise TimeoutError
        return x

    assert A.with_retries(flaky, (TimeoutError,), wait=1, sleep=waits.append)(4) == 4 and waits == [1, 2]

    def small(items):
        if len(items) > 3:
            raise OverflowError
        return [i * 2 for i in items]

    assert A.halving(small, OverflowError)(list(range(20))) == [i * 2 for i in range(20)]


def test_agent_asks_everything(spark, sf_dir):
    from vellum.plans import agent as P

    items = {r["item_id"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id").collect()}
    assert len(items) > 20 and {r["question_id"] for r in P.ask(spark, sf_dir)[0].select("question_id").collect()} == items
    long = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) > 800").orderBy("doc_id").first()
    got = P.fragments(spark, sf_dir).filter(F.col("doc_id") == long["doc_id"]).first()["embedding"]
    assert got == pytest.approx(A.hashed_embedding()([long["text"]])[0])


def test_graph_searches():
    from vellum.plans.agent import ROADS

    assert G.depth_limited(ROADS, "Zerind", "Urziceni", 2) == "cutoff"
    assert len(G.iterative_deepening(ROADS, "Zerind", "Urziceni")) == 6


def test_ivf_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    indexed, centres = V.ivf_cells(df, 8)
    hits = 0
    for q in df.filter("vec_id < 10").collect():
        exact = {r["vec_id"] for r in V.cosine_topk(df, q["embedding"]).collect()}
        hits += len(exact & {r["vec_id"] for r in V.ivf_topk(indexed, centres, q["embedding"], probes=6).collect()})
    assert hits >= 0.9 * 80


def test_ivf_recall_of_the_query(spark):
    from vellum.plans import vectors as P

    path = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{path}/embeddings.parquet")
    got = {(r["question_id"], r["vec_id"]) for r in P.ivf_topk(spark, path).collect()}
    questions = df.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("question"))
    exact = {(r["question_id"], r["vec_id"]) for r in V.cosine_topk_batch(df, questions).collect()}
    print("recall", len(got & exact) / len(exact))
    assert {q for q, _ in got} == {q for q, _ in exact} and len(got & exact) >= 0.9 * len(exact)
    blocks = V.in_blocks(questions, lambda part: V.cosine_topk_batch(df, part), most=15)
    assert {(r["question_id"], r["vec_id"]) for r in blocks.collect()} == exact


def test_mlp_learns_from_the_whole_table(spark, sf_dir, monkeypatch):
    from vellum.plans import vectors as P

    seen = []
    monkeypatch.setattr(P.mlp, "train", lambda rows, **settings: seen.append((rows.count(), settings)))
    P.mlp_train(spark, sf_dir)
    assert seen == [(spark.read.parquet(f"{sf_dir}/embeddings.parquet").count(), {})] and P.mlp.EPOCHS == 500


def test_budget_and_upsert(spark):
    totals = spark.createDataFrame([(0, 100), (1, 100), (2, 10), (3, 1)], "batch long, tokens long")
    assert [r["batch"] for r in B.within_budget(totals, 0, 220).collect()] == [0]
    stored, new = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "b"), (2, "d"), (2, "c")], "id int, v string")
    assert sorted(map(tuple, B.upsert_new(stored, new).collect())) == [(1, "a"), (2, "c")]


@pytest.mark.parametrize("text,same", [("12 Capítulo 5", "13 Capítulo 5"), ("Hoja 7", "Hoja  8")])
def test_line_keys(spark, text, same):
    a, b = column(spark, [text, same], C.line_key)
    assert a == b
    assert len(set(column(spark, ["La catalasa 3 es", "La catalasa 4 es"], C.line_key))) == 2
