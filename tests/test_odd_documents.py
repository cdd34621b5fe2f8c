"""Queries over documents as Markdown against their SQL, for texts of unusual breaks, spaces and marks, and rows without values."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from vellum import catalog
from vellum.operators import chunking as K
from vellum.operators import units as U
from vellum.plans import documents as D

TEXTS = [
    "uno\ndos", "", None, "\n", "uno\n", "\n\nuno\n\n\n", "uno\r\ndos\r\n", "uno\rdos", "uno\x0bdos\x0ctres\x1cfin", "uno\x85dos", "uno dos ", "  uno \t\n\t\n",
    "\xa0uno　\n\xa0", "# Uno\ntexto\n## Dos ##\n####### no", "| a | b |\n|---|\n  |c|\nfin\n\xa0| d |\n\t|e|", "<!-- pagina: 7 -->\nuno\n <!-- pagina: 8 -->", "---\na: b\n---\nuno", "#\n# \n|", "\x0b\n\x0c\n\x1f", "x" * 5000,
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(n, t, "es", f"s{n % 3}", len(t or "")) for n, t in enumerate(TEXTS)]
    rows += [(100 + n, t, "es" if n % 2 else None, None if n % 3 else "s", len(t or "")) for n, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


def compared(spark, folder, name):
    df = catalog.queries()[name](spark, folder)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = c.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, df.select(*names).collect()), key=key) == sorted(found.fetchall(), key=key)


def test_split_header(spark, odd):
    compared(spark, odd, "split_header")


def test_blocks(spark, odd):
    compared(spark, odd, "blocks")


def blocks_by_hand(markdown):
    """kind, text, page, path and level of the blocks of Markdown without front matter; one line after another."""
    out, page, titles, before = [], None, {}, None
    for line in markdown.splitlines():
        mark = re.fullmatch(r"<!-- pagina: (\d+) -->", line.strip())
        head = re.fullmatch(r"(#{1,6})\s+(.+?)\s*#*\s*", line)
        title = head[2] if head else ""
        kind = "mark" if mark else "blank" if not line.strip() else "titulo" if 0 < len(title) <= K.MAX_TITLE else "tabla" if line.lstrip().startswith("|") else "parrafo"
        if kind == "mark":
            page = int(mark[1])
        elif kind == "titulo":
            titles = {k: v for k, v in titles.items() if k < len(head[1])} | {len(head[1]): title.strip("*_ ")}
            out.append([kind, [title.strip("*_ ")], page, list(titles.values()), len(head[1])])
        elif kind in ("tabla", "parrafo"):
            if kind != before:
                out.append([kind, [], page, list(titles.values()), 0])
            out[-1][1].append(line.rstrip())
        before = kind
    return [(kind, "\n".join(lines).strip(), *rest) for kind, lines, *rest in out]


BITS = (
    "\n", "\n\n", "# Uno", "## Dos ##", "### **Tres** ", "###### seis", "#", "####### no", "|", "| a | b |", "  |c|", "<!-- pagina: 3 -->", " <!-- pagina: 12 --> ", "<!-- pagina: x -->", "\r\n", "\x0b", "\x85", " ", "\xa0", "\t", "texto", "más. ",
    "　", "# " + "y" * 160, "---", "\x1f", "_",
)


def test_blocks_of_markdown(spark):
    """Marks, headings, tables and breaks in any order, as the operator reads them; consecutive marks, too."""
    draw = random.Random(4)
    texts = ["", "\n", "<!-- pagina: 1 -->\n<!-- pagina: 2 -->\nx", "x" + "\ny" * 100_000] + ["".join(draw.choice(BITS) + draw.choice(("", "\n", "\n")) for _ in range(draw.randint(0, 40))) for _ in range(400)]
    texts = ["x" + t if t.startswith("---\n") else t for t in texts]  # no front matter
    found = {}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, markdown string")
    for r in K.blocks(docs).orderBy("doc_id", "block_no").collect():
        own = found.setdefault(r["doc_id"], [])
        assert r["block_no"] == len(own)
        own.append((r["kind"], r["text"], r["page"], r["path"], r["level"]))
    for n, text in enumerate(texts):
        assert found.get(n, []) == blocks_by_hand(text), repr(text[:500])


def test_chunks_are_made_once(spark, odd, monkeypatch):
    """The summary folds documents once, in its one plan, and says of odd documents what their chunks say."""
    plan = D.chunk_summary(spark, odd)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(node in line for line in plan.splitlines() for node in ("MapInArrow", "FlatMapGroupsInArrow")) == 1 and plan.count("Window") == 1
    monkeypatch.setattr(K, "FOLD_ROWS", 2)
    chunks = D.chunk_cols(spark, odd).collect()
    kept = {}
    for r in sorted(chunks, key=lambda r: (r["doc_id"], r["chunk_no"])):
        kept.setdefault(" ".join(r["text"].split()).lower(), r)
    size = lambda c: sum(max(1, len(r[c]) // 4) for r in kept.values())
    own = len(TEXTS) * 2, len(TEXTS) * 2 - len({r["doc_id"] for r in kept.values()}), len(kept), len(chunks) - len(kept), size("text"), size("embed_text"), sum(bool(r["dubious_units"]) for r in kept.values())
    assert tuple(D.chunk_summary(spark, odd).first()) == own
    ids = {r["doc_id"] for r in chunks}
    assert ids and {i for i in ids if i >= 100} == {i + 100 for i in ids if i < 100}, "documents without a source have the same chunks"


def test_unknown_units(spark):
    lines = ["5 mg/kg", "5 zz/kg y 3 mg/ml", "Dosis 4 rng/kg IV", "7 QQ/ml o 7 MG/ML", "12 1a/h", "", None, "sin unidad", "3 μg/ml", "9 mgx/kgs"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", U.unknown_units(F.col("line")).alias("told"), U.has_unknown_units(F.col("line")).alias("has"))
    found = {r["line"]: r for r in df.collect()}
    assert all(bool(r["told"]) == bool(r["has"]) for r in found.values())
    assert found["5 zz/kg y 3 mg/ml"]["told"] == ["5 zz/kg y 3 mg/ml"] and not found["5 mg/kg"]["told"] and found["Dosis 4 rng/kg IV"]["has"]
