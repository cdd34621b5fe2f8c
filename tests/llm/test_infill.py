"""Fill-in-middle against a plain version, and its defined results at the edges."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.llm import infill

UNITS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).", "word": r"^[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*"}


def plain(doc_id, text, unit="line", seed=7, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of(df, **kw):
    return sorted((tuple(r) for r in infill.transform(df, **kw).collect()), key=repr)


@pytest.fixture(scope="module")
def texts(spark):
    rng, rows = random.Random(4), [(None, "no id\nhere"), (None, None), (-5, "x"), (2**62, "\n\n\n"), (1, ""), (2, None), (3, "\n"), (4, "a\nb"), (4, "a\nb"), (5, "a <P> b\n"), (6, "<S\n>"), (7, "<M>"), (8, "é😀\r\n日本\n"), (9, "x" * 300_000), (10, "y\n" * 200_000), (11, "<<P"), (12, ">P<\n<")]
    for k in range(3000):
        rows.append((100 + k, "".join(rng.choice(["a", "é", "日", "😀", "\n", "\r", " ", "\t", "<", "P", ">", "S", "M", "\x85", " "]) for _ in range(rng.randint(0, 40)))))
    rows += [(10_000 + k, t) for k in range(30) for t in ("ab<P", ">cd", "", "<P>")]  # marks over the border of rows aren't marks
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "form", "output", "h1", "prefix_chars")})


@pytest.mark.parametrize("unit", UNITS)
def test_all_rows_equal_the_plain_version(texts, unit):
    want = sorted((plain(r["doc_id"], r["text"], unit) for r in texts.select("doc_id", "text").collect()), key=repr)
    assert rows_of(texts, unit=unit) == want


def test_rates_and_seed(texts):
    for kw in ({"rate": 0}, {"rate": 40, "seed": 3}, {"spm_rate": 0}, {"spm_rate": 100, "seed": 11}):
        assert rows_of(texts, **kw) == sorted((plain(r["doc_id"], r["text"], **kw) for r in texts.select("doc_id", "text").collect()), key=repr)


def test_texts_come_back(texts):
    made = infill.transform(texts).withColumn("again", infill.restored(F.col("output"), F.col("form")))
    want = sorted((r["doc_id"] or 0, r["text"] or "") for r in texts.select("doc_id", "text").collect())
    assert sorted((r["doc_id"] or 0, r["again"]) for r in made.collect()) == want


def test_query(spark, sf_dir):
    rows = infill.op11_fill_in_middle(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(r["doc_id"], texts[r["doc_id"]])
        assert tuple(r) == (*want[:5], sha(want[5]), sha(texts[r["doc_id"]]))


def test_nothing(spark):
    assert rows_of(spark.createDataFrame([], "doc_id long, text string")) == []
