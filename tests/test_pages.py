"""Pages of a stand-in format, whose reader notes each page that it is asked for."""

import json

import pytest
from pyspark.sql import functions as F

from vellum.sources import pages as P


def opener_noting(log):
    class Document:
        def __init__(self, path):
            with open(path, encoding="utf-8") as f:
                self.pages = json.load(f)
            self.path = path

        def __len__(self):
            return len(self.pages)

        def __getitem__(self, page):
            with open(log, "a", encoding="utf-8") as f:
                f.write(f"{self.path}\t{page}\n")
            if self.pages[page] is None:
                raise ValueError("torn page")
            return self.pages[page]

    return Document


@pytest.fixture
def library(spark, tmp_path):
    folder, log = tmp_path / "books", tmp_path / "log"
    (folder / "deep").mkdir(parents=True)
    log.touch()
    texts = {"a.bk": [f"a {n}" for n in range(2000)], "deep/b.bk": ["b 0", None, "b 2"], "none.bk": []}
    for name, text in texts.items():
        (folder / name).write_text(json.dumps(text), encoding="utf-8")
    (folder / "torn.bk").write_text("[", encoding="utf-8")
    (folder / "other.txt").write_text("[]", encoding="utf-8")
    before = spark.conf.get(P.PUSHDOWN)
    P.register(spark, opener_noting(str(log)), "noted")
    yield spark.read.format("noted").option("path", str(folder)).option("suffix", ".BK"), folder, log
    spark.conf.set(P.PUSHDOWN, before)


def asked(log):
    return [line.split("\t")[1] for line in log.read_text(encoding="utf-8").splitlines()]


def test_all_pages_and_what_has_none(library):
    reader, folder, _ = library
    rows = reader.option("split_bytes", 1000).load().collect()
    own = {n: [r for r in rows if r["path"] == str(folder / n)] for n in ("a.bk", "deep/b.bk", "none.bk", "torn.bk")}
    assert len(rows) == sum(map(len, own.values()))
    assert sorted((r["page"], r["text"]) for r in own["a.bk"]) == [(n, f"a {n}") for n in range(2000)] and {r["pages"] for r in own["a.bk"]} == {2000}
    assert [(r["page"], r["text"], r["error"]) for r in own["deep/b.bk"]] == [(0, "b 0", None), (1, None, "ValueError: torn page"), (2, "b 2", None)]
    assert [(r["pages"], r["page"], r["error"]) for r in own["none.bk"]] == [(0, None, None)]
    assert len(own["torn.bk"]) == 1 and own["torn.bk"][0]["pages"] is None and "JSONDecodeError" in own["torn.bk"][0]["error"]


def test_large_files_are_split_and_small_ones_gathered(library):
    reader, folder, _ = library
    size = (folder / "a.bk").stat().st_size
    assert reader.option("split_bytes", 1000).load().rdd.getNumPartitions() == -(-size // 1000) + 1
    assert reader.option("split_bytes", 1 << 20).load().rdd.getNumPartitions() == 1


def test_a_sample_reads_its_pages_only(library):
    reader, folder, log = library
    rows = reader.option("sample", 12).option("split_bytes", 1000).load().filter(F.col("path") == str(folder / "a.bk")).collect()
    assert [r["page"] for r in rows] == P.sample_of(2000, 12) and len(rows) == 12 and rows[-1]["text"] == "a 1999"
    assert len(asked(log)) == 12 + 3


def test_conditions_on_pages_reach_the_reader(spark, library):
    reader, _, log = library
    spark.conf.set(P.PUSHDOWN, "true")
    P.register(spark, opener_noting(str(log)), "noted")
    for condition, pages in [(F.col("page").isin(3, 1700), [3, 1700]), ((F.col("page") >= 1995) & (F.col("page") < 1998), [1995, 1996, 1997]), (F.col("page") == 0, [0, 0]), ((F.col("page") > 1) & (F.col("page") <= 3), [2, 2, 3])]:
        log.write_text("", encoding="utf-8")
        rows = reader.load().filter(condition).collect()
        assert sorted(r["page"] for r in rows) == pages and sorted(map(int, asked(log))) == pages
    log.write_text("", encoding="utf-8")
    assert reader.load().filter((F.col("page") < 2) | (F.col("text") == "a 7")).count() == 5
    spark.conf.set(P.PUSHDOWN, "false")
    P.register(spark, opener_noting(str(log)), "noted")
    assert sorted(r["page"] for r in reader.load().filter(F.col("page") == 0).collect()) == [0, 0]


def test_samples_are_those_of_the_expression(spark):
    from vellum.operators.inventory import sample_indices

    df = spark.range(0, 60).select(F.col("id").cast("int").alias("n"))
    for r in df.select("n", sample_indices(F.col("n")).alias("x")).collect():
        assert r["x"] == P.sample_of(r["n"], 12)


def test_empty_folders_and_missing_paths(spark, tmp_path):
    P.register(spark, opener_noting(str(tmp_path / "log")), "noted")
    assert spark.read.format("noted").option("path", str(tmp_path)).option("suffix", ".bk").load().collect() == []
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("noted").load().collect()
