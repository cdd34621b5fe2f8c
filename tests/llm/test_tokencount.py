"""Token counts against the library on whole texts, and their defined results at the edges."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from vellum.llm import tokencount

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)


def plain(rows):
    out = [(i, len((t or "").encode()), len(LIBRARY.encode(t or "")), len(LIBRARY.encode(t or "")) > 4096) for i, t in rows]
    return sorted(out, key=repr)


def rows_of(df, **kw):
    return sorted((tuple(r) for r in tokencount.token_counts(df, PATH, **kw).collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (3, " "), (4, "\n"), (5, " \n \n\n  x"), (6, "a "), (7, "a\n"), (8, "▁a▁ ▁b"), (9, "<s>a</s> <unk> <0x0A>"), (None, "no id"), (None, "no id"), (10, "same twice"), (10, "same twice"), (11, "z" * 60_000), (12, "日本語の文章" * 5000), (13, "word " * 30_000), (14, "\x00\t\r  \x85 \xa0 　")]
    parts = ["the", "word", "é", "日本", "😀", " ", "  ", "\n", "\t", "▁", "1", "23", ".", "<s>", "\r\n", "​", "ing", "A", "\xa0", "\x00", "ﬁ"]
    rows += [(100 + k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for k in range(4000)]
    return rows


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "pretoken", "times", "pieces", "n_bytes")})


def test_equals_the_library(frame, texts):
    assert rows_of(frame) == plain(texts)


@pytest.mark.parametrize("head, often", [(0, 8), (400, 1), (20_000, 2), (10**8, 1)])
def test_the_head_changes_no_count(frame, texts, head, often):
    assert rows_of(frame, head_bytes=head, often=often) == plain(texts)


def test_head_is_bounded(frame):
    found = tokencount.frequent(frame, 1).cache()
    size = lambda df: sum(len(r["pretoken"].encode()) + tokencount.ENTRY for r in df.collect())
    for most in (0, 1000, 50_000, 10**9):
        head = tokencount.head_of(found, most)
        assert size(head) <= most
        assert not head.count() or head.agg(F.min("times")).first()[0] >= found.join(head, "pretoken", "left_anti").agg(F.coalesce(F.max("times"), F.lit(0))).first()[0]


def test_each_distinct_pretoken_is_encoded_once(spark, monkeypatch):
    import pyarrow as pa

    asked, count_all = [], tokencount.count_all
    monkeypatch.setattr(tokencount, "count_all", lambda tokens, path: asked.extend(tokens.to_pylist()) or count_all(tokens, path))
    taken = []
    monkeypatch.setattr(tokencount, "map_batches", lambda df, run, schema: taken.append(run))
    tokencount.merged(None, PATH)
    batch = lambda rows: pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=["row", "pretoken", "times"])
    parts = [batch([(1, " a", 2), (2, " a", 1), (1, " internationalization", 1)]), batch([(5, " internationalization", 3)]), batch([(7, " internationalization", 1), (7, "\nx y", 2)])]
    got = [tuple(r.values()) for b in taken[0](iter(parts)) for r in b.to_pylist()]
    n = len(LIBRARY.encode("internationalization"))
    assert got == [(1, 2), (2, 1), (1, n), (5, 3 * n), (7, n), (7, 2 * (len(LIBRARY.encode("\nx y")) - 1))]
    assert asked == [" a", " internationalization", "\nx y"]


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in tokencount.op13_token_counts(spark, sf_dir).collect()), key=repr) == plain(rows)


def test_nothing(spark):
    assert rows_of(spark.createDataFrame([], "doc_id long, text string")) == []


def test_another_model_is_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.pieces[300].piece = "a▁b"
    (tmp_path / "crossing.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="crosses"):
        tokencount.Pieces(str(tmp_path / "crossing.model"))
    model.pieces[300].piece = "qzxqzxj"
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="changes"):
        tokencount.Pieces(str(tmp_path / "other.model"))
