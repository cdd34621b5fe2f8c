"""Token counts by counting each distinct pre-token once.

1. Every whole text falls into pre-tokens: a run of spaces with what stands behind it up to the next space or line feed,
   or a line feed with what stands behind it. No piece of the vocabulary holds a space behind another character or a
   line feed beside one, so no merge crosses the border of a pre-token and a text's count is the sum of its
   pre-tokens' counts. The model is held against this when it is loaded, and refused if it differs.
2. Each document's pre-tokens are counted in numpy on Arrow buffers: row, pre-token, frequency.
3. Pre-tokens that are frequent within a batch are the dictionary's head, as many of the most frequent as ``head_bytes``
   hold. The library encodes each once; the head is broadcast and joined to the documents' frequencies.
4. All other pre-tokens' frequencies are dealt out and sorted by pre-token; no key is frequent there. A task encodes each
   distinct one once where its run begins and joins the count to the run's frequencies. Products are summed by document.

Which pre-tokens are in the head doesn't change a count, only what is shuffled. No text's ids are ever made.

A null or empty text has no tokens. Repeated rows, and rows with a doc_id that is null or not unique, are counted each for
itself; an empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import chunks, map_batches, shared_checkpoint, table

LIMIT = 4096
HEAD_BYTES = 16 << 20  # of the dictionary's broadcast part, pre-tokens with ENTRY bytes each
OFTEN = 2  # times in about a megabyte of texts
ENTRY = 48
MARK = "▁"  # stands for a space in pieces; in a text it is one
SPACE, NEWLINE = 32, 10


def pretoken_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first byte of each pre-token. Each row that isn't empty begins with a space."""
    space = raw == SPACE
    mask = raw == NEWLINE
    mask[1:] |= space[1:] & ~space[:-1]
    mask[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(mask)


def spaced(texts: pa.Array) -> pa.Array:
    """The texts as the model sees them: marks are spaces, and one space stands before a text that isn't empty."""
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        texts = pc.replace_substring(texts, MARK, " ")
    empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    texts = texts.cast(pa.large_string())
    return pc.if_else(pc.equal(texts, empty), empty, pc.binary_join_element_wise(space, texts, empty))


def pretokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.DictionaryArray]]:
    """(first row, offsets of the rows, first bytes of the pre-tokens, pre-tokens) of runs of rows."""
    for lo, _, raw, offsets in chunks(spaced(texts)):
        start = pretoken_starts(raw, offsets)
        tokens = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.r_[start, len(raw)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
        yield lo, offsets, start, tokens.dictionary_encode()


def frequencies(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_bytes, pretoken, times: a row for each different pre-token of each document, one with a null
    pre-token for a document without any. ``row`` numbers the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            for lo, offsets, start, coded in pretokens(texts):
                row, kinds = np.searchsorted(offsets, start, "right") - 1, max(len(coded.dictionary), 1)
                pairs, times = np.unique(row * kinds + coded.indices.to_numpy(), return_counts=True)
                none = np.flatnonzero(offsets[:-1] == offsets[1:])
                own = pa.array(np.r_[pairs // kinds, none] + lo)
                code = pa.array(np.r_[pairs % kinds, none], mask=np.r_[np.zeros(len(pairs), bool), np.ones(len(none), bool)])
                yield pa.record_batch(
                    [batch.column("row").take(own), batch.column("doc_id").take(own), n_bytes.take(own), coded.dictionary.take(code).cast(pa.string()), pa.array(np.r_[times, np.zeros(len(none), np.int64)])],
                    names=["row", "doc_id", "n_bytes", "pretoken", "times"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, run, "row long, doc_id long, n_bytes long, pretoken string, times long")


def frequent(docs: DataFrame, least: int = OFTEN) -> DataFrame:
    """pretoken, times: those that stand ``least`` times or more in about a megabyte of texts, with what was counted there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, coded in pretokens(pc.fill_null(batch.column("text"), "")):
                times = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                own = np.flatnonzero(times >= least)
                yield pa.record_batch([coded.dictionary.take(pa.array(own)).cast(pa.string()), pa.array(times[own], pa.int64())], names=["pretoken", "times"])

    return map_batches(docs.select("text"), run, "pretoken string, times long").groupBy("pretoken").agg(F.sum("times").alias("times"))


class Pieces:
    """Counts of pre-tokens by the library, for a model in which no piece crosses a pre-token's border."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            special = self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)
            if not special and (MARK in piece.lstrip(MARK) or "\n" in piece and len(piece) > 1):
                raise ValueError(f"{path}: the piece {piece!r} crosses a border of pre-tokens")
        probe = "A Ä①ﬁ\t　x  <s> "  # spaces kept, one put before, nothing else changed
        if self.model.encode(["\n", ""]) != [self.model.encode("") + self.model.encode("\n"), []] or "".join(self.model.decode(self.model.encode(probe))) != probe:
            raise ValueError(f"{path}: the model changes texts before it cuts them")
        self.lone = len(self.model.encode("a ")) - len(self.model.encode("a"))  # a space with nothing behind it

    def count(self, tokens: list[str]) -> list[int]:
        """The library puts a space before what it is given. That is the pre-token's own first space, or one too many
        before a line feed, which is a piece by itself."""
        ids = self.model.encode([t[1:] if t[0] == " " else t for t in tokens], num_threads=1)
        return [len(i) - self.lone if t[0] == "\n" else len(i) if len(t) > 1 else self.lone for t, i in zip(tokens, ids)]


_pieces: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _pieces:
        _pieces.clear()
        _pieces[path] = Pieces(path)
    return _pieces[path]


def count_all(tokens: pa.Array, path: str) -> np.ndarray:
    """The number of pieces of each pre-token; the ids of about 64 kB of them are in memory at a time."""
    sizes = np.cumsum(pc.binary_length(tokens).to_numpy(zero_copy_only=False), dtype=np.int64)
    counts, row = [], 0
    while row < len(tokens):
        end = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + (1 << 16), "right")))
        counts += loaded(path).count(tokens.slice(row, end - row).to_pylist())
        row = end
    return np.array(counts, np.int64)


def dictionary(distinct: DataFrame, path: str) -> DataFrame:
    """pretoken, pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("pretoken"), pa.array(count_all(batch.column("pretoken"), path))], names=["pretoken", "pieces"])

    return map_batches(distinct.select("pretoken"), run, "pretoken string, pieces long")


def merged(dealt: DataFrame, path: str) -> DataFrame:
    """row, n_tokens: the products for frequencies dealt out and sorted by pre-token. A run of a pre-token may cross the border
    of two batches, so the last count is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for batch in batches:
            coded = batch.column("pretoken").dictionary_encode()
            tokens = coded.dictionary  # in the order of the runs
            known = int(len(tokens) > 0 and tokens[0].as_py() == last)
            counts = np.r_[np.full(known, held, np.int64), count_all(tokens.slice(known), path)]
            if len(tokens):
                last, held = tokens[-1].as_py(), int(counts[-1])
            yield pa.record_batch([batch.column("row"), pa.array(batch.column("times").to_numpy() * counts[coded.indices.to_numpy()])], names=["row", "n_tokens"])

    return map_batches(dealt, run, "row long, n_tokens long")


def head_of(found: DataFrame, most: int) -> DataFrame:
    """The most frequent of ``found`` that ``most`` bytes hold. The cut falls between classes of frequency, four to each
    doubling; of these, a sum each comes to the driver."""
    times_class = F.floor(4 * F.log2(F.col("times").cast("double")))
    sums = found.groupBy(times_class.alias("class")).agg(F.sum(F.octet_length("pretoken") + ENTRY).alias("size")).collect()
    held, least = 0, float("inf")
    for c, size in sorted(((r["class"], r["size"]) for r in sums), reverse=True):
        held += size
        if held > most:
            break
        least = c
    return found.filter(times_class >= least)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, head_bytes: int = HEAD_BYTES, often: int = OFTEN) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, for the sentencepiece model at ``path``."""
    head = head_of(shared_checkpoint(frequent(docs, often)), head_bytes)
    head = F.broadcast(shared_checkpoint(dictionary(head, path)))  # head_bytes at most
    found = frequencies(docs)
    product = F.coalesce(F.sum(F.col("times") * F.col("pieces")), F.lit(0)).alias("n_tokens")
    common = found.join(head, "pretoken", "left").groupBy("row", "doc_id", "n_bytes").agg(product)
    dealt = found.select("row", "pretoken", "times").filter(F.col("pretoken").isNotNull()).join(head, "pretoken", "left_anti").repartition("pretoken").sortWithinPartitions("pretoken")
    rare = merged(dealt, path).groupBy("row").agg(F.sum("n_tokens").alias("n_tokens"))
    both = common.unionByName(rare, allowMissingColumns=True).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return both.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
