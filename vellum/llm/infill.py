"""Fill-in-middle transformation of whole texts.

A text is cut into units (lines, words or characters), a prefix, a middle and a suffix are chosen among them by a hash of the
document's id, and the parts are put together in one of two orders, each after its mark: psm (prefix, suffix, middle) or
spm (suffix, prefix, middle). Texts that are empty, hold a mark themselves or fall outside the rate stay plain.

The kernel works on a batch's UTF-8 bytes as one array: each byte gets its class from a table, the classes of adjacent
bytes tell where a unit begins, running sums less their value at the document's first byte number units and code points,
and one ``searchsorted`` finds the byte of every cut of every row. Parts are slices of the same buffer, joined by Arrow;
no Python object is made for a row.

``restored`` rebuilds a text from output and form by expressions alone. A mark can't arise at the seam of a part and a
mark, as no mark's end is a mark's beginning, so each mark's only place in an output is where it was put.

A null text counts as empty; a null doc_id is hashed like an empty string. Repeated rows get equal results; an empty table
gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import chunks, map_batches, table

# Marks, seed and rates in hundredths.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50

OTHER, NEWLINE, SPACE, CONTINUED = 0, 1, 2, 3
CLASS = np.zeros(256, np.uint8)
CLASS[[9, 11, 12, 13, 32]] = SPACE
CLASS[10] = NEWLINE
CLASS[0x80:0xC0] = CONTINUED

#: [class of the byte before, class of a byte]: whether a unit begins at the byte. A line holds the line feed that ends
#: it, a word the white space after it (ASCII's); a text's first byte begins a unit whatever it is.
BEGINS = {unit: np.zeros((4, 4), bool) for unit in ("line", "word", "char")}
BEGINS["line"][NEWLINE, :] = True
BEGINS["word"][np.ix_([NEWLINE, SPACE], [OTHER, CONTINUED])] = True
BEGINS["char"][:, [OTHER, NEWLINE, SPACE]] = True

OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def row_has(raw: np.ndarray, offsets: np.ndarray, mark: bytes) -> np.ndarray:
    """Whether each row holds ``mark``."""
    n, size = len(raw), len(mark)
    if n < size:
        return np.zeros(len(offsets) - 1, bool)
    found = np.ones(n - size + 1, bool)
    for k, byte in enumerate(mark):
        found &= raw[k : n - size + 1 + k] == byte
    at = np.flatnonzero(found)
    row = np.searchsorted(offsets, at, "right") - 1
    out = np.zeros(len(offsets) - 1, bool)
    out[row[at + size <= offsets[row + 1]]] = True
    return out


def cuts(raw: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: its units, the bytes where its middle begins and ends, and the code points of prefix and middle."""
    kind = CLASS[raw]
    mask = np.zeros(len(raw), bool)
    mask[1:] = begins[kind[:-1], kind[1:]]
    mask[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    small = np.int32 if len(raw) < 2**31 - 2 else np.int64
    units = np.cumsum(mask, dtype=small)
    points = np.r_[small(0), np.cumsum(kind != CONTINUED, dtype=small)]
    before = np.r_[small(0), units][offsets].astype(np.int64)  # units before each row: where its own count begins anew
    n = before[1:] - before[:-1]
    one, two = h1 % (n + 1), h2 % (n + 1)
    wanted = np.r_[before[:-1] + np.minimum(one, two), before[:-1] + np.maximum(one, two)] + 1
    at = np.searchsorted(units, wanted.astype(small))  # the byte that begins the unit after the cut; a row's end for its last
    start, end = at[: len(n)], at[len(n) :]
    return n, start, end, (points[start] - points[offsets[:-1]]).astype(np.int64), (points[end] - points[start]).astype(np.int64)


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = "line") -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars and middle_chars (code points; null if plain), output."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashed = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    begins = BEGINS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [batch.column(f"h{k + 1}").to_numpy() for k in range(4)]
            texts = batch.column("text")
            for lo, hi, raw, offsets in chunks(texts):
                h1, h2, h3, h4 = (h[lo:hi] for h in drawn)
                n, start, end, prefix, middle = cuts(raw, offsets, h1, h2, begins)
                plain = (offsets[:-1] == offsets[1:]) | (h3 % 100 >= rate)
                for mark in (PREFIX, SUFFIX, MIDDLE):
                    plain |= row_has(raw, offsets, mark.encode())
                spm = h4 % 100 < spm_rate
                edges = np.r_[np.c_[offsets[:-1], start, end].ravel(), offsets[-1]].astype(np.int64)
                parts = pa.LargeStringArray.from_buffers(3 * len(n), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw)))
                p, m, s = (parts.take(pa.array(np.arange(k, 3 * len(n), 3))) for k in range(3))
                large = lambda x: pa.scalar(x, pa.large_string())
                psm = pc.binary_join_element_wise(large(PREFIX), p, large(SUFFIX), s, large(MIDDLE), m, large(""))
                own = pc.if_else(pa.array(spm), pc.binary_join_element_wise(large(SUFFIX), s, large(PREFIX), p, large(MIDDLE), m, large("")), psm)
                whole = pc.fill_null(texts.slice(lo, hi - lo).cast(pa.large_string()), "")
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(n),
                        pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm"))),
                        pa.array(prefix, mask=plain),
                        pa.array(middle, mask=plain),
                        pc.if_else(pa.array(plain), whole, own).cast(pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *hashed), run, OUT)


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given."""
    before = lambda x, mark: F.substring_index(x, mark, 1)
    after = lambda x, mark: F.substring_index(x, mark, -1)
    body = F.substr(output, F.lit(4))  # after the first mark
    psm_rest, spm_rest = after(body, SUFFIX), after(body, PREFIX)
    psm = F.concat(before(body, SUFFIX), after(psm_rest, MIDDLE), before(psm_rest, MIDDLE))
    spm = F.concat(before(spm_rest, MIDDLE), after(spm_rest, MIDDLE), before(body, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
