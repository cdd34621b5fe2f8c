"""Best-fit packing of documents into sequences by bin completion.

1. Every whole text becomes token ids, ended by id 0; longer documents are cut into pieces of at most ``capacity``.
2. The lengths of all pieces are counted. There are at most ``capacity`` different lengths, whatever the corpus holds.
3. On that histogram the driver solves the packing by bin completion with branch and bound: around the largest length
   left it looks for the undominated filling with the least waste, with the best-fit filling as incumbent, and uses
   the filling as often as the counts allow. The plan is a table of runs, whose size follows the number of lengths.
4. Every piece gets its rank among the pieces of its length, by counts for each partition and running sums, and the
   plan turns (length, rank) into (sequence, offset). No task ever holds a length's pieces together.

A null or empty text has the ids [0]. Repeated rows are packed as often as they stand in the input; an empty table
gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import CHUNK, U64, map_batches, shared_checkpoint, span_hash, table

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class WordTokenizer:
    """The ids of whole texts, each different word being encoded by the tokenizer library once.

    The vocabulary's pre-tokenizer cuts a text into runs of letters, single digits and runs of other characters, and
    no merge crosses a cut; so the ids of a text are those of its words in order. The cuts are made on arrays of code
    points; ids of words already met are kept as sorted arrays, at most ``keep`` words.
    """

    def __init__(self, path: str, keep: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keep = keep
        kinds = {"L": LETTER, "N": DIGIT}
        self.kind = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        self.kind[WHITE] = SPACE
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte_chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.count, self.flat = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word in an array of code points."""
        n = len(codes)
        kind = self.kind[codes]
        before = np.zeros(n, np.uint8)
        before[1:] = kind[:-1]
        starts = (kind != SPACE) & ((kind != before) | (kind == DIGIT))
        for p in np.flatnonzero((codes == 39) & (before != OTHER)):  # 's 't 're 've 'm 'll 'd
            after = codes[p + 1 : p + 3]
            if len(after) and kind[p + 1] == LETTER:
                one, two = chr(after[0]), "".join(map(chr, after))
                if size := 1 if one in "st" else 2 if two in ("re", "ve") else 1 if one == "m" else 2 if two == "ll" else 1 if one == "d" else 0:
                    starts[p + 1] = False
                    if p + 1 + size < n and kind[p + 1 + size] == LETTER:
                        starts[p + 1 + size] = True
        start = np.flatnonzero(starts)
        ends = np.flatnonzero((kind != SPACE) & np.r_[(kind[1:] == SPACE) | starts[1:], True]) + 1
        return start, ends

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids = [[t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.byte_chars))] for w in words]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.flat) + np.cumsum(count) - count
        self.flat = np.r_[self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))]
        merged = np.r_[self.keys, keys]
        order = np.argsort(merged, kind="stable")
        self.keys, self.first, self.count = merged[order], np.r_[self.first, first][order], np.r_[self.count, count][order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and len(texts) + 1 offsets."""
        joined = "\n".join(texts)
        if not joined.isascii() and not unicodedata.is_normalized("NFC", joined):
            texts = [unicodedata.normalize("NFC", t) for t in texts]
        own = [i for i, t in enumerate(texts) if SPECIAL[0] in t or SPECIAL[1] in t] if "<|" in joined else []
        lowered = [t.replace("Σ", "σ").lower() for t in texts]  # a final sigma isn't told apart
        joined = "\n".join(lowered)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        start, end = self.words(codes)
        hashed = span_hash(codes, start, end)
        keys, at, back = np.unique(hashed, return_index=True, return_inverse=True)
        if len(self.keys) > self.keep:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        if len(new := np.flatnonzero(~known)):
            self.learn(keys[new], [joined[start[i] : end[i]] for i in at[new]])
            place = np.searchsorted(self.keys, keys)
        count, first = self.count[place][back], self.first[place][back]
        total = np.cumsum(count)
        flat = self.flat[np.repeat(first - total + count, count) + np.arange(int(total[-1]) if len(total) else 0)]
        edge = np.cumsum([len(t) + 1 for t in lowered], dtype=np.int64)  # of the text and the line feed after it
        words_before = np.searchsorted(start, np.r_[0, edge])
        offsets = np.r_[0, total][words_before]
        if own:
            whole = {i: self.tokenizer.encode(texts[i], add_special_tokens=False).ids for i in own}
            parts = [np.array(whole[i], np.uint32) if i in whole else flat[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        return flat, offsets


_tokenizers: dict[str, WordTokenizer] = {}


def cut_texts(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, in PIECES' columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokenizers:
            _tokenizers.clear()
            _tokenizers[tokenizer_path] = WordTokenizer(tokenizer_path)
        encode = _tokenizers[tokenizer_path].encode
        for batch in batches:
            doc_ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            row = 0
            while row < len(texts):
                end = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + CHUNK, "right")))
                ids, at = encode(texts.slice(row, end - row).to_pylist())
                which, piece, start, length, crc = [], [], [], [], []
                for i in range(end - row):
                    own = np.zeros(at[i + 1] - at[i] + 1, "<u4")
                    own[:-1] = ids[at[i] : at[i + 1]]
                    for k, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        which.append(row + i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.record_batch([doc_ids.take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
                row = end

    return map_batches(docs.select("doc_id", "text"), run, PIECES)


def fillings(residual: int, longest: np.ndarray, count: np.ndarray, nodes: int = 20_000) -> list[int]:
    """The lengths, largest first, that fill ``residual`` with the least waste.

    ``longest[s]`` is the largest length left of at most s, 0 if none. The incumbent is the best-fit filling; the
    search takes lengths in falling order, so each set is met once, and leaves a branch whose waste can't fall below
    the incumbent's. Of two fillings of the same waste the one with the larger lengths stays, which dominates. The
    search ends at waste 0 or after ``nodes`` nodes, a bound on time that leaves the incumbent in place.
    """
    left = {}

    def spare(x: int) -> int:
        return int(count[x]) - left.get(x, 0)

    def below(s: int) -> int:
        x = int(longest[s]) if s > 0 else 0
        while x and spare(x) <= 0:
            x = int(longest[x - 1])
        return x

    best: list[int] = []
    room = residual
    while x := below(room):
        best.append(x)
        left[x] = left.get(x, 0) + 1
        room -= x
    left.clear()
    waste, seen = room, 0
    if waste == 0:
        return best
    chosen: list[int] = []

    def search(room: int, most: int, depth: int) -> bool:
        nonlocal best, waste, seen
        x = below(min(room, most))
        while x:
            seen += 1
            if seen > nodes:
                return True
            if room - x * min(depth, room // x) >= waste:  # the lengths to come are at most x each
                return False
            chosen.append(x)
            left[x] = left.get(x, 0) + 1
            if room - x < waste:
                best, waste = chosen.copy(), room - x
            stop = waste == 0 or (depth > 1 and search(room - x, x, depth - 1))
            left[x] -= 1
            chosen.pop()
            if stop:
                return True
            x = below(x - 1)
        return False

    for depth in (2, 3, 4):  # fillings of few lengths first
        if search(residual, residual, depth) or waste == 0:
            break
    return best


def completion_plan(counts: dict[int, int], capacity: int = CAPACITY, search: bool = True) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, bins, first bin, offset), and the number of bins.

    With ``search`` off every bin is filled by best fit.
    """
    count = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        count[length] = n
    used = np.zeros(capacity + 1, np.int64)
    runs, bins = [], 0
    have = np.where(count > 0, np.arange(capacity + 1), 0)
    longest = np.maximum.accumulate(have)
    while longest[capacity]:
        largest = int(longest[capacity])
        count[largest] -= 1
        own = [largest, *fillings(capacity - largest, longest, count, 20_000 if search else 0)]
        count[largest] += 1
        times = min(int(count[x]) // own.count(x) for x in set(own))
        offset = 0
        for x in own:
            runs.append((x, int(used[x]), times, bins, offset))
            used[x] += times
            count[x] -= times
            offset += x
        bins += times
        have[count == 0] = 0
        longest = np.maximum.accumulate(have)
    return runs, bins


def undominated(residual: int, largest: int, count: np.ndarray, spend: Callable[[], bool]) -> Iterator[list[int]]:
    """Fillings of ``residual`` beside one ``largest`` to which nothing left can be added, larger lengths first. A
    filling is dominated, and left out, if one of its lengths can give way to a longer one that is left and fits. They
    are found as they are asked for, when ``count`` is as at the first; ``spend`` is asked before each length is added."""
    have = np.where(count > 0, np.arange(len(count)), 0)
    longest = np.maximum.accumulate(have).tolist()
    left = {largest: 1}

    def below(s: int) -> int:
        x = longest[s] if s > 0 else 0
        while x and count[x] <= left.get(x, 0):
            x = longest[x - 1]
        return x

    own: list[int] = []
    room, x = residual, below(residual)
    while True:
        while x:
            if not spend():
                return
            own.append(x)
            left[x] = left.get(x, 0) + 1
            room -= x
            x = below(min(room, x))
        if not below(room) and not any(below(min(y + room, len(longest) - 1)) > y for y in set(own)):
            yield own.copy()
        while own and not x:
            y = own.pop()
            left[y] -= 1
            room += y
            x = below(y - 1)
        if not x:
            return


def best_plan(counts: dict[int, int], capacity: int = CAPACITY, steps: int | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Bin completion with branch and bound over whole plans.

    The incumbent is the better of best fit and of completing each largest length with its best filling. While it has
    more bins than the total length asks for, other undominated fillings of the largest length are tried, each as often
    as the counts allow; a branch whose waste so far rules out fewer bins than the incumbent's is left. ``steps`` bounds
    the fillings that are tried, and ten times as many bound the lengths that are added in looking for them; the
    incumbent stands when either is reached. Unless given, it is 2000 and 10 for each different length.
    """
    best = min((completion_plan(counts, capacity, search) for search in (True, False)), key=lambda p: p[1])
    total = sum(length * n for length, n in counts.items())
    count = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        count[length] = n
    steps = 2000 + 10 * len(counts) if steps is None else steps
    taken, added = 0, 0
    # A stack of levels, each a list of fillings still to try, and what the level has applied.
    stack: list[tuple[Iterator[list[int]], int, int]] = []
    applied: list[tuple[list[int], int]] = []

    def spend() -> bool:
        nonlocal added
        added += 1
        return added <= 10 * steps

    def fillings_of() -> Iterator[list[int]]:
        present = np.flatnonzero(count)
        if not len(present):
            return
        largest = int(present[-1])
        count[largest] -= 1
        have = np.where(count > 0, np.arange(capacity + 1), 0)
        first = fillings(capacity - largest, np.maximum.accumulate(have), count)
        count[largest] += 1
        yield [largest, *first]
        yield from ([largest, *f] for f in undominated(capacity - largest, largest, count, spend) if f != first)

    def runs_now() -> list[tuple[int, int, int, int, int]]:
        out, bins, spent = [], 0, {}
        for own, times in applied:
            offset = 0
            for x in own:
                out.append((x, spent.get(x, 0), times, bins, offset))
                spent[x] = spent.get(x, 0) + times
                offset += x
            bins += times
        return out

    stack.append((fillings_of(), 0, 0))
    while stack and taken < steps and best[1] > -(-total // capacity):
        options, bins, waste = stack[-1]
        own = next(options, None)
        if own is None:
            stack.pop()
            if applied and len(applied) >= len(stack):
                last, times = applied.pop()
                for x in last:
                    count[x] += times
            continue
        taken += 1
        times = min(int(count[x]) // own.count(x) for x in set(own))
        more = waste + times * (capacity - sum(own))
        if more > (best[1] - 1) * capacity - total:
            continue
        for x in own:
            count[x] -= times
        applied.append((own, times))
        if not count.any():
            if bins + times < best[1]:
                best = runs_now(), bins + times
            for x in own:
                count[x] += times
            applied.pop()
            continue
        stack.append((fillings_of(), bins + times, more))
    return best


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset."""
    pieces = shared_checkpoint(cut_texts(docs, tokenizer_path, capacity).withColumn("part", F.spark_partition_id()))
    here = pieces.groupBy("length", "part").count()
    counts = {r["length"]: r["n"] for r in here.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    runs, _ = best_plan(counts, capacity)
    runs.sort()
    of, low, times, first, place = (np.array(x, np.int64) for x in (zip(*runs) if runs else ([],) * 5))
    key = of * (1 << 48) + low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 48) + rank, "right") - 1
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(first[at] + rank - low[at]), pa.array(place[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = here.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    ranked = pieces.withColumn("own", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    return map_batches(ranked, run, PIECES + ", sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
