"""Personal data by bootstrapped contextual extraction.

The base patterns (e-mail, IP address, card, phone) give seed entities. Every seed, and every other token that looks
like an identifier (``DIGITS`` digits or more, or an at sign), stands in a context, which gives lexical patterns: the
two words before it, and the words on either side. Context words are whole; one of over ``LONG`` characters is written
as its digest, and so is every instance, so that rows stay short and different texts stay apart. Patterns and instances form a bipartite graph, which Spark scores
in turns: a pattern's confidence is the mean score of its different instances, seeds having the score 1 and unknown
instances what the patterns of the last turn give them, by noisy-or; a pattern needs ``SUPPORT`` different seeds.
After ``ROUNDS`` turns, patterns of confidence ``CONFIDENT`` or more discover the unknown identifiers that stand in
them (kind ``found``).

Whole texts are read once; what is kept of a document are its spans and the contexts of its identifiers, by a key of
the row. Counts go through partial aggregates on (pattern, instance), so copies and common patterns collapse before
they are shuffled. A very common pattern or instance is spread over tasks by adaptive execution: both sides of each
join are written tables, whose exchanges it can split.

Spans are kind:start:end in code points, the end exclusive. A null or empty text has none. Repeated rows are scanned
alike; columns other than doc_id and text are only read by ``redact``, which keeps them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from vellum.llm.common import byte_slices, map_batches, shared_checkpoint, table

KINDS = ("email", "ip", "card", "phone", "found")
SUPPORT = 3
ROUNDS = 3
CONFIDENT = 0.8
DIGITS = 5
PATTERNS = 200_000

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")  # no match begins inside a run of digits
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SOME = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[0-9@][A-Za-z0-9@._%+#-]*")
TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@._%+#-")
WORD = re.compile(r"\w+")
BETWEEN = re.compile(r"[ \t,.;:)\"']*")
LONG = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain: from each at sign to the left as far as the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in EMAIL_CHARS:
            begin -= 1
        end = at + 1
        if begin < at and (m := DOMAIN.match(text, end)):
            end = last = m.end()
            yield begin, end
        at = text.find("@", end)


EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    if not SOME.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255 for part in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[ -]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def identifiers(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens that look like identifiers and touch no base span."""
    if not SOME.search(text):
        return
    last, k = 0, 0
    spans = sorted((a, b) for a, _, b in base)
    for m in TOKEN.finditer(text):
        begin = m.start()
        if begin < last:
            continue
        while begin > last and text[begin - 1] in TOKEN_CHARS:
            begin -= 1
        end = last = m.end()
        while end > begin and text[end - 1] in ".%+#-_@":
            end -= 1
        while k < len(spans) and spans[k][1] <= begin:
            k += 1
        if any(a < end and begin < b for a, b in spans[k : k + 4]):
            continue
        token = text[begin:end]
        if sum(c.isdigit() for c in token) >= DIGITS or 0 < token.find("@") < len(token) - 1:
            yield begin, end


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


class Words:
    """The words of a text, which also end and begin at the borders of spans, and so never hold two of them."""

    def __init__(self, text: str, spots: list[tuple[int, int, bool]]):
        self.text, self.start, self.end = text, [], []
        borders = sorted({x for a, b, _ in spots for x in (a, b)})
        k = 0
        for m in WORD.finditer(text):
            begin, end = m.span()
            while k < len(borders) and borders[k] <= begin:
                k += 1
            while k < len(borders) and borders[k] < end:
                self.start.append(begin)
                self.end.append(borders[k])
                begin = borders[k]
                k += 1
            self.start.append(begin)
            self.end.append(end)

    def word(self, k: int) -> str:
        own = self.text[self.start[k] : self.end[k]].lower()
        return own if len(own) <= LONG else "#" + digest(own)

    def contexts(self, start: int, end: int) -> list[str]:
        """The lexical patterns in which a span stands."""
        last = bisect_right(self.end, start)  # words before the span
        before = [self.word(k) for k in range(max(0, last - 2), last)]
        after = bisect_left(self.start, end)
        follows = after < len(self.start) and BETWEEN.match(self.text, end, self.start[after]).end() == self.start[after]
        out = []
        if len(before) == 2:
            out.append(f"{before[0]} {before[1]} _")
        if before and follows:
            out.append(f"{before[-1]} _ {self.word(after)}")
        return out


def spotted(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, bool, list[str]]]:
    """Start, end, whether it is a seed, and patterns of each span of ``base`` and of each other identifier."""
    spots = [(a, b, True) for a, _, b in base] + [(a, b, False) for a, b in identifiers(text, base)]
    if spots:
        words = Words(text, spots)
        for a, b, seed in spots:
            yield a, b, seed, words.contexts(a, b)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCAN = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, seen array<struct<start:int,end:int,seed:boolean,instance:string,patterns:array<string>>>"
SEEN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
NOTHING = hashlib.sha256(b"").hexdigest()


def scanned(docs: DataFrame) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and the contexts of all identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                counts = np.zeros((4, part.num_rows), np.int64)
                digests, bases, seens = [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    text = text or ""
                    base = base_spans(text)
                    for _, kind, _ in base:
                        counts[kind, i] += 1
                    digests.append(hashlib.sha256(written(base).encode()).hexdigest() if base else NOTHING)
                    bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                    seens.append([{"start": a, "end": b, "seed": seed, "instance": digest(text[a:b].lower()), "patterns": p} for a, b, seed, p in spotted(text, base) if p])
                yield pa.record_batch([part.column("doc_id"), *(pa.array(c) for c in counts), pa.array(digests, pa.string()), pa.array(bases, BASE), pa.array(seens, SEEN)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "seen"])

    return map_batches(docs.select("doc_id", "text"), run, SCAN)


def confident_patterns(seen: DataFrame, support: int = SUPPORT, rounds: int = ROUNDS, confident: float = CONFIDENT) -> DataFrame:
    """pattern, confidence: what the turns over the pattern-instance graph leave. ``seen`` has the array ``seen``."""
    rows = seen.select(F.explode("seen").alias("s")).select(F.explode("s.patterns").alias("pattern"), "s.instance", "s.seed")
    graph = shared_checkpoint(rows.groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("int")).alias("seed")))
    scores = graph.groupBy("instance").agg(F.max("seed").cast("double").alias("score"))
    trusted = None
    for turn in range(rounds):
        known = graph.join(shared_checkpoint(scores), "instance").groupBy("pattern")
        trusted = known.agg(F.avg("score").alias("confidence"), F.sum("seed").alias("seeds")).filter(F.col("seeds") >= support)
        trusted = shared_checkpoint(trusted.select("pattern", "confidence"))
        if turn < rounds - 1:
            known = graph.join(trusted, "pattern", "left").groupBy("instance")
            scores = known.agg(F.greatest(F.max("seed"), 1 - F.exp(F.sum(F.log(1 - F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.999)))))).alias("score"))
    return trusted.filter(F.col("confidence") >= confident)


def extract(docs: DataFrame, **settings) -> DataFrame:
    """SCAN's columns and ``found``: the spans that patterns discovered."""
    seen = shared_checkpoint(scanned(docs).withColumn("row", F.monotonically_increasing_id()))
    patterns = confident_patterns(seen, **settings)
    spots = seen.select("row", F.explode("seen").alias("s")).filter("not s.seed").select("row", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    found = spots.join(patterns, "pattern").groupBy("row").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("found"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return seen.join(found, "row", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", F.coalesce("found", none).alias("found"))


def redact(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the personal data of each text replaced by its kind in brackets, and n_chars, where there is such
    a column, counted anew. Confident patterns reach the tasks in blocks of at most ``PATTERNS``: each block adds the
    places it finds in the original text to a column, which is written before the next one comes, and the text is
    rewritten once, after the last."""
    seen = scanned(docs).select("seen")
    patterns = shared_checkpoint(confident_patterns(seen, **settings).select("pattern"))
    shares = max(1, -(-patterns.count() // PATTERNS))
    schema, places = docs.schema, "places"
    while places in docs.columns:
        places += "_"
    held = StructType([*schema.fields, StructField(places, ArrayType(LongType()))])
    for k in range(shares):
        part = patterns if shares == 1 else patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(shares)) == k)
        shared = docs.sparkSession.sparkContext.broadcast(frozenset(part.toArrow().column("pattern").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in byte_slices(whole):
                    at, count = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
                    texts, sizes = batch.column(at).to_pylist(), batch.column(count).to_pylist() if count >= 0 else None
                    known = batch.column(len(schema)).to_pylist() if k else [[] for _ in texts]
                    for i, text in enumerate(texts):
                        if not text:
                            continue
                        base = base_spans(text)
                        before = set(known[i])  # starts of the identifiers that earlier blocks found
                        tokens = [(a, 4, b) for a, b, seed, patterns in spotted(text, base) if not seed and (a in before or any(p in shared.value for p in patterns))]
                        if k < shares - 1:
                            known[i] = [a for a, _, _ in tokens]
                            continue
                        if spans := sorted(base + tokens):
                            texts[i] = rewritten(text, spans)
                            if sizes is not None and sizes[i] is not None:
                                sizes[i] = len(texts[i])
                    columns, names = list(batch.columns)[: len(schema)], batch.schema.names[: len(schema)]
                    if k < shares - 1:
                        columns, names = [*columns, pa.array(known, pa.list_(pa.int64()))], [*names, places]
                    else:
                        columns[at] = pa.array(texts, batch.schema.field(at).type)
                        if sizes is not None:
                            columns[count] = pa.array(sizes, batch.schema.field(count).type)
                    yield pa.record_batch(columns, names=names)

        docs = map_batches(docs if k == 0 else shared_checkpoint(docs), run, held if k < shares - 1 else schema)
    return docs


def rewritten(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span's kind in its place; of spans that overlap, the first one's."""
    out, last = [], 0
    for a, kind, b in spans:
        if b > last:
            out.append(text[last : max(a, last)])
            if a >= last:
                out.append(f"[{KINDS[kind].upper()}]")
            last = b
    return "".join(out) + text[last:]


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents"))
    spans = F.array_sort(F.concat("base", "found"))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), F.size("found").cast("long").alias("n_found"))
