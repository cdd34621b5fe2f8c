"""Markdown to section-aware chunks: blocks, the packing fold, chunk columns, removal of repeated chunks.

Lines become blocks by expressions on a document's array of lines, heading paths are windows over the table of blocks; only
the fold that packs blocks, whose state is truly sequential, runs as Python on one document at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.functions import text as T
from vellum.operators import cleaning as C
from vellum.operators import inventory as I
from vellum.operators import units as U

# Sizes in estimated tokens and the patterns of headings and sentences.
CHARS = 4
TARGET, OVERLAP, MIN_SECTION, MIN_CHUNK = 800, 100, 100, 20
MAX_TITLE = 150
HEADING = rf"\A(#{{1,6}}){T.WS}++(.*+)\z"
SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÑ¿¡0-9\"(])")
TABLE_RULE = re.compile(r"\|[\s:|-]+\|?")
BLOCK = "doc_id long, block_no int, kind string, text string, page int, path array<string>, level int"


def header_fields(header: Column) -> Column:
    """map<string, string> of front matter; each value is JSON, a string without its quotes."""
    rows = F.filter(F.split(header, "\n"), lambda x: x.contains(":") & ~x.rlike(r"\A-+\z"))
    pairs = F.transform(rows, lambda x: F.struct(T.strip_ws(F.substring_index(x, ":", 1)).alias("k"), T.strip_ws(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("v")))
    value = lambda v: F.when(v == "null", F.lit(None)).when(v.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")).otherwise(v)
    return F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["k"] != ""), lambda p: F.struct(p["k"].alias("k"), value(p["v"]).alias("v"))))


def heading_title(line: Column) -> Column:
    """The text of a heading without white space and a closing run of # behind it; empty if the line is none. One
    character stays in any case, be it white space in a heading of nothing else."""
    body = F.regexp_extract(line, HEADING, 2)
    bare = T.rstrip_ws(F.regexp_replace(T.rstrip_ws(F.substring(body, F.lit(2), F.length(body))), r"(?<!#)#++\z", ""))
    blank = F.right(F.regexp_extract(line, rf"\A#{{1,6}}{T.WS}({T.WS}++)\z", 1), F.lit(1))
    return F.when(~line.startswith("#"), F.lit("")).when(body != "", F.concat(F.left(body, F.lit(1)), bare)).otherwise(blank)


def line_of(kind: str, text: Column | None = None, level: Column | None = None, page: Column | None = None) -> Column:
    """A line as ``blocks_of`` takes it: a mark with its page, a titulo with its level, a tabla, a parrafo or a blank."""
    null = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), (null.cast("string") if text is None else text).alias("text"), (F.lit(0) if level is None else level).alias("level"), (null.cast("int") if page is None else page).alias("page"))


def read_line(line: Column) -> Column:
    """A line of Markdown as ``line_of``. Patterns run only where the first characters allow a match."""
    text = line_of("parrafo", T.rstrip_ws(line))
    title = F.transform(
        F.array(heading_title(line)),
        lambda t: F.when((t != "") & (F.length(t) <= MAX_TITLE), line_of("titulo", F.regexp_replace(t, r"\A[*_ ]++|(?<![*_ ])[*_ ]++\z", ""), F.length(F.regexp_extract(line, HEADING, 1)))).otherwise(text),
    )[0]
    mark = lambda bare: F.transform(F.array(F.regexp_extract(T.rstrip_ws(bare), rf"\A{C.PAGE_MARK_PATTERN}\z", 1)), lambda m: F.when(m != "", line_of("mark", page=m.cast("int"))).otherwise(text))[0]
    return F.transform(
        F.array(F.ltrim(line, F.lit(T.WS_CHARS))),
        lambda bare: F.when(bare == "", line_of("blank")).when(bare.startswith("|"), line_of("tabla", T.rstrip_ws(line))).when(line.startswith("#"), title).when(bare.startswith(C.PAGE_MARK.split("%")[0]), mark(bare)).otherwise(text),
    )[0]


def grouped(lines: Column, page: Column) -> Column:
    """array<struct<kind, text, level, page>> of the blocks of one page's lines, blanks left out."""
    kind = lambda i: F.get(lines, i)["kind"]
    starts = F.array_compact(F.transform(lines, lambda x, i: F.when((i == 0) | (x["kind"] == "titulo") | (x["kind"] != kind(i - 1)), i)))

    def block(s: Column, end: Column) -> Column:
        first = F.get(lines, s)
        text = F.when(end - s == 1, first["text"]).otherwise(F.array_join(F.transform(F.slice(lines, s + 1, end - s), lambda x: x["text"]), "\n"))
        return F.when(first["kind"] != "blank", F.struct(first["kind"].alias("kind"), text.alias("text"), first["level"].alias("level"), page.alias("page")))

    return F.array_compact(F.transform(F.array(starts), lambda found: F.transform(found, lambda s, j: block(s, F.coalesce(F.get(found, j + 1), F.size(lines)))))[0])


def blocks_of(docs: DataFrame, *own: str) -> DataFrame:
    """BLOCK's columns from doc_id and ``lines``, an array of ``line_of``, and the columns ``own`` of the document, which its
    first block has. A page mark, a blank line, a heading or a change between paragraph and table closes a block; a heading
    closes the headings of its level and below. Lines become blocks within their row, so only blocks are shuffled."""

    def pages(lines: Column) -> Column:
        marks = F.concat(F.array(F.lit(-1)), F.array_compact(F.transform(lines, lambda x, i: F.when(x["kind"] == "mark", i))))
        return F.transform(F.array(marks), lambda at: F.transform(at, lambda m, j: F.struct(F.get(lines, m)["page"].alias("page"), F.slice(lines, m + 2, F.coalesce(F.get(at, j + 1), F.size(lines)) - m - 1).alias("lines"))))[0]

    found = F.transform(F.array("lines"), lambda lines: F.flatten(F.transform(pages(lines), lambda p: grouped(p["lines"], p["page"]))))[0]
    df = docs.select("doc_id", *own, F.posexplode(found).alias("block_no", "b")).select("doc_id", "block_no", "b.*", *(F.when(F.col("block_no") == 0, F.col(c)).alias(c) for c in own))
    so_far = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"h{k}": F.last(F.when((F.col("kind") == "titulo") & (F.col("level") == k), F.struct("block_no", "text")), ignorenulls=True).over(so_far) for k in range(1, 7)})
    above = lambda k: [F.coalesce(F.col(f"h{k}.block_no") > F.col(f"h{j}.block_no"), F.lit(True)) for j in range(1, k)]
    path = []
    for k in range(1, 7):
        stays = F.col(f"h{k}").isNotNull()
        for condition in above(k):
            stays = stays & condition
        path.append(F.when(stays, F.col(f"h{k}.text")))
    return df.select("doc_id", "block_no", "kind", "text", "page", F.array_compact(F.array(*path)).alias("path"), "level", *own)


def blocks(docs: DataFrame, *own: str) -> DataFrame:
    """``blocks_of`` Markdown: doc_id and markdown."""
    body = C.split_header(F.col("markdown"))[1]
    read = docs.select("doc_id", *own, F.transform(T.split_lines(body), read_line).alias("lines"))
    return blocks_of(read, *own).withColumn("text", T.strip_ws(F.col("text")))


def tokens(text: str) -> int:
    return max(1, len(text) // CHARS) if text.strip() else 0


def most_chars(limit: int) -> int:
    """The longest text of at most ``limit`` tokens."""
    return CHARS * limit + CHARS - 1


def fitting_runs(parts: list[str], limit: int, head: int = 0) -> Iterator[list[str]]:
    """``parts`` in order, as runs that fit into ``limit`` tokens when joined by one character after ``head``
    characters; each run is as long as it can be, and has one part at least. Ends of runs come from the running sums
    of lengths by bisection."""
    ends = list(accumulate(len(p) + 1 for p in parts))
    begin = 0
    while begin < len(parts):
        spent = ends[begin - 1] if begin else 0
        end = max(begin + 1, bisect_right(ends, spent + most_chars(limit) - head + 1))
        yield parts[begin:end]
        begin = end


def split_paragraph(text: str, limit: int = TARGET) -> list[str]:
    """Runs of sentences; a sentence without an end in sight is cut by length."""
    width = f"(?s).{{1,{limit * CHARS}}}"
    return [part for run in fitting_runs(SENTENCE_END.split(text), limit) for part in re.findall(width, " ".join(run))]


def split_table(text: str, limit: int = TARGET) -> list[str]:
    """Runs of rows, each under the head of the table, which reaches to the first rule."""
    rows = text.splitlines()
    rules = [n for n, row in enumerate(rows) if TABLE_RULE.fullmatch(row)]
    head = rows[: rules[0] + 1] if rules else []
    runs = fitting_runs(rows[len(head) :], limit, sum(len(h) + 1 for h in head))
    return ["\n".join([*head, *run]) for run in runs] or ["\n".join(head)]


def pieces(found: list[tuple]) -> Iterator[tuple]:
    """Blocks (kind, text, page, path), large ones cut."""
    for kind, text, page, path in found:
        split = split_table if kind == "tabla" else split_paragraph
        for part in [text] if tokens(text) <= TARGET else split(text):
            yield kind, part, page, path


def carried(last: tuple) -> list[tuple]:
    """What a chunk repeats of the last block before it: the block if it is short, else as many of its last sentences
    as are short together; nothing of a table."""
    kind, text, page, path = last
    if kind == "tabla" or tokens(text) <= OVERLAP:
        return [] if kind == "tabla" else [last]
    sentences = SENTENCE_END.split(text)
    from_end = list(accumulate(len(x) + 1 for x in reversed(sentences)))
    kept = bisect_right(from_end, most_chars(OVERLAP) + 1)
    return [("parrafo", " ".join(sentences[-kept:]), page, path)] if kept else []


def sections(found: list[tuple]) -> Iterator[list[tuple]]:
    """Pieces between headings; the first section, before any heading, may be empty."""
    heading = 0

    def number(piece: tuple) -> int:
        nonlocal heading
        heading += piece[0] == "titulo"
        return heading

    for _, group in groupby(pieces(found), number):
        yield [piece for piece in group if piece[0] != "titulo"]


def packed(found: list[tuple]) -> Iterator[list[tuple]]:
    """Groups of about TARGET tokens. A section closes the group before it unless that is short; a full group hands its
    end to the next one of the same section; what was handed on alone makes no group."""
    group: list[tuple] = []
    handed = 0  # blocks at the beginning of the group that were handed on
    for section in sections(found):
        whole = len(group) > handed
        if not whole or sum(tokens(b[1]) for b in group) >= MIN_SECTION:
            if whole:
                yield group
            group, handed = [], 0
        for block in section:
            if len(group) > handed and sum(tokens(b[1]) for b in [*group, block]) > TARGET:
                yield group
                group = carried(group[-1])
                handed = len(group)
            group = [*group, block]
    if len(group) > handed:
        yield group


FOLD = "doc_id long, chunk_no int, text string, path array<string>, first_page int, last_page int"
FOLD_ROWS = 512  # chunks in a batch, besides those of its last document
FOLD_ARROW = pa.schema([("doc_id", pa.int64()), ("chunk_no", pa.int32()), ("text", pa.string()), ("path", pa.list_(pa.string())), ("first_page", pa.int32()), ("last_page", pa.int32())])


def chunk_fold(found: DataFrame, *own: str) -> DataFrame:
    """FOLD's columns from blocks, and the columns ``own``, which all chunks of a document have from its first block. A
    document's blocks become one row; tasks fold one row at a time."""
    block = F.struct("block_no", "kind", "text", "page", "path")
    docs = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"), *(F.first(c, ignorenulls=True).alias(c) for c in own))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*FOLD_ARROW, *(batch.schema.field(c) for c in own)])
            columns, blocks, out = {c: batch.column(c) for c in ("doc_id", *own)}, batch.column("blocks"), []
            for i in range(len(batch)):
                rows = blocks[i].values
                kinds, texts, pages, paths = (rows.field(c) for c in ("kind", "text", "page", "path"))
                shared = {c: column[i].as_py() for c, column in columns.items()}
                numbered = zip(kinds.to_pylist(), texts.to_pylist(), pages.to_pylist(), range(len(rows)))
                for n, group in enumerate(packed(list(numbered))):  # a block's place stands for its path
                    own_pages = [b[2] for b in group if b[2] is not None]
                    out.append({"chunk_no": n, "text": "\n\n".join(b[1] for b in group), "path": paths[group[-1][3]].as_py() or [], "first_page": min(own_pages, default=None), "last_page": max(own_pages, default=None), **shared})
                if len(out) >= FOLD_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = StructType([*StructType.fromDDL(FOLD), *(found.schema[c] for c in own)])
    return docs.mapInArrow(fold, schema)


def folded_documents(docs: DataFrame) -> DataFrame:
    """FOLD's columns of documents (doc_id, markdown), and the map ``fields`` of their front matter."""
    headed = docs.select("doc_id", "markdown", header_fields(C.split_header(F.col("markdown"))[0]).alias("fields"))
    return chunk_fold(blocks(headed, "fields"), "fields")


def field(name: str) -> Column:
    return F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))


def titled(folded: DataFrame) -> DataFrame:
    """Adds what front matter gives a chunk (source, specialty, title), its tokens and the text to embed."""
    stem = F.regexp_replace(F.regexp_extract(field("fuente"), r"([^/]*)\z", 1), r"(?<=.)\.[^.]*\z", "")
    df = folded.withColumns({"source": field("fuente"), "specialty": field("especialidad"), "title": T.readable_title(F.when(field("documento") != "", field("documento")).otherwise(stem))})
    section = F.when(F.size("path") > 0, F.concat(F.lit("\nSección: "), F.array_join("path", " > "))).otherwise("")
    head = F.concat(F.lit("Documento: "), "title", F.lit(" | Especialidad: "), "specialty", section)
    return df.withColumns({"tokens": T.count_tokens(F.col("text")), "embed_text": F.concat(head, F.lit("\n---\n"), "text")})


def chunk_columns(folded: DataFrame) -> DataFrame:
    """All columns of a chunk, from those of ``folded_documents``."""
    df = I.detect_language(titled(folded))
    own = F.when(F.col("language") != "desconocido", F.col("language")).when(field("idioma") != "", field("idioma")).otherwise("desconocido")
    return df.select(
        T.chunk_id(F.col("source"), F.col("chunk_no")).alias("id"), "doc_id", "chunk_no", "title", "source", "specialty", own.alias("language"), "path", "first_page", "last_page",
        "tokens", "text", "embed_text", U.unknown_units(F.col("text")).alias("dubious_units"),
    )


def chunk_documents(docs: DataFrame, least: int = MIN_CHUNK) -> DataFrame:
    """Chunks of documents (doc_id, markdown). Small ones go after numbering, so ids keep their places."""
    return chunk_columns(folded_documents(docs)).filter(F.col("tokens") >= least)


def keep_first(chunks: DataFrame, *order: str, text: str = "text", content: Column | None = None) -> DataFrame:
    """Chunks without those whose content came before in ``order``; ``content`` is the text's fingerprint unless given.

    The first of each content is elected by partial aggregates that carry its row, so no content of very many copies
    meets in a task, and nothing is read twice. Of rows equal in ``order`` too, one stays; rows without content all stay."""
    own = F.coalesce(T.fingerprint(F.col(text)) if content is None else content, F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    rank = F.struct(*order, *([text] if text in chunks.columns else []))
    marked = chunks.select(own.alias("_content"), F.struct("*").alias("_row"), rank.alias("_rank"))
    return marked.groupBy("_content").agg(F.min_by("_row", "_rank").alias("_row")).select("_row.*")


def chunk_summary(docs: DataFrame, least: int = MIN_CHUNK) -> DataFrame:
    """One row about the chunks of documents: documents, documents without chunks, chunks, repeated chunks, tokens, tokens to
    embed, dubious. ``keep_first`` in numbers: chunks are made once, and only what is counted of them is grouped by content."""
    text = F.col("text")
    made = titled(folded_documents(docs)).filter(F.col("tokens") >= least)
    counted = made.select(T.fingerprint(text).alias("content"), F.struct("doc_id", "chunk_no", "tokens", T.count_tokens(F.col("embed_text")).alias("embed_tokens"), U.has_unknown_units(text).alias("dubious")).alias("own"))
    firsts = counted.groupBy("content").agg(F.count(F.lit(1)).alias("times"), F.min("own").alias("own"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    own = firsts.agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("own.doc_id").alias("with_chunks"), total(F.col("times") - 1).alias("repeated"), total("own.tokens").alias("tokens"),
        total("own.embed_tokens").alias("embed_tokens"), F.count_if("own.dubious").alias("dubious"),
    )
    every = docs.agg(F.count(F.lit(1)).alias("documents"))
    return every.crossJoin(own).select("documents", (F.col("documents") - F.col("with_chunks")).alias("without_chunks"), "chunks", "repeated", "tokens", "embed_tokens", "dubious")  # two rows of one
