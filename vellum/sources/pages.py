"""Pages of files as a data source: only the pages that a query asks for are read.

    spark.conf.set(PUSHDOWN, "true")
    register(spark, open_pdf)
    spark.read.format("paged").option("path", folder).option("sample", 12).load()

``opener`` is the port to a document library: it takes a path and gives an object with a length (pages) and, for the number of a
page from 0, its text; if it has ``close()``, that is called. It runs in the tasks. Paths are of a file system that
all machines have mounted.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, bytes long, pages int, page int, text string, error string"
SPLIT_BYTES = 32 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
KINDS = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


def sample_of(total: int, most: int) -> list[int]:
    """At most ``most`` pages spread evenly from the first to the last."""
    if total <= most:
        return list(range(total))
    step = (total - 1) / max(1, most - 1)
    return sorted({round(i * step) for i in range(most)})


@dataclass
class Part(InputPartition):
    """A share of a file's pages, or whole small files."""

    paths: tuple[str, ...]
    share: int = 0
    shares: int = 1

    def of(self, total: int) -> range:
        return range(total * self.share // self.shares, total * (self.share + 1) // self.shares)


def dealt(sizes: list[tuple[str, int]], split: int, whole: bool) -> list[Part]:
    """Files in parts of about ``split`` bytes. A larger file becomes several parts, unless it is read ``whole``: few pages of it are
    wanted, so one task takes them. No file is opened for this."""
    out, held, size = [], [], 0
    for path, n in sizes:
        if n > split and not whole:
            shares = -(-n // split)
            out += [Part((path,), i, shares) for i in range(shares)]
            continue
        if held and size + n > split:
            out.append(Part(tuple(held)))
            held, size = [], 0
        held.append(path)
        size += n
    return out + ([Part(tuple(held))] if held else [])


def within(page: int, f: Filter) -> bool:
    if isinstance(f, In):
        return page in f.value
    return {EqualTo: page == f.value, GreaterThan: page > f.value, GreaterThanOrEqual: page >= f.value, LessThan: page < f.value, LessThanOrEqual: page <= f.value}[type(f)]


def files_below(path: str, suffix: str) -> list[tuple[str, int]]:
    if os.path.isfile(path):
        return [(path, os.path.getsize(path))]
    found = (os.path.join(folder, name) for folder, _, names in os.walk(path) for name in names if name.lower().endswith(suffix.lower()))
    return sorted((p, os.path.getsize(p)) for p in found)


def register(spark: SparkSession, opener: Callable[[str], Sequence[str]], name: str = "paged") -> None:
    """Register ``page_source`` in a session, with conditions pushed down if the session has ``PUSHDOWN`` set now; that
    setting must not be taken back while the source is used, as Spark refuses a reader that takes conditions without it."""
    spark.dataSource.register(page_source(opener, name, spark.conf.get(PUSHDOWN) == "true"))


def page_source(opener: Callable[[str], Sequence[str]], name: str = "paged", pushdown: bool = False) -> type[DataSource]:
    """A data source to register. Options: ``path`` (a folder, taken with all below it, or a file), ``suffix`` (of files), ``sample``
    (at most so many pages of each file, evenly spread; all if not given), ``split_bytes``.

    A row for each page, in the file's order of numbers from 0. A file that can't be opened, and one without pages, gives one row
    without a page, the former with the error; a page that can't be read gives its row with the error. With ``pushdown``
    conditions on ``page`` reach the reader; Spark applies them again, so results are the same without.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.root, self.suffix = options["path"], options.get("suffix", "")
            self.sample = int(options["sample"]) if "sample" in options else None
            self.split = int(options.get("split_bytes", SPLIT_BYTES))
            self.filters: list[Filter] = []

        def partitions(self) -> list[Part]:
            picked = self.sample is not None or any(isinstance(f, (EqualTo, In)) for f in self.filters)
            return dealt(files_below(self.root, self.suffix), self.split, picked) or [Part(())]

        def read(self, part: Part) -> Iterator[tuple]:
            for path in part.paths:
                size = os.path.getsize(path)
                try:
                    document = opener(path)
                    total = len(document)
                except Exception as e:  # noqa: BLE001 - whatever the library raises becomes the file's row
                    if part.share == 0:
                        yield path, size, None, None, None, f"{type(e).__name__}: {e}"
                    continue
                try:
                    if not total and part.share == 0:
                        yield path, size, 0, None, None, None
                    own = part.of(total)
                    for page in own if self.sample is None else sample_of(total, self.sample):
                        if page in own and all(within(page, f) for f in self.filters):
                            yield (path, size, total, page, *text_of(document, page))
                finally:
                    if hasattr(document, "close"):
                        document.close()

    class Selective(Reader):
        def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
            self.filters = [f for f in filters if isinstance(f, KINDS) and f.attribute == ("page",) and f.value is not None]
            return iter(filters)

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            if not self.options.get("path"):
                raise ValueError("a source of pages needs a path")
            return (Selective if pushdown else Reader)(dict(self.options))

    return Pages


def text_of(document: Sequence[str], page: int) -> tuple[str | None, str | None]:
    try:
        return document[page], None
    except Exception as e:  # noqa: BLE001 - as above, for one page
        return None, f"{type(e).__name__}: {e}"
