"""Pages to Markdown by the batch: Python's own memory doesn't grow with the batch."""

import tracemalloc

import pyarrow as pa

from vellum.operators import html as H


def peak(pages: int) -> int:
    batch = pa.array(["<p>" + "\u4e00 word " * 2000 + f"{n}</p>" for n in range(pages)])
    tracemalloc.start()
    try:
        H.convert(batch)
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_batch():
    assert peak(8 * H.PIECE) < 1.5 * peak(2 * H.PIECE)


def test_pieces():
    pages = [None if n % 7 == 0 else f"<title>t{n}</title><h1>a</h1><p>b{n}" for n in range(2 * H.PIECE + 3)]
    out = H.convert(pa.array(pages, pa.string())).to_pylist()
    assert len(out) == len(pages) and all((x is None) == (p is None) for x, p in zip(out, pages))
    assert out[1] == {"title": "t1", "markdown": "# a\n\nb1", "headings": 1, "links": 0, "tables": 0}
    assert H.convert(pa.array([], pa.string())).to_pylist() == []
