"""Arrow columns of texts in parts bounded by bytes: a batch is bounded by rows alone, and rows may be long."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts together, and the offsets of each (one more than there are texts); null as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``limit`` bytes in all; a row beyond that stands by itself."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, to
        at = to


def runs(column: pa.ChunkedArray) -> np.ndarray:
    """For each row the number of its run of equal values, from 0."""
    c = column.combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    if not len(c):
        return np.zeros(0, np.int64)
    other = pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
    return np.cumsum(np.concatenate(([0], other.astype(np.int64))))


def whole_runs(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows or more that end where a run of equal values ends; a longer run stays whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        t = pa.Table.from_batches(held)
        r = runs(t.column(column))
        cut = int(np.searchsorted(r, r[-1]))
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).to_batches()
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield t
