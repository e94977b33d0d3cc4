"""One-to-one matching of expected and predicted boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import parts


def best_assignment(value: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a matching that first has the most positive entries and then the largest sum, by shortest augmenting paths."""
    n, m = value.shape
    if not n or not m:
        return []
    if n > m:
        return sorted((i, j) for j, i in best_assignment(value.T))
    cost = np.where(value > 0, 1 - value, 1e6)
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while match[at]:
            used[at] = True
            row = match[at]
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[row - 1, free - 1] - u[row] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], at
            to = free[int(np.argmin(least[free]))]
            delta = least[to]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            at = to
        while at:
            before = way[at]
            match[at] = match[before]
            at = before
    return sorted((match[j] - 1, j - 1) for j in range(1, m + 1) if match[j] and value[match[j] - 1, j - 1] > 0)


def _components(e: np.ndarray, p: np.ndarray) -> dict[int, list[int]]:
    """Pairs by what they hang together with, through shared e or p."""
    up: dict[tuple[int, int], tuple[int, int]] = {}

    def top(x: tuple[int, int]) -> tuple[int, int]:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    ends = list(zip(e.tolist(), p.tolist()))
    for i, j in ends:
        up[top((0, i))] = top((1, j))
    out: dict = {}
    for k, (i, _) in enumerate(ends):
        out.setdefault(top((0, i)), []).append(k)
    return out


def matched(e: np.ndarray, p: np.ndarray, iou: np.ndarray) -> np.ndarray:
    """Places of the pairs of the best matching. Values of ``e`` and ``p`` tell boxes apart over all pages.

    Where each of a box's partners has no other one, it takes the best, of equals the first. What is left falls into parts that share
    no box, and each is matched by itself: the most pairs and the largest sum of all are those of the parts together.
    """
    _, e, n_e = np.unique(e, return_inverse=True, return_counts=True)
    _, p, n_p = np.unique(p, return_inverse=True, return_counts=True)
    lone_e, lone_p = n_e[e] == 1, n_p[p] == 1
    star_p = np.bincount(p, ~lone_e, len(n_p))[p] == 0
    star_e = np.bincount(e, ~lone_p, len(n_e))[e] == 0
    found = []
    for inside, hub, leaf in ((star_p, p, e), (star_e & ~star_p, e, p)):
        at = np.flatnonzero(inside)
        at = at[np.lexsort((leaf[at], -iou[at], hub[at]))]
        found.append(at[np.flatnonzero(np.diff(hub[at], prepend=-1))])
    rest = np.flatnonzero(~star_p & ~star_e)
    for part in _components(e[rest], p[rest]).values():
        at = rest[part]
        (es, i), (ps, j) = np.unique(e[at], return_inverse=True), np.unique(p[at], return_inverse=True)
        value, place = np.zeros((len(es), len(ps))), np.zeros((len(es), len(ps)), np.int64)
        value[i, j], place[i, j] = iou[at], at
        found.append(np.array([place[a, b] for a, b in best_assignment(value)], np.int64))
    return np.sort(np.concatenate(found))


def _matchings(pages: pa.Array) -> pa.Array:
    """For each page's list of pairs (e, p, iou) those of its best matching."""
    pages = pages.combine_chunks() if isinstance(pages, pa.ChunkedArray) else pages
    pairs, lengths = pages.flatten(), pc.fill_null(pc.list_value_length(pages), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(pages)), lengths)
    codes = [np.unique(pairs.field(k).to_numpy(zero_copy_only=False), return_inverse=True) for k in (0, 1)]
    at = matched(*(row * len(values) + code for values, code in codes), pairs.field(2).to_numpy(zero_copy_only=False)) if len(row) else np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(np.bincount(row[at], minlength=len(pages)))))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs.take(pa.array(at)))


def assign(pairs: DataFrame, threshold: float, page: str = "page_id") -> DataFrame:
    """(page, e, p, iou) of the best one-to-one matching of each page among pairs whose iou reaches ``threshold``.

    Pairs are gathered by page and matched in Arrow batches, many pages at once; only boxes that contend for each other cost a search.
    """
    near = pairs.where(F.col("iou") >= threshold).groupBy(page).agg(F.collect_list(F.struct("e", "p", "iou")).alias("_pairs"))
    best = F.arrow_udf(_matchings, near.schema["_pairs"].dataType)("_pairs")
    return near.select(page, F.inline(best))


def token_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths: 1 for equal tokens; columns of the table are bits of one number."""
    if a == b:
        return 1.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return 2 * (len(a) - row.bit_count()) / max(1, len(a) + len(b))


def soft_matches(df: DataFrame, key: str, expected: str, predicted: str, least: float = 0.85) -> DataFrame:
    """(key, precision, recall, f1): expected tokens in order each take the unused predicted token that is most alike, the first of
    equals, if their ratio is ``least`` or more; the ratios are added up and set against each side's number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], float] = {}
        for batch in batches:
            tokens = sum(pc.fill_null(pc.list_value_length(batch.column(k)), 0).to_numpy(zero_copy_only=False) for k in (1, 2))
            for a, b in parts(tokens, 100_000):  # lists of Python strings take many times the room of the batch
                yield solve(batch.slice(a, b - a), known)

    def solve(batch: pa.RecordBatch, known: dict[tuple[str, str], float]) -> pa.RecordBatch:
        out = []
        for e, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            e, p = e or [], p or []
            places: dict[str, list[int]] = {}
            for i in range(len(p) - 1, -1, -1):
                places.setdefault(p[i], []).append(i)
            total = 0.0
            for t in e:
                if t in places:
                    best, token = 1.0, t
                else:
                    best, token, first = 0.0, None, 0
                    for x, free in places.items():
                        if 2 * min(len(t), len(x)) < least * (len(t) + len(x)):
                            continue
                        if (t, x) not in known:
                            if len(known) >= 100_000:
                                known.clear()
                            known[t, x] = token_ratio(t, x)
                        r = known[t, x]
                        if r > best or r == best and free[-1] < first:
                            best, token, first = r, x, free[-1]
                if token is not None and best >= least:
                    total += best
                    places[token].pop()
                    if not places[token]:
                        del places[token]
            recall, precision = total / len(e) if len(e) else 0.0, total / len(p) if len(p) else 0.0
            out.append((precision, recall, 2 * precision * recall / (precision + recall) if total else 0.0))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], pa.float64()) for k in range(3))], [key, "precision", "recall", "f1"])

    return df.select(key, expected, predicted).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, precision double, recall double, f1 double")
