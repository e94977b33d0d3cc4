"""Encodings of distinct pieces of text, remembered in a worker as hash arrays.

A piece is known by two independent 64-bit hashes; the table is emptied when it outgrows its bound, which changes
speed alone. Only pieces that are not in it reach the tokenizer library, in batches balanced by bytes.
"""

from __future__ import annotations

import os

import numpy as np

from .text import distinct, hash_pieces

_TABLES: dict = {}


def table(name: str, make) -> "Memo":
    """One table a name in each Python worker."""
    if name not in _TABLES:
        _TABLES[name] = make()
    return _TABLES[name]


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the other cores run other tasks
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def balanced(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of consecutive items with about ``limit`` in all."""
    ends, at, out = np.cumsum(sizes), 0, []
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        out.append((at, to))
        at = to
    return out


def places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes of the runs begin:begin + size, one after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[begin:begin + size], one after another."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    at = np.cumsum(size) - size
    return flat[np.repeat(begin - at, size) + np.arange(total)]


class Memo:
    """encode: list of str -> list of int lists. With ``lengths_only`` no ids are kept."""

    def __init__(self, encode, lengths_only: bool = False, bound: int = 64_000_000, batch_bytes: int = 200_000):
        self.encode, self.lengths_only, self.bound, self.batch_bytes = encode, lengths_only, bound, batch_bytes
        self._clear()

    def _clear(self) -> None:
        self.h1, self.h2 = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.size, self.begin, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _new(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes, flat = [], []
        for a, b in balanced(lens + 16, self.batch_bytes):
            texts = [data[s : s + n].tobytes().decode("utf-8", "replace") for s, n in zip(starts[a:b], lens[a:b])]
            for ids in self.encode(texts):
                sizes.append(len(ids))
                if not self.lengths_only:
                    flat.append(np.asarray(ids, np.uint32))
        return np.array(sizes, np.int64), np.concatenate(flat) if flat else np.zeros(0, np.uint32)

    def look_up(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, size, ids): piece i has the tokens ids[begin[i]:begin[i] + size[i]]."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), self.ids
        h1 = hash_pieces(data, starts, lens)
        order = np.argsort(h1)
        heads = distinct(h1[order])
        inverse = np.empty(len(h1), np.int64)
        inverse[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(h1))))
        one = order[heads]
        u1, u2 = h1[one], hash_pieces(data, starts[one], lens[one], 1)
        at = np.minimum(np.searchsorted(self.h1, u1), max(0, len(self.h1) - 1))
        known = (self.h1[at] == u1) & (self.h2[at] == u2) if len(self.h1) else np.zeros(len(u1), bool)
        missing = np.flatnonzero(~known)
        if len(missing):
            size, ids = self._new(data, starts[one[missing]], lens[one[missing]])
            if len(self.h1) * 32 + self.ids.nbytes > self.bound:
                # what this batch needs stays
                keep = at[known]
                ids_kept = gather(self.ids, self.begin[keep], self.size[keep])
                self.h1, self.h2, self.size = self.h1[keep], self.h2[keep], self.size[keep]
                self.begin, self.ids = np.cumsum(self.size) - self.size, ids_kept
            begin = len(self.ids) + (np.cumsum(size) - size if not self.lengths_only else np.zeros(len(size), np.int64))
            all1 = np.concatenate([self.h1, u1[missing]])
            by = np.argsort(all1, kind="stable")
            self.h1 = all1[by]
            self.h2 = np.concatenate([self.h2, u2[missing]])[by]
            self.size = np.concatenate([self.size, size])[by]
            self.begin = np.concatenate([self.begin, begin])[by]
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.h1, u1)
            while (wrong := self.h2[at] != u2).any():  # two pieces with one h1 lie side by side
                at[wrong] += 1
        return self.begin[at][inverse], self.size[at][inverse], self.ids
