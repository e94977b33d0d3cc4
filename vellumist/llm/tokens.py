"""5. Token counts, 7. exact encoding of unsplit text by tree concatenation, 9. cost-balanced packing."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .memo import Memo, gather, table, tokenizer
from .text import Words, buffers, slices

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ------------------------------------------------------------------------------------------- 5. token counts

_PRINTS = np.zeros(256, bool)
_PRINTS[0x21:0x7F] = True
_LEADS = np.zeros(256, bool)
_LEADS[0xC3:0xD5] = True  # U+00C0 to U+053F: no white space among them


def safe_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lens, first): each text cut before every single space between two visible characters.

    There the byte-level pattern always begins a new pre-token, so counts of the pieces add up to the text's. A text
    without such a place is one piece.
    """
    n = len(data)
    padded = np.concatenate([np.zeros(2, np.uint8), data, np.zeros(2, np.uint8)])
    before = _PRINTS[padded[1:-3]] | (_LEADS[padded[:-4]] & (padded[1:-3] >> 6 == 2))
    after = _PRINTS[padded[3:-1]] | _LEADS[padded[3:-1]]
    cut = (data == 32) & before & after
    begins = offsets[:-1][np.diff(offsets) > 0]
    cut[begins] = True
    starts = np.flatnonzero(cut)
    lens = np.diff(np.append(starts, n))
    return starts, lens, np.searchsorted(starts, offsets)


def count_tokens(df: DataFrame, path: str, column: str = "text", key: str = "doc_id", limit: int = 1024) -> DataFrame:
    """Tokens of each whole text; a null text is empty and has none. Rows with the same key stay separate rows.

    Texts travel in Arrow batches cut by bytes; each is split at safe boundaries, distinct pieces that the worker has
    not met are encoded in batches balanced by bytes, and only lengths return. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> Memo:
            t = tokenizer(path)
            return Memo(lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)], lengths_only=True)

        memo = table("count:" + path, make)
        for batch in batches:
            for part in slices(batch, column):
                data, offsets = buffers(part.column(column))
                starts, lens, first = safe_pieces(data, offsets)
                _, size, _ = memo.look_up(np.concatenate([data, np.zeros(16, np.uint8)]), starts, lens)
                total = np.concatenate(([0], np.cumsum(size)))
                n = total[first[1:]] - total[first[:-1]]
                yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    return df.select(key, column).mapInArrow(run, f"{key} long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(BYTE_VOCABULARY))


# ------------------------------------------------------------------------------- 7. encoding and decoding exactly


def same(a: np.ndarray, b: np.ndarray) -> bool:
    return len(a) == len(b) and bool((a == b).all())


class TreeEncoder:
    """Encodes as the tokenizers library does, whole texts by halves.

    A text of more than ``leaf`` characters is cut in halves, wherever that falls, down to leaves; the leaves of all texts are encoded as
    one batch. Then halves are joined, level by level: a window round each join, from some words before it to some words behind, is
    encoded again, all windows of a level as one batch, and grows until its first token is one that the left half has there and its last
    token one of the right half; as it begins and ends at white space, which no token reaches across, the joined ids are those of the
    whole. A stretch of half a leaf or more without a space or line break has no such places: it is normalised and cut into pre-tokens
    first, and a pre-token's halves are joined symbol by symbol. Merges being ordered, a sequence whose neighbours all agree is the
    encoding of the whole there too. Batches run on as many threads as TOKENIZERS_PARALLELISM allows; in Spark tasks that is one.
    """

    def __init__(self, path: str, leaf: int = 1024):
        import json

        self.t, self.leaf, self.path = tokenizer(path), leaf, path
        spec = json.load(open(path))
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.bare = None
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.plain = all(not (a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"]) for a in spec["added_tokens"])
        self.unsplit = re.compile("[^ \n]{%d,}" % max(1, leaf // 2))
        self.suffix = suffix
        self.names = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.joins = 0  # of halves of texts
        self.memo = Memo(self.words)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        """ids of leaves and windows, all as one batch: distinct words that the worker has not met go to the library together."""
        if not texts:
            return []
        ids, ends = word_ids(self.memo, pa.array(texts, pa.large_string()))
        return [ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def words(self, texts: list[str]) -> list[list[int]]:
        """ids of words without white space."""
        short = [i for i, x in enumerate(texts) if len(x) <= self.leaf]
        out: list = [None] * len(texts)
        for i, e in zip(short, self.t.encode_batch_fast([texts[i] for i in short], add_special_tokens=False)):
            out[i] = e.ids
        return [self.long(x) if ids is None else ids for x, ids in zip(texts, out)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.plain:  # added tokens that take white space along
            return [np.array(e.ids, np.int64) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]
        pieces, owner, long = [], [], []  # stretches of text between unsplit ones, in order
        for i, x in enumerate(texts):
            at = 0
            for m in self.unsplit.finditer(x) if len(x) > self.leaf else ():
                pieces += [x[at : m.start()], m[0]]
                owner += [i, i]
                long += [False, True]
                at = m.end()
            pieces.append(x[at:])
            owner.append(i)
            long.append(False)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        split = iter(self.halved([p for p, skip in zip(pieces, long) if not skip]))
        for p, i, skip in zip(pieces, owner, long):
            out[i].append(np.array(self.long(p), np.int64) if skip else next(split))
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def halved(self, texts: list[str]) -> list[np.ndarray]:
        """ids of texts that have white space in every half leaf."""
        cuts, leaves, first = [], [], []
        for x in texts:
            n = 1 << max(0, (len(x) - 1) // self.leaf).bit_length()
            cuts.append([len(x) * k // n for k in range(n + 1)])
            first.append(len(leaves))
            leaves += [x[a:b] for a, b in zip(cuts[-1], cuts[-1][1:])]
        ids = self._encoded(leaves)
        nodes = [ids[a : a + len(c) - 1] for a, c in zip(first, cuts)]
        while any(len(x) > 1 for x in nodes):
            self._join_level(texts, cuts, nodes)
        return [x[0] for x in nodes]

    def _join_level(self, texts: list[str], cuts: list[list[int]], nodes: list[list[np.ndarray]]) -> None:
        """Joins each text's nodes two by two; cuts[i] are the bounds of nodes[i]."""
        todo = [(i, k, 2) for i, x in enumerate(nodes) for k in range(0, len(x) - 1, 2)]
        done: dict[tuple[int, int], np.ndarray] = {}
        while todo:
            asked, edges = [], []
            for i, k, words in todo:
                low, cut, high = cuts[i][k : k + 3]
                a, b = self._before(texts[i], low, cut, words), self._behind(texts[i], cut, high, words)
                edges.append((a == low, b == high))
                asked += [texts[i][a:b], texts[i][a:cut], texts[i][cut:b]]
            got = self._encoded(asked)
            again = []
            for (i, k, words), (at_low, at_high), window, before, behind in zip(todo, edges, got[::3], got[1::3], got[2::3]):
                left, right = nodes[i][k], nodes[i][k + 1]
                a, b = len(left) - len(before), len(behind)
                ok_left = at_low or (same(window[:1], before[:1]) and same(left[a:], before))
                ok_right = at_high or (same(window[-1:], behind[-1:]) and same(right[:b], behind))
                if ok_left and ok_right:
                    done[i, k] = np.concatenate([left[:a], window, right[b:]])
                    self.joins += 1
                else:
                    again.append((i, k, 2 * words))
            todo = again
        for i, x in enumerate(nodes):
            if len(x) > 1:
                nodes[i] = [done[i, k] if k + 1 < len(x) else x[k] for k in range(0, len(x), 2)]
                cuts[i] = cuts[i][::2] if len(x) % 2 == 0 else [*cuts[i][::2], cuts[i][-1]]

    @staticmethod
    def _before(text: str, low: int, at: int, words: int) -> int:
        for _ in range(words):
            at = max(text.rfind(" ", low, at), text.rfind("\n", low, at))
            if at < 0:
                return low
        return at

    @staticmethod
    def _behind(text: str, at: int, high: int, words: int) -> int:
        for _ in range(words):
            space = text.find(" ", at, high)
            line = text.find("\n", at, high if space < 0 else space)
            at = (line if line >= 0 else space) + 1
            if not at:
                return high
        return at

    def long(self, text: str) -> list[int]:
        """ids of a stretch without white space."""
        ids: list[int] = []
        for part in self.at_special.split(text) if self.special else [text]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            part = self.t.normalizer.normalize_str(part) if self.t.normalizer else part
            for token, _ in self.t.pre_tokenizer.pre_tokenize_str(part):
                ids += self.word(token)
        return ids

    def _tokens(self, symbols: list[str], ends: bool) -> list[list[int]]:
        if self.bare is None:  # only texts with long unsplit stretches need them
            import json

            from tokenizers import Tokenizer, models

            model = json.load(open(self.path))["model"]
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            end = {"end_of_word_suffix": self.suffix} if self.suffix else {}
            self.bare = [Tokenizer(models.BPE(model["vocab"], merges, **kind)) for kind in ({}, end)]
        return [e.ids for e in self.bare[ends].encode_batch_fast(symbols, add_special_tokens=False)]

    def word(self, symbols: str) -> list[int]:
        """ids of one pre-token; its leaves are one batch."""
        parts = [symbols[a : a + self.leaf] for a in range(0, len(symbols), self.leaf)]
        level = self._tokens(parts[:-1], False) + self._tokens(parts[-1:], True)
        while len(level) > 1:
            level = [self.join(level[k], level[k + 1], k + 2 == len(level)) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0] if level else []

    def _symbols(self, ids: list[int], ends: bool) -> str:
        s = "".join(self.names[i] for i in ids)
        return s[: len(s) - len(self.suffix)] if ends and self.suffix else s

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        width = 2
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            whole = ends and b == len(right)
            got = self._tokens([self._symbols(left[a:], False) + self._symbols(right[:b], whole)], whole)[0]
            if (a == 0 or got[0] == left[a]) and (b == len(right) or got[-1] == right[b - 1]) or (a == 0 and b == len(right)):
                return left[:a] + got + right[b:]
            width *= 2


def encoder(path: str) -> tuple[TreeEncoder, list[bytes]]:
    """A worker's encoder, and the tokens' names by id."""

    def make():
        e = TreeEncoder(path)
        return e, [e.names.get(i, "").encode() for i in range(max(e.names) + 1)]

    return table("tree:" + path, make)


def word_ids(memo: Memo, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): ids of all texts one after another, and where each text's end (one more than texts, from 0).

    Texts are cut at white space, where this vocabulary's pre-tokens always end and normalisation never reaches across.
    """
    data, offsets = buffers(column)
    w = Words(data, offsets)
    begin, size, flat = memo.look_up(w.data, w.starts, w.lens)
    total = np.concatenate(([0], np.cumsum(size)))
    return gather(flat, begin, size), total[w.first]


def encode_decode(df: DataFrame, path: str, column: str = "text", key: str = "doc_id", digests: bool = False) -> DataFrame:
    """ids and the text decoded from them for each whole text, as the library gives both; null is empty.

    Texts are encoded whole by :class:`TreeEncoder`, those of a part of a batch together, whatever their length. With ``digests`` their SHA-256 instead. Without a decoder in the vocabulary's file, decoding joins the tokens' names
    with spaces. No shuffle; repeated rows stay and are encoded each; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, names = encoder(path)
        size = np.array([len(x) + 1 for x in names], np.int64)
        begin = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(x + b" " for x in names), np.uint8)
        for batch in batches:
            for part in slices(batch, column, 2_000_000):
                lists = encode([x or "" for x in part.column(column).to_pylist()])
                ids, ends = np.concatenate(lists).astype(np.int64), np.cumsum([0, *map(len, lists)])
                text = gather(flat, begin[ids], size[ids]).tobytes()
                at = np.concatenate(([0], np.cumsum(size[ids])))[ends]
                raw = ids.astype("<u4").tobytes()
                each = [(raw[4 * a : 4 * b], text[c : max(c, d - 1)]) for a, b, c, d in zip(ends, ends[1:], at, at[1:])]
                head = [part.column(key).cast(pa.int64()), pa.array(np.diff(ends))]
                if digests:
                    yield pa.RecordBatch.from_arrays([*head, *(pa.array([hashlib.sha256(e[k]).hexdigest() for e in each], pa.string()) for k in (0, 1))], [key, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*head, lists, pa.array([e[1].decode() for e in each], pa.string())], [key, "n_tokens", "ids", "decoded"])

    kind = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return df.select(key, column).mapInArrow(run, f"{key} long, n_tokens long, {kind}")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(WORD_VOCABULARY), digests=True)


# ------------------------------------------------------------------------------------------------ 9. packing

CAPACITY = 4096
END = 2


def pack(sizes: np.ndarray, capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces that fill sequences of ``capacity`` tokens.

    A document's full stretches of ``capacity`` are sequences of their own. What is left is taken in descending size (ties: in order)
    and goes to the sequence of lowest estimated cost, ``linear * n + quadratic * n * n`` over its pieces, among those with room for
    it whole. Where none has room it is cut: the emptiest sequence takes what it can, and the rest goes on. As many sequences are
    open as the tokens need, so only the last places stay empty.
    """
    out: list[tuple[int, int, int, int, int]] = []
    sequence, rest = 0, []
    for i, n in enumerate(sizes.tolist()):
        full = n // capacity
        for k in range(full):
            out.append((i, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, i, full * capacity))
    total = sum(r[0] for r in rest)
    n_open = -(-total // capacity)
    room, cost = np.full(n_open, capacity), np.zeros(n_open)
    for n, i, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while n:
            fits = np.where(room >= n, cost, np.inf)
            at = int(np.argmin(fits))
            take = n
            if fits[at] == np.inf:
                at = int(np.argmax(room))
                take = min(n, int(room[at]))
            out.append((i, start, take, sequence + at, capacity - int(room[at])))
            room[at] -= take
            cost[at] += linear * take + quadratic * take * take
            start, n = start + take, n - take
    return out


def pack_documents(df: DataFrame, path: str, column: str = "text", key: str = "doc_id", capacity: int = CAPACITY, group_bytes: int = 16_000_000) -> DataFrame:
    """One row for each piece of a document: where it lies in which sequence. A null or empty text is its end id alone.

    Groups of about ``group_bytes`` of text are packed by themselves where they are read; only a group's last sequence stays
    partly empty, below one sequence in about a thousand. Sequence numbers are unique over all groups. Repeated rows are packed
    as often as they occur. No shuffle.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(path)[0].memo
        base, group = TaskContext.get().partitionId() << 36, 0
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal base
            names = pa.concat_arrays(keys)
            flat, n = np.concatenate(ids), np.concatenate(sizes)
            raw, at = memoryview(flat.astype("<u4").tobytes()), np.cumsum(n) - n
            pieces = pack(n, capacity)
            p = np.array(pieces, np.int64).reshape(-1, 5)
            first = 4 * (at[p[:, 0]] + p[:, 1])
            crc = [zlib.crc32(raw[a : a + 4 * b]) for a, b in zip(first.tolist(), p[:, 2].tolist())]
            columns = [names.take(pa.array(p[:, 0])), p[:, 1], p[:, 2], np.array(crc, np.int64), n[p[:, 0]], base + p[:, 3], p[:, 4]]
            base += int(p[:, 3].max()) + 1
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for part in slices(batch, column, 2_000_000):
                got, ends = word_ids(memo, part.column(column))
                keys.append(part.column(key).cast(pa.int64()))
                ids.append(np.insert(got, ends[1:], END).astype(np.uint32))
                sizes.append(np.diff(ends) + 1)
                size += len(got)
                if 4 * size >= group_bytes:
                    yield flush()
                    keys, ids, sizes, size = [], [], [], 0
        if keys:
            yield flush()

    return df.select(key, column).mapInArrow(run, f"{key} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(WORD_VOCABULARY))
