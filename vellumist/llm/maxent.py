"""10. LM scoring: a hashed maximum-entropy model over words.

Its softmax is factored by classes: a class is drawn by a bias and hashed features of the history, the word before, the two words before
(n-grams), and the second and third word before by themselves (skips); the most frequent words are classes of their own, and the others
fall into classes by their endings, within which the feature is the word itself by its count, add-one for words not met. On this
distribution m lie exact features of words: every pair (v, w) and triple (u, v, w) of the corpus by a 56-bit key. Their log weights are
set by counts, log(1 + c(v, w) / (PAIR * m(w))), since the normaliser is then known without a sum over words, 1 + c(v) / PAIR; the
triple's weight is formed in the same way on what the pair gives. What the model gathers of words, pairs and triples grows with the
input; it lies in the shared folder and is asked for block by block (see ``counts``).

The hashed table is trained by gradient steps, each task over its own documents. PARTS of the documents, each document in one, follow
one another: after each the tasks' tables are averaged, row by row, weighted by use, and the next part's tasks go on from there. The
table has a row for each ROW_BYTES of input, between LEAST_ROWS and MOST_ROWS; the latter is a memory limit: a worker holds 50 MB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .counts import Answers, ranked_hashes
from .memo import places
from .shared import blocks, fresh, input_bytes, scan
from .text import Words, buffers, distinct, mix

OWN, ENDINGS = 32, 16  # classes: frequent words, and endings of all others
CLASSES = OWN + ENDINGS
LEAST_ROWS, MOST_ROWS, ROW_BYTES = 1 << 15, 1 << 18, 1 << 14
SLICE, MERGED = 512, 64  # rows of the table that are averaged at a time; tasks' tables that one step of averaging adds up
SENT = 64  # slices that a task sends at a time
FEATURES = 4
STEP, RATE = 1024, 0.35
_PLACE_BITS = (FEATURES * STEP - 1).bit_length()
_PLACE = (1 << _PLACE_BITS) - 1
_ROW = np.dtype((np.void, CLASSES * 4))
SCORED = 4096
PARTS = (0, 1, 5, 16)  # bounds of the parts in sixteenths: the first are small, for a table to go on from
PAIR, TRIPLE = 200.0, 2.0  # so many tokens of a context weigh as much as what is known without it
_CONTEXT = 255  # the group of pairs' and triples' keys; words have their ending
BLOCK_BYTES = 4_000_000  # text in a block whose words and contexts are asked for together
_END = np.uint64(0x0123456789ABCDEF)  # the end token's hash and the key that no word has but by chance
_START = np.uint64(0xFEDCBA9876543210)
_TYPE = np.array([0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1) for k in range(FEATURES)], np.uint64)


class Tokens:
    """Token hashes of a block's documents, an end behind each; ``first`` has each document's begin, ``ending`` each token's class."""

    def __init__(self, column):
        data, offsets = buffers(column)
        w = Words(data, offsets, lower=True)
        n = np.diff(w.first)
        self.first = w.first + np.arange(len(w.first))
        self.h = np.empty(len(w) + len(n), np.uint64)
        is_end = np.zeros(len(self.h), bool)
        is_end[self.first[1:] - 1] = True
        self.h[is_end], self.h[~is_end] = _END, w.hashes()
        last = w.starts + w.lens - 1
        tail = w.data[last].astype(np.uint64) | (np.where(w.lens > 1, w.data[np.maximum(last - 1, 0)], 0).astype(np.uint64) << np.uint64(8))
        self.ending = np.zeros(len(self.h), np.uint8)
        self.ending[~is_end] = mix(tail + np.uint64(99)) % np.uint64(ENDINGS)

    def back(self, k: int) -> np.ndarray:
        """The token k before each; nothing is seen across a document's begin."""
        h = self.h
        b = np.concatenate([np.full(min(k, len(h)), _START), h[:-k] if k < len(h) else h[:0]])
        for d in range(k):
            at = self.first[:-1] + d
            b[at[at < self.first[1:]]] = _START
        return b

    def features(self, rows: int) -> np.ndarray:
        """(FEATURES, tokens) places in a table of so many rows, a power of two."""
        one, two, three = (self.back(k) for k in (1, 2, 3))
        x = [one, mix(two) + one, two, three]
        return np.stack([(mix(v ^ t) & np.uint64(rows - 1)).astype(np.int32) for v, t in zip(x, _TYPE)])

    def contexts(self) -> np.ndarray:
        """Keys of each token's pair and triple, in two rows."""
        one, two = self.back(1), self.back(2)
        keys = np.stack([mix(mix(one + _TYPE[0]) + self.h), mix(mix(mix(two + _TYPE[1]) + one) + self.h)])
        return keys & ~np.uint64(255)  # a byte less to send for each

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys of words, pairs and triples, rising; the places of each token's word, pair and triple among them)."""
        return ranked_hashes(np.concatenate([self.h, self.contexts().ravel()]))

    def classes(self, own: np.ndarray) -> np.ndarray:
        """Classes of the tokens; ``own`` are the sorted hashes of the words that are classes themselves."""
        at = np.minimum(np.searchsorted(own, self.h), max(0, len(own) - 1))
        mine = own[at] == self.h if len(own) else np.zeros(len(self.h), bool)
        return np.where(mine, at, OWN + self.ending.astype(np.int64))


def _logits(table: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    s = np.take(table, rows[0], 0)
    for r in rows[1:]:
        s += np.take(table, r, 0)
    s += bias
    return np.minimum(s, 80, s)  # its exponential stays finite


def log_softmax(table: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    s = _logits(table, bias, rows)
    s -= np.log(np.exp(s) @ np.ones(CLASSES, np.float32))[:, None]
    return s


def by_row(rows: np.ndarray) -> np.ndarray:
    """The rows of a step in rising order, each above the _PLACE_BITS bits of its place in ``rows.ravel()``: sorting these values needs no
    index beside them, and equal rows stay in the order of their places."""
    kind = np.uint32 if MOST_ROWS << _PLACE_BITS <= 1 << 32 else np.int64
    return np.sort((rows.ravel().astype(kind) << _PLACE_BITS) | np.arange(rows.size, dtype=kind))


class Learner:
    """Stochastic gradient steps of one task, each row of the table with a rate that falls with its own gradients (Adagrad).

    A step takes STEP tokens and adds up the gradients of all that share a row, of whatever feature, so each row moves once a step.
    """

    def __init__(self, bias: np.ndarray, table: np.ndarray, power: np.ndarray):
        self.bias, self.table, self.power = bias.astype(np.float32), table.copy(), power.copy()
        self.used = np.zeros(len(table), np.float32)

    def learn(self, rows: np.ndarray, target: np.ndarray) -> None:
        ones = np.ones(CLASSES, np.float32)
        for a in range(0, len(target), STEP):
            r, t = rows[:, a : a + STEP], target[a : a + STEP]
            g = _logits(self.table, self.bias, r)
            np.exp(g, g)
            g /= (g @ ones)[:, None]
            g[np.arange(len(t)), t] -= 1
            every = by_row(r)
            token, every = (every & _PLACE).astype(np.intp) % len(t), (every >> _PLACE_BITS).astype(np.intp)
            heads = distinct(every)
            size = np.diff(np.append(heads, len(every)))
            total = np.take(g, token[heads], 0)
            again = np.flatnonzero(size > 1)
            if len(again):
                size = size[again]
                total[again] = np.add.reduceat(np.take(g, token[places(heads[again], size)], 0), np.cumsum(size) - size)
            self._move(every[heads], total)
        for x in rows:
            self.used += np.bincount(x, minlength=len(self.used)).astype(np.float32)

    def _move(self, at: np.ndarray, gradient: np.ndarray) -> None:
        """Moves distinct rows; whole rows are read and written as single values, which is several times as fast as by columns."""
        power = np.take(self.power, at) + np.einsum("ij,ij->i", gradient, gradient)
        self.power[at] = power
        gradient *= (RATE / np.sqrt(power))[:, None]
        np.subtract(np.take(self.table, at, 0), gradient, gradient)
        self.table.view(_ROW).ravel()[at] = gradient.view(_ROW).ravel()


def learned() -> F.Column:
    """Whether a document is learned from; null where it has no id, and then it isn't."""
    return F.crc32(F.col("_key").cast("string").cast("binary")) % 7 != 2


def rows_for(size: int) -> int:
    """Rows of the table for an input of ``size`` bytes."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << (size // ROW_BYTES).bit_length()))


def in_part(low: int, high: int) -> F.Column:
    return F.pmod(F.xxhash64("_key", F.lit(10)), F.lit(PARTS[-1])).between(low, high - 1)


def train(docs: DataFrame, own: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The table after all parts. It is a sum of every token's gradients; what a task sends is one row for each SLICE of the table, and
    those are averaged MERGED tasks at a time, then all. A task has at least the text that its table's bytes are a small part of."""
    size = input_bytes(docs)
    rows = rows_for(size)
    docs, tasks = docs.where("learned"), size / (2.5 * rows * CLASSES * 4)
    table, power = np.zeros((rows, CLASSES), np.float32), np.full(rows, 1e-3, np.float32)
    for low, high in zip(PARTS, PARTS[1:]):
        some = docs.where(in_part(low, high)).coalesce(max(8, int(tasks * (high - low) / PARTS[-1])))
        table, power = _trained(some, own, bias, table, power)
    return table


def _trained(docs: DataFrame, own: np.ndarray, bias: np.ndarray, table: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One part's steps from ``table``, and the tasks' tables averaged: a row that no task used stays as it was."""
    from pyspark import TaskContext

    spark, n_slices = docs.sparkSession, len(table) // SLICE
    before = spark.sparkContext.broadcast((table, power))  # MOST_ROWS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        for _, part in blocks(batches, "text", 4_000_000):
            t = Tokens(part.column("text"))
            m = m or Learner(bias, *before.value)
            m.learn(t.features(len(m.table)), t.classes(own))
        if m:
            group = TaskContext.get().partitionId() // MERGED
            for low in range(0, n_slices, SENT):  # the table isn't copied whole
                some = range(low, min(low + SENT, n_slices))
                cut = [slice(k * SLICE, (k + 1) * SLICE) for k in some]
                sent = ([x[c].astype(kind).tobytes() for c in cut] for x, kind in ((m.table, np.float16), (m.power, np.float32), (m.used, np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([group] * len(cut), pa.int64()), *(pa.array(x, pa.binary()) for x in sent)], ["slice", "tasks", "weights", "power", "used"])

    def averaged(kind: type) -> Callable:
        def average(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, strength, used = np.zeros((SLICE, CLASSES)), np.zeros(SLICE), np.zeros(SLICE)
            for part in parts:  # one task's update at a time
                for w, p, u in zip(*(part.column(c) for c in ("weights", "power", "used"))):
                    n = np.frombuffer(u.as_buffer(), np.float32)
                    total += n[:, None] * np.frombuffer(w.as_buffer(), kind).reshape(-1, CLASSES)
                    strength += n * np.frombuffer(p.as_buffer(), np.float32)
                    used += n
            some = np.maximum(used, 1)
            out = (total / some[:, None], strength / some, used)
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), *(pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in out)], ["slice", "weights", "power", "used"])

        return average

    kinds, path = "slice long, weights binary, power binary, used binary", fresh(spark, "maxent")
    some = docs.mapInArrow(run, f"slice long, tasks long, {kinds[12:]}").groupBy("slice", "tasks").applyInArrow(averaged(np.float16), kinds)
    some.groupBy("slice").applyInArrow(averaged(np.float32), kinds).write.parquet(path)
    table, power = table.copy(), power.copy()
    for r in spark.read.schema(kinds).parquet(path).collect():  # the table, MOST_ROWS rows at most
        used = np.flatnonzero(np.frombuffer(r["used"], np.float32))
        at = r["slice"] * SLICE + used
        table[at] = np.frombuffer(r["weights"], np.float32).reshape(-1, CLASSES)[used]
        power[at] = np.frombuffer(r["power"], np.float32)[used]
    before.unpersist()
    return table, power


def with_contexts(m: np.ndarray, c: np.ndarray, pair: np.ndarray, triple: np.ndarray, begins: np.ndarray, starts: int) -> np.ndarray:
    """Probabilities of tokens from those without pairs and triples, and the counts of each token's word, pair and triple. A context's
    count is that of the token or pair before; a document's begin was met ``starts`` times."""
    before, before_two = (np.concatenate([x[:1], x[:-1]]) for x in (c, pair))
    before[begins] = before_two[begins] = starts
    p = (pair + PAIR * m) / (before + PAIR)
    return (triple + TRIPLE * p) / (before_two + TRIPLE)


def score_texts(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each whole text, learning from all that aren't held out.

    A null or empty text is its end alone. Repeated rows are scored and learned from each. A row without a key has a null held_out
    and is not learned from. A text of any length is scored whole, its document in one block of its own where it is long; ties do not
    occur. Other columns of ``df`` are not looked at. Passes over the texts, none of which shuffles them: counts,
    gradient steps (each part reads its own documents), scores. Which documents a task learns from follows the file splits, so the
    last digits of ``score`` depend on how the table is stored.
    """
    docs = scan(df.select(F.col(key).cast("long").alias("_key"), F.col(column).alias("text")), ["_key", "text"]).withColumn("learned", learned())

    def of_block(rows: pa.Table):
        t = Tokens(rows.column("text"))
        keys, at = t.keys()
        yes = np.repeat([bool(x) for x in rows.column("learned").to_pylist()], np.diff(t.first))
        group = np.full(len(keys), _CONTEXT, np.uint8)
        group[at[: len(t.h)]] = t.ending
        return keys, np.bincount(at[np.tile(yes, 3)], minlength=len(keys)), group

    answers = Answers(docs, of_block, top=OWN, block_bytes=BLOCK_BYTES, shard_bytes=BLOCK_BYTES, top_below=_CONTEXT)
    answers.groups.pop(_CONTEXT, None)
    n, v = (sum(g[k] for g in answers.groups.values()) for k in (0, 1))
    top = sorted((np.uint64(k & (2**64 - 1)), c, g) for k, c, g in answers.top)
    own = np.array([k for k, _, _ in top], np.uint64)
    size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for g, (tokens, words) in answers.groups.items():
        size[OWN + g], kinds[OWN + g] = tokens, words
    for k, (_, c, g) in enumerate(top):
        size[k] = c
        size[OWN + g] -= c
        kinds[OWN + g] -= 1
    real = np.ones(CLASSES, bool)
    real[len(own) : OWN] = False  # fewer words than classes: the rest is never drawn
    bias = np.where(real, np.log(size + 1), -50.0).astype(np.float32)
    table = train(docs, own, bias)

    shared = df.sparkSession.sparkContext.broadcast((table, own, bias, size + kinds + 1))
    read = answers.reader()
    base_total = float(n + v + 1)
    starts = docs.where("learned").count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, own_, bias_, room = shared.value
        for block, rows in blocks(batches, "text", BLOCK_BYTES):
            t = Tokens(rows.column("text"))
            keys, at = t.keys()
            count = read(block)
            if len(count) != len(keys):
                raise RuntimeError("a block changed between two passes")
            c, pair, triple = count[at].reshape(3, -1)
            cls = t.classes(own_)
            feats = t.features(len(weights))
            p = np.where(cls < OWN, 0.0, np.log((c + 1) / room[cls]))
            for a in range(0, len(cls), SCORED):
                s = log_softmax(weights, bias_, feats[:, a : a + SCORED])
                p[a : a + SCORED] += s[np.arange(len(s)), cls[a : a + SCORED]]
            p = with_contexts(np.exp(p), c, pair, triple, t.first[:-1], starts)
            sums = [np.add.reduceat(x, t.first[:-1]) for x in (np.log10((c + 1) / base_total), np.log10(p), (c > 0).astype(np.int64))]
            held = pa.compute.invert(rows.column("learned"))
            many = rows.num_rows
            yield pa.RecordBatch.from_arrays([rows.column("_key").combine_chunks(), held.combine_chunks(), pa.array(np.diff(t.first)), pa.array(sums[2]), pa.array(np.full(many, n, np.int64)), pa.array(sums[0]), pa.array(sums[1])], [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.mapInArrow(run, f"{key} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
