"""8. Language ID: a bidirectional gated recurrent network over bytes.

It is trained in numpy by backpropagation through time on a bounded sample of windows of all labelled documents, labels every byte position of a
text, and pools the positions' probabilities over the document. Texts are cut into windows of WINDOW bytes that run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import buffers, mix, slices

HIDDEN = 16
WINDOW = 48
SAMPLE = 4800  # windows for each language, about, that the classifier is fitted on, drawn from anywhere in its labelled texts
STEPS, BATCH, RATE = 240, 256, 0.02
UNKNOWN = "und"
MIN_SCORE = 0.4  # a document below it is rejected
PAD = 256
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all windows as rows, PAD behind a text's end; the text of each window)."""
    n = np.diff(offsets)
    count = -(-n // WINDOW)
    owner = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][owner] + k * WINDOW
    at = start[:, None] + np.arange(WINDOW)
    rows = np.append(data, np.zeros(WINDOW, np.uint8))[at].astype(np.int16)
    rows[at >= offsets[1:][owner][:, None]] = PAD
    return rows, owner


class Network:
    """Two gated recurrent layers, one for each direction, under one softmax for each position."""

    def __init__(self, names: list[str], seed: int = 1):
        self.names, r, h = names, np.random.default_rng(seed), HIDDEN
        self.p = {}
        for d in "fb":
            self.p["x" + d] = r.normal(0, 0.3, (PAD + 1, 3 * h)).astype(np.float32)
            self.p["u" + d] = r.normal(0, h**-0.5, (h, 3 * h)).astype(np.float32)
        self.p["o"] = r.normal(0, 0.2, (2 * h, len(names))).astype(np.float32)
        self.p["c"] = np.zeros(len(names), np.float32)

    def fit(self, rows: np.ndarray, labels: np.ndarray, steps: int = STEPS, rate: float = RATE, seed: int = 2) -> "Network":
        """Adam over random batches of windows; labels are one for each window."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            at = r.integers(0, len(rows), min(BATCH, len(rows)))
            grads = self.gradients(rows[at], labels[at])[1]
            lr = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
        return self

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions, and its gradients by backpropagation through time."""
        h, (b, steps) = HIDDEN, rows.shape
        states, caches = {}, {}
        for d in "fb":
            state, out, cache = np.zeros((b, h), np.float32), np.zeros((steps, b, h), np.float32), []
            for t in range(steps) if d == "f" else reversed(range(steps)):
                g, a = self.p["x" + d][rows[:, t]], state @ self.p["u" + d]
                zr = 1 / (1 + np.exp(-(g[:, : 2 * h] + a[:, : 2 * h])))
                n = np.tanh(g[:, 2 * h :] + zr[:, h:] * a[:, 2 * h :])
                cache.append((t, state, zr, n, a[:, 2 * h :]))
                state = n + zr[:, :h] * (state - n)
                out[t] = state
            states[d], caches[d] = out, cache
        both = np.concatenate([states["f"], states["b"]], 2)
        logits = both @ self.p["o"] + self.p["c"]
        logits -= logits.max(2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(2, keepdims=True)
        real = (rows.T != PAD)[:, :, None] / max(1, (rows != PAD).sum())
        picked = np.take_along_axis(prob, labels[None, :, None].repeat(steps, 0), 2)
        loss = -float((np.log(picked + 1e-12) * real).sum())
        delta = prob
        np.put_along_axis(delta, labels[None, :, None].repeat(steps, 0), picked - 1, 2)
        delta = (delta * real).astype(np.float32)
        grads = {"o": np.tensordot(both, delta, ([0, 1], [0, 1])), "c": delta.sum((0, 1))}
        down = delta @ self.p["o"].T
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, carry = self.p["u" + d], np.zeros((b, h), np.float32)
            du, dg = np.zeros_like(u), np.zeros((steps, b, 3 * h), np.float32)
            for t, before, zr, n, an in reversed(caches[d]):
                dh = down[t, :, part] + carry
                z, r = zr[:, :h], zr[:, h:]
                dn = dh * (1 - z) * (1 - n * n)
                dg[t, :, :h] = dh * (before - n) * z * (1 - z)
                dg[t, :, h : 2 * h] = dn * an * r * (1 - r)
                dg[t, :, 2 * h :] = dn
                da = dg[t].copy()
                da[:, 2 * h :] *= r
                du += before.T @ da
                carry = dh * z + da @ u.T
            flat, at = dg.reshape(-1, 3 * h), rows.T.ravel()
            grads["x" + d] = np.stack([np.bincount(at, flat[:, k], PAD + 1) for k in range(3 * h)], 1).astype(np.float32)
            grads["u" + d] = du
        return loss, grads

    def _prepared(self) -> dict:
        """Halved gate weights: a logistic gate is then (1 + tanh) / 2."""
        q, h = {}, HIDDEN
        for d in "fb":
            half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(np.float32)
            q["x" + d] = np.ascontiguousarray((self.p["x" + d] * half).T)
            q["u" + d] = np.ascontiguousarray((self.p["u" + d] * half).T)
        return q

    def pooled(self, data: np.ndarray, offsets: np.ndarray, chunk: int = 1024) -> np.ndarray:
        """Mean probability of each language over all byte positions of each text (zeros for an empty one)."""
        q, h = self._prepared(), HIDDEN
        out = np.zeros((len(offsets) - 1, len(self.names)))
        rows, owner = windows(data, offsets)
        for a in range(0, len(rows), chunk):
            x = np.ascontiguousarray(rows[a : a + chunk].T)
            b = x.shape[1]
            states = np.empty((2 * h, WINDOW, b), np.float32)
            for d, at in (("f", 0), ("b", h)):
                state = np.zeros((h, b), np.float32)
                xt, ut = q["x" + d], q["u" + d]
                for t in range(WINDOW) if d == "f" else reversed(range(WINDOW)):
                    g, s = np.take(xt, x[t], 1, mode="clip"), ut @ state
                    zr = g[: 2 * h]
                    zr += s[: 2 * h]
                    np.tanh(zr, zr)
                    zr += 1
                    zr *= 0.5
                    n = s[2 * h :]
                    n *= zr[h:]
                    n += g[2 * h :]
                    np.tanh(n, n)
                    state -= n
                    state *= zr[:h]
                    state += n
                    states[at : at + h, t] = state
            logits = self.p["o"].T @ states.reshape(2 * h, -1)
            logits += self.p["c"][:, None]
            logits -= logits.max(0)
            np.exp(logits, logits)
            logits /= logits.sum(0)
            logits = logits.reshape(-1, WINDOW, b)
            logits *= x != PAD
            per = logits.sum(1)
            for k in range(len(self.names)):
                out[:, k] += np.bincount(owner[a : a + chunk], per[k], len(out))
        return out / np.maximum(np.diff(offsets), 1)[:, None]


def held_out(key: str = "doc_id") -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def train(df: DataFrame, column: str = "text", key: str = "doc_id", lang: str = "lang") -> Network | None:
    """The network fitted on about SAMPLE windows of each language that has a label, however few its documents; None without any.

    Whether a window of a text is in the sample is a hash of the row's key and its number, under a threshold for each language, so
    that each part of each text has the same chance and frequent languages don't crowd out others. The sample is bounded: SAMPLE * 2
    windows for each language, in all, come to the driver.
    """
    labelled = df.where(F.col(lang).isNotNull() & F.col(column).isNotNull() & ~held_out(key))
    length = F.ceil(F.octet_length(column) / WINDOW)
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).agg(F.sum(length)).collect() if r[1]}  # a row for each language
    if not counts:
        return None
    names = sorted(counts)
    share = {x: min(1.0, SAMPLE / n) for x, n in counts.items()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                data, offsets = buffers(part.column(column))
                count = -(-np.diff(offsets) // WINDOW)
                owner = np.repeat(np.arange(len(count)), count)
                k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                seed = part.column("_seed").to_numpy(False).view(np.uint64)
                draw = (mix(seed[owner] ^ mix(k.astype(np.uint64))) >> np.uint64(11)) / 2.0**53
                draw /= np.array([share.get(x, 1.0) for x in part.column(lang).to_pylist()])[owner]
                at = np.flatnonzero(draw < 1)
                begin = offsets[owner[at]] + k[at] * WINDOW
                pieces = [data[a:b].tobytes() for a, b in zip(begin, np.minimum(begin + WINDOW, offsets[owner[at] + 1]))]
                yield pa.RecordBatch.from_arrays([part.column(lang).take(pa.array(owner[at])), pa.array(draw[at]), pa.array(pieces, pa.binary())], [lang, "_draw", "piece"])

    chosen = labelled.select(lang, column, F.xxhash64(key, F.lit(7)).alias("_seed"))
    rows = chosen.mapInArrow(cut, f"{lang} string, _draw double, piece binary").orderBy("_draw", "piece").limit(SAMPLE * 2 * len(names)).toArrow()
    at = {n: k for k, n in enumerate(names)}
    label = np.array([at[x] for x in rows.column(lang).to_pylist()], np.int64)
    lens = np.array([len(x) for x in rows.column("piece").to_pylist()], np.int64)
    data = np.frombuffer(b"".join(rows.column("piece").to_pylist()), np.uint8)
    grid, owner = windows(data, np.concatenate(([0], np.cumsum(lens))))
    if not len(grid):
        return None
    label = label[owner]
    by = [np.flatnonzero(label == k) for k in range(len(names))]
    most_windows = max(len(x) for x in by)
    even = np.concatenate([np.resize(x, most_windows) for x in by if len(x)])  # each language as often
    return Network(names).fit(grid[even], label[even])


def lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    total = np.concatenate(([0], np.cumsum(_LETTER[data], dtype=np.int64)))
    has = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
        has[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return has


def _predict(part: pa.RecordBatch, column: str, network: Network | None) -> tuple[list[str], np.ndarray]:
    data, offsets = buffers(part.column(column))
    if network is None:
        return [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
    p, some = network.pooled(data, offsets), lettered(data, offsets)
    best = p.argmax(1)
    return [network.names[k] if ok else UNKNOWN for k, ok in zip(best, some)], np.where(some, np.clip(p.max(1), 0, 1), 0.0)


def identify(df: DataFrame, column: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Language and score of each whole text: `und` and 0 for one that is null or has no letter, or if nothing was labelled.

    Only ``column`` is an input of a prediction. Texts of any length are labelled whole, window by window. Of languages with equal
    probabilities the first by name is predicted. Repeated rows are predicted each. No shuffle after the fit.
    """
    network = train(df, column, key, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, 2_000_000):
                name, score = _predict(part, column, network)
                yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), part.column("held_out"), pa.array(name, pa.string()), pa.array(score)], [key, "held_out", "lang_pred", "score"])

    return df.select(key, column, held_out(key).alias("held_out")).mapInArrow(run, f"{key} long, held_out boolean, lang_pred string, score double")


def keep_identified(df: DataFrame, column: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows whose text has a language with a score of at least MIN_SCORE; all columns as they are."""
    network = train(df, column, key, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, 2_000_000):
                name, score = _predict(part, column, network)
                yield part.filter(pa.array((np.array(name) != UNKNOWN) & (score >= MIN_SCORE)))

    return df.mapInArrow(run, df.schema)


def op8_recurrent_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
