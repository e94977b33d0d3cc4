import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from cases import TEXTS, empty, table
from vellumist.llm import maxent as M
from vellumist.llm.counts import Answers, ranked_hashes
from vellumist.llm.shared import scan


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def corpus(n=400):
    r = random.Random(6)
    w = {0: ["the", "cat", "sat", "on", "mat"], 1: ["der", "hund", "lief", "weg", "schnell"]}
    out = []
    for _ in range(n):
        k, t = r.randint(0, 1), []
        for _ in range(r.randint(5, 60)):
            t.append(w[k][len(t) % 5] if r.random() < 0.8 else "r%d" % r.randint(0, 300))
        out.append(" ".join(t))
    return out


def learner(bias):
    return M.Learner(bias, np.zeros((M.LEAST_ROWS, M.CLASSES), np.float32), np.full(M.LEAST_ROWS, 1e-3, np.float32))


def test_base_by_brute_force_and_model_on_held_out(spark):
    texts = corpus() + TEXTS
    rows = {r.doc_id: r for r in M.score_texts(table(spark, texts).repartition(3)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    c = Counter(t for i, x in enumerate(texts) if not held[i] for t in tokens(x))
    n, v = sum(c.values()), len(c)
    for i, x in enumerate(texts):
        t = tokens(x)
        assert (rows[i].held_out, rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (held[i], len(t), sum(c[k] > 0 for k in t), n)
        assert math.isclose(rows[i].base_score, sum(math.log10((c[k] + 1) / (n + v + 1)) for k in t), rel_tol=1e-9)
    out = [rows[i] for i in range(400) if held[i]]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.05 * abs(sum(r.base_score for r in out))


def test_probabilities_add_up_to_one():
    r = np.random.default_rng(1)
    p = np.exp(M.log_softmax(r.normal(size=(M.LEAST_ROWS, M.CLASSES)).astype(np.float32), np.zeros(M.CLASSES, np.float32), r.integers(0, M.LEAST_ROWS, (M.FEATURES, 50))))
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_gradient_steps_lower_the_loss():
    t = M.Tokens(pa.array(corpus()))
    own = np.sort(np.unique(t.h)[:10])
    m, f, y = learner(np.zeros(M.CLASSES)), t.features(M.LEAST_ROWS), t.classes(own)
    loss = lambda: -M.log_softmax(m.table, m.bias, f)[np.arange(len(y)), y].mean()
    before = loss()
    for _ in range(3):
        m.learn(f, y)
    assert loss() < 0.6 * before


def test_a_step_sums_the_gradients_of_all_tokens_of_a_row():
    r = np.random.default_rng(2)
    rows, target = r.integers(0, 9, (M.FEATURES, 40)), r.integers(0, M.CLASSES, 40)
    rows[1, :20] = rows[0, :20]  # a row shared by features, twice for one token
    m = learner(r.normal(size=M.CLASSES))
    m.table[:9] = r.normal(size=(9, M.CLASSES))
    table, power = m.table.astype(np.float64), m.power.astype(np.float64)
    s = sum(table[x] for x in rows) + m.bias
    g = np.exp(s) / np.exp(s).sum(1, keepdims=True)
    g[np.arange(40), target] -= 1
    total = np.zeros_like(table)
    for x in rows:
        np.add.at(total, x, g)
    power += (total**2).sum(1)
    m.learn(rows, target)
    assert np.allclose(m.power, power, rtol=1e-3)
    assert np.allclose(m.table, table - total * (M.RATE / np.sqrt(power))[:, None], atol=1e-4)
    assert (m.used == np.bincount(rows.ravel(), minlength=M.LEAST_ROWS)).all()


def test_word_probabilities_by_brute_force(spark, monkeypatch):
    """Without a hashed table the whole score is counts: classes by the bias, words in them, pairs and triples."""
    texts = corpus(120) + [None, "", "never seen before words", "x" * 5000]
    monkeypatch.setattr(M, "train", lambda docs, own, bias: np.zeros((M.LEAST_ROWS, M.CLASSES), np.float32))
    monkeypatch.setattr(M, "BLOCK_BYTES", 3000)
    rows = {r.doc_id: r for r in M.score_texts(table(spark, texts).repartition(3)).collect()}
    docs = [tokens(x) for x in texts]
    learned = [t for i, t in enumerate(docs) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in learned for w in t)
    t = M.Tokens(pa.array([" ".join(x for x in c if x), None]))
    hashes = dict(zip([x for x in c if x] + [None], t.h.tolist()))
    signed = lambda w: hashes[w] - (1 << 64) if hashes[w] >= 1 << 63 else hashes[w]
    own = set(sorted(c, key=lambda w: (-c[w], signed(w)))[: M.OWN])
    ending = lambda w: int(M.Tokens(pa.array([w])).ending[0]) if w else 0
    cls = {w: ("own", w) if w in own else ("rest", ending(w)) for t in docs for w in t}
    size, kinds = Counter(), Counter()
    for w in c:
        size[cls[w]] += c[w]
        kinds[cls[w]] += 1
    weight = {k: size[k] + 1 for k in {("own", w) for w in own} | {("rest", e) for e in range(M.ENDINGS)}}
    grams = [Counter() for _ in range(4)]
    every = sum(weight.values())
    history = lambda t, i: (t[i - 2] if i > 1 else "<s>", t[i - 1] if i else "<s>")
    for t in learned:
        for i, w in enumerate(t):
            u, v = history(t, i)
            for g, k in zip(grams, ((v, w), v, (u, v, w), (u, v))):
                g[k] += 1
    for n, t in enumerate(docs):
        total = 0.0
        for i, w in enumerate(t):
            u, v = history(t, i)
            p = weight[cls[w]] / every
            if cls[w][0] == "rest":
                p *= (c[w] + 1) / (size[cls[w]] + kinds[cls[w]] + 1)
            p = (grams[0][v, w] + M.PAIR * p) / (grams[1][v] + M.PAIR)
            p = (grams[2][u, v, w] + M.TRIPLE * p) / (grams[3][u, v] + M.TRIPLE)
            total += math.log10(p)
        assert math.isclose(rows[n].score, total, rel_tol=1e-4), n


def test_table_grows_with_the_input_up_to_its_limit():
    assert M.rows_for(0) == M.LEAST_ROWS and M.rows_for(1 << 60) == M.MOST_ROWS and M.rows_for(1 << 31) == 1 << 18
    assert M.LEAST_ROWS < M.rows_for((1 << 30) - 1) < M.MOST_ROWS


def test_parts_take_each_document_once(spark):
    df = spark.range(500).withColumnRenamed("id", "_key")
    parts = [{r[0] for r in df.where(M.in_part(a, b)).collect()} for a, b in zip(M.PARTS, M.PARTS[1:])]
    assert sum(map(len, parts)) == 500 and len(set().union(*parts)) == 500 and all(parts)


def test_totals_of_blocks_that_are_split(spark, tmp_path):
    texts = corpus(300)
    path = str(tmp_path / "d")
    table(spark, texts).repartition(4).write.parquet(path)
    docs = scan(spark.read.parquet(path), ["doc_id", "text"])

    def of_block(rows):
        t = M.Tokens(rows.column("text"))
        from vellumist.llm.counts import ranked

        keys, at = ranked(t.h)
        return keys, np.bincount(at, minlength=len(keys)), np.zeros(len(keys), np.uint8)

    a = Answers(docs, of_block, top=3, block_bytes=2000)
    c = Counter(t for x in texts for t in tokens(x))
    assert a.groups[0] == (sum(c.values()), len(c))
    assert [n for _, n, _ in a.top] == sorted(c.values(), reverse=True)[:3]


def test_small_tables(spark):
    assert M.score_texts(empty(spark)).collect() == []
    df = spark.createDataFrame([(None, "a b"), (5, None), (5, None)], "doc_id long, text string")
    rows = M.score_texts(df).collect()
    assert len(rows) == 3 and sorted(r.n_tokens for r in rows) == [1, 1, 3] and all(math.isfinite(r.score) for r in rows)


def test_ranks_of_hashes_are_those_of_a_plain_sort():
    r = np.random.default_rng(3)
    wide = r.integers(0, 1 << 63, 70000, dtype=np.uint64) << np.uint64(1)
    close = np.concatenate([wide, wide[:20] + np.uint64(1), wide[:9] + np.uint64(2)])[::-1]  # a few differ in their lowest bits only
    for h in (wide[:0], wide[:1], wide, np.concatenate([wide, wide]), close, r.integers(0, 40, 5000).astype(np.uint64)):
        keys, at = ranked_hashes(h)
        plain, inverse = np.unique(h, return_inverse=True)
        assert (keys == plain).all() and len(keys) == len(plain) and (at == inverse).all()


def test_a_step_is_put_in_order_by_row_and_place():
    rows = np.random.default_rng(4).integers(M.MOST_ROWS - 50, M.MOST_ROWS, (M.FEATURES, M.STEP)).astype(np.int32)
    x = M.by_row(rows).astype(np.int64)
    order = np.argsort(rows.ravel(), kind="stable")
    assert x.nbytes == 8 * rows.size and (x % (M.FEATURES * M.STEP) == order).all() and (x // (M.FEATURES * M.STEP) == rows.ravel()[order]).all()
    assert M.by_row(rows).itemsize == 4
