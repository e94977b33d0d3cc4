import random

import numpy as np
import pyarrow as pa

from cases import TEXTS, empty, table
from vellumist.llm import language as L
from vellumist.llm.text import buffers

SOUNDS = {"aa": ["ka", "ti", "mo", "ku", "ra"], "bb": ["sch", "ein", "ung", "ö", "tz"], "cc": ["wh", "ing", "th", "ed", "ly"]}


def words(lang, r, n):
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_gradients_equal_differences():
    n = L.Network(["a", "b", "c"])
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    r = np.random.default_rng(0)
    rows = r.integers(97, 105, (5, L.WINDOW)).astype(np.int16)
    rows[0, 20:] = L.PAD
    labels = np.array([0, 1, 2, 0, 1])
    _, g = n.gradients(rows, labels)
    for k in g:
        flat = n.p[k].ravel()
        for at in np.argsort(-abs(g[k].ravel()))[:3]:
            old, e = flat[at], 1e-3
            flat[at] = old + e
            up = n.gradients(rows, labels)[0]
            flat[at] = old - e
            down = n.gradients(rows, labels)[0]
            flat[at] = old
            assert abs((up - down) / (2 * e) - g[k].ravel()[at]) < 2e-3 * max(1, abs(g[k].ravel()[at])), k


def test_fast_pass_equals_the_trained_one():
    n = L.Network(["a", "b"])
    data, offsets = buffers(pa.array(["hello world " * 9, "", "x"]))
    got = n.pooled(data, offsets)
    assert np.allclose(got.sum(1), [1, 0, 1], atol=1e-5)
    rows, owner = L.windows(data, offsets)
    loss = n.gradients(rows[owner == 2], np.array([0]))[0]
    assert abs(-np.log(got[2, 0]) - loss) < 1e-4


def test_held_out_accuracy(spark):
    r = random.Random(4)
    rows = [(i, words(lang := r.choice(sorted(SOUNDS)), r, r.randint(3, 60)), lang) for i in range(600)]
    rows += [(1000 + i, t, None) for i, t in enumerate(TEXTS)] + [(2000, "123 456", "aa")]
    got = {x.doc_id: x for x in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    out = [(got[i], lang) for i, _, lang in rows if i < 1000 and got[i].held_out]
    assert len(out) > 100 and sum(g.lang_pred == lang for g, lang in out) > 0.97 * len(out)
    assert all(0 <= g.score <= 1 for g in got.values())
    for i in (1000, 1001, 1002, 2000):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[1008].lang_pred != "und"


def test_labels_never_decide(spark):
    rows = [(i, "ka ti mo " * 5, "aa") for i in range(40)]
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {x.lang_pred for x in got} == {"aa"}
    assert L.identify(empty(spark)).collect() == []
    assert {x.lang_pred for x in L.identify(table(spark, lang=None)).collect()} == {"und"}


def test_filter_keeps_all_columns(spark):
    df = table(spark)
    kept = L.keep_identified(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, x in enumerate(TEXTS) if x and any(c.isalpha() for c in x)}
