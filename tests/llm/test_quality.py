import os
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa

from cases import TEXTS, empty, table
from vellumist.llm import quality as Q
from vellumist.llm.shared import scan
from vellumist.llm.text import buffers


def brute(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(three)
    covered = {i + d for i, t in enumerate(three) if c[t] > 1 for d in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)]


def test_base_counts():
    texts = TEXTS + ["a\nb\na\n a\n\n\na", "#*$%&|<> a b c a b c", "\n\n", "a b a b a b", "x\r\ny\r\nx\r\n"]
    got = Q.base_counts(*buffers(pa.array(texts, pa.string())))
    for i, x in enumerate(texts):
        assert [int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == brute(x), repr((x or "")[:60])


def test_runs():
    texts = TEXTS + ["ab"]
    got, at = Q.ngrams(*buffers(pa.array(texts, pa.string()))), 0
    for t in texts:
        raw = b" " * (Q.ORDER - 1) + (t or "").encode()
        for i in range(len((t or "").encode())):
            assert int(got[at]) == int.from_bytes(raw[i : i + Q.ORDER], "big")
            at += 1
    assert at == len(got)


def kneser_ney(counts, order):
    """p(run) of the counted runs (bytes), and a function of any run, by dictionaries."""
    levels = [dict(counts)]
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    levels = levels[::-1]
    off = [Q.discounts(Counter(t.values())) for t in levels]

    def p(g):
        if not g:
            return 1 / 256
        t, d = levels[len(g) - 1], off[len(g) - 1]
        of = {x: n for x, n in t.items() if x[:-1] == g[:-1]}
        if not of:
            return p(g[1:])
        take = lambda n: d[min(n, 3) - 1]
        return (max(0, of[g] - take(of[g])) if g in of else 0) / sum(of.values()) + sum(map(take, of.values())) / sum(of.values()) * p(g[1:])

    return {g: p(g) for g in counts}, p


def run_counts(texts, order):
    return Counter(raw[i : i + order] for t in texts for raw in [b" " * (order - 1) + (t or "").encode()] for i in range(len(raw) - order + 1))


def as_bytes(gram, order):
    return gram.to_bytes(order, "big")


def test_kneser_ney_by_brute_force(spark):
    texts = ["the cat sat on the mat", "the dog sat on a log", "Größe und Maß", "a | b | c", "the the the", "日本語"]
    for order in (1, 2, 4):
        counts = run_counts(texts, order)
        rows = spark.createDataFrame([(int.from_bytes(g, "big"), n) for g, n in counts.items()], "gram long, n long")
        want, p = kneser_ney(counts, order)
        got = {as_bytes(r.gram, order): r.p for r in Q.kneser_ney(rows, order).collect()}
        assert set(got) == set(want) and all(abs(got[g] - want[g]) < 1e-12 for g in want)
        context = b"the "[4 - order + 1 :]
        assert abs(sum(p(context + bytes([b])) for b in range(256)) - 1) < 1e-9


def test_discounts_by_hand():
    # n1=4, n2=2, n3=1, n4=1: y=4/8
    d = Q.discounts({1: 4, 2: 2, 3: 1, 4: 1})
    assert np.allclose(d, [0.5, 2 - 3 * 0.5 * 1 / 2, min(3 - 4 * 0.5 * 1 / 1, 2.85)])


def quantile(pairs, q):
    pairs, at = sorted(pairs), 0.0
    for value, n in pairs:
        at += n
        if at >= q * sum(n for _, n in pairs) - 1e-9:
            return value


def test_perplexity_and_verdict_by_brute_force(spark, monkeypatch):
    """Small blocks, copies, two languages and none, and junk: every score, band and verdict."""
    import math
    import random

    monkeypatch.setattr(Q, "BLOCK_BYTES", 4000)
    r = random.Random(5)
    vocabulary = ["".join(r.choice(["th", "er", "an", "ö", "on"]) for _ in range(r.randint(1, 4))) for _ in range(60)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(40, 90))) for _ in range(40)]
    texts += [" | ".join(r.choice(vocabulary) for _ in range(60)), "#" * 9, "# " * 80, None, ""] + texts[:5]
    langs = ["en" if i % 3 else "de" if i % 2 else None for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, langs)), "doc_id long, text string, lang string").repartition(3)
    model, _ = kneser_ney(run_counts(dict.fromkeys(texts), Q.ORDER), Q.ORDER)
    score = []
    for t in texts:
        real = sum(any(c.isalnum() for c in w) for w in re.findall("[^\x20\x09-\x0d]+", t or ""))
        score.append(-sum(math.log10(model[g]) * n for g, n in run_counts([t], Q.ORDER).items()) / real if real else None)
    rows = {x.doc_id: x for x in Q.quality_rules(df).collect()}
    seen = {}
    for i, t in enumerate(texts):
        x = rows[i]
        assert (x.log_perplexity is None) == (score[i] is None)
        if score[i] is not None:
            assert abs(x.log_perplexity - score[i]) < 1e-4
            if not x.base_failed:
                seen[t, langs[i] or ""] = (math.floor(x.log_perplexity * Q.BIN), math.floor(math.log2(min(x.n_words, Q.STEADY_WORDS)) * 4), langs[i] or "")
    for lang in ("en", "de", ""):
        own = Counter(x[:2] for x in seen.values() if x[2] == lang)
        bins = [((b + 0.5) / Q.BIN, 2 ** (s / 8 + 1 / 16) / 10, own[b, s] + n * Q.SHARED_TEXTS / len(seen)) for (b, s), n in Counter(x[:2] for x in seen.values()).items()]
        median = quantile([(v, n) for v, _, n in bins], 0.5)
        low, high = (max(Q.LEAST_SPREAD, abs(quantile([((v - median) * w, n) for v, w, n in bins], q))) for q in (0.25, 0.75))
        for i, t in enumerate(texts):
            if (langs[i] or "") == lang:
                x = rows[i]
                reach = math.sqrt(max(1, min(x.n_words, Q.STEADY_WORDS)) / 100)
                inside = x.log_perplexity is not None and median - Q.LOWER_SPREADS * low / reach <= x.log_perplexity <= median + Q.UPPER_SPREADS * high / reach
                assert x.kept == (not x.base_failed and inside), i
    assert not rows[42].kept and {x.doc_id for x in Q.keep_good(df).collect()} == {i for i in rows if rows[i].kept}


def test_bands_reject_what_is_unlike_its_language(spark):
    import random

    r = random.Random(1)
    vocabulary = ["".join(r.choice(["th", "er", "an", "in", "on"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(120)) for _ in range(60)]
    texts += [" ".join("".join(r.choice("qxzjkvw0189#%&") for _ in range(9)) for _ in range(120))]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(100, None, "en"), (101, "too short", None)], "doc_id long, text string, lang string")
    rows = {x.doc_id: x for x in Q.quality_rules(df).collect()}
    assert len(rows) == 63
    assert all(rows[i].kept for i in range(60)) and not rows[60].kept and not rows[60].base_failed
    assert not rows[100].kept and rows[100].base_failed and not rows[101].kept
    kept = Q.keep_good(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == set(range(60))


def test_copies_set_neither_model_nor_bands(spark):
    import random

    r = random.Random(3)
    vocabulary = ["".join(r.choice(["th", "er", "an", "in", "on"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(r.choice(vocabulary[k % 5 * 50 :]) for _ in range(120)) for k in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100 + i, texts[7], "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    once = df.where("doc_id < 100")
    grams = lambda d: sorted(map(tuple, Q._unfolded(Q._count_and_ask(scan(d, ["text"]), "text", 3)).collect()))
    k, n = np.unique(Q.ngrams(*buffers(pa.array(texts))), return_counts=True)
    assert grams(df) == grams(once) == sorted(zip(k.astype(int).tolist(), n.tolist()))
    want = {x.doc_id: x for x in Q.quality_rules(once).collect()}
    got = {x.doc_id: x for x in Q.quality_rules(df).collect()}
    assert len(got) == 360 and all(got[i] == want[i] for i in want) and sum(x.kept for x in got.values()) == 360
    assert Q.keep_good(df).count() == 360


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "en", "x", 5, 1)], "doc_id long, text string, lang string, _file string, _start int, shard int")
    assert Q.keep_good(df).columns == df.columns and Q.keep_good(df).collect() == []


def test_small_tables(spark):
    assert Q.quality_rules(empty(spark)).collect() == [] and Q.keep_good(empty(spark)).collect() == []
    rows = {x.doc_id: x for x in Q.quality_rules(table(spark)).collect()}
    for i, x in enumerate(TEXTS):
        b = brute(x)
        assert [rows[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == b
        assert rows[i].base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])


def test_tables_that_are_not_read_again_are_removed(spark, monkeypatch, tmp_path):
    made = []

    def fresh(session, name):
        made.append(str(tmp_path / f"{name}-{len(made)}"))
        return "file://" + made[-1]

    for module in (Q, sys.modules["vellumist.llm.shared"], sys.modules["vellumist.llm.counts"]):
        monkeypatch.setattr(module, "fresh", fresh)
    rows = Q.quality_rules(table(spark, ["some words of a text " * 9, "other words " * 30, None])).collect()
    assert len(rows) == 3 and any("/runs-" in x for x in made)
    assert {os.path.basename(x).split("-")[0] for x in made if os.path.exists(x)} & {"ngrams", "runs", "probabilities", "model"} == set()
