"""Joins, assignment, layout, shards and tasks on small inputs with brute force beside them."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumist.operators import assignment, detection, diversity, layout, sharding, spatial, stats, tasks


def test_assignment_equals_brute_force():
    r = np.random.default_rng(1)
    for _ in range(150):
        n, m = map(int, r.integers(1, 6, 2))
        v = np.where(r.random((n, m)) < 0.6, r.random((n, m)), 0)
        best = (0, 0.0)
        small, large = sorted((n, m))
        for perm in itertools.permutations(range(large), small):
            vals = [v[i, p] if n <= m else v[p, i] for i, p in enumerate(perm)]
            best = max(best, (sum(x > 0 for x in vals), sum(vals)))
        got = assignment.best_assignment(v)
        assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})
        assert len(got) == best[0] and abs(sum(v[i, j] for i, j in got) - best[1]) < 1e-9


def test_overlap_join_equals_nested_loops(spark):
    r = random.Random(2)
    boxes = lambda n: [(r.randint(0, 2), i, *(a := (r.randint(0, 900), r.randint(0, 300))), a[0] + r.randint(0, 400), a[1] + r.randint(0, 90)) for i in range(n)]
    a, b = boxes(60), boxes(60)
    s = "page_id long, idx long, x1 long, y1 long, x2 long, y2 long"
    got = spatial.overlap_join(spark.createDataFrame(a, s), spark.createDataFrame(b, s)).select("l.page_id", "l.idx", "r.idx").collect()
    want = {(p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and max(p[2], q[2]) < min(p[4], q[4]) and max(p[3], q[3]) < min(p[5], q[5])}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_assign_mixes_lone_and_contested_pairs(spark):
    rows = [(1, 0, 0, 0.9), (1, 1, 1, 0.6), (1, 1, 2, 0.7), (1, 2, 2, 0.8), (2, 0, 0, 0.3)]
    got = assignment.assign(spark.createDataFrame(rows, "page_id long, e long, p long, iou double"), 0.5).collect()
    assert {tuple(x)[:3] for x in got} == {(1, 0, 0), (1, 1, 1), (1, 2, 2)}


@pytest.mark.parametrize("n, m, strict, one_sided", [(0, 0, (1, 1, 1), (1, 1, 1)), (0, 3, (0, 0, 0), (0, 1, 0)), (3, 0, (0, 0, 0), (1, 0, 0))])
def test_empty_sides(spark, n, m, strict, one_sided):
    for flag, want in ((False, strict), (True, one_sided)):
        assert tuple(spark.range(1).select(*detection.rates(F.lit(0), F.lit(n), F.lit(m), flag)).first()) == want


def test_average_precision(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1)], "score double, hit int")
    assert abs(detection.average_precision(df, 2).first()["ap"] - (0.5 + 0.5 * 2 / 3)) < 1e-9
    assert detection.average_precision(df.limit(0), 0).first()["ap"] == 0


def test_clusters_and_layout(spark):
    rows = [(1, 0, "b", 80, 0, 90, 16), (1, 1, "a", 0, 2, 40, 18), (1, 2, "c", 0, 100, 40, 116), (1, 3, "d", 0, 8, 8, 24)]
    w = spark.createDataFrame(rows, "page_id long, idx long, text string, x1 long, y1 long, x2 long, y2 long")
    groups = {r.idx: r.group for r in layout.anchored_lines(w).collect()}
    assert groups == {0: 1, 1: 1, 2: 2, 3: 3}
    clusters = {r.idx: r.cluster for r in layout.moving_lines(w).collect()}
    assert clusters[0] == clusters[1] == clusters[3] != clusters[2]
    text = layout.layout_text(layout.line_islands(w.where("idx < 3")), layout.line_height_and_density(w)).first()["text2d"]
    assert [x.split() for x in text.split("\n")] == [["a", "b"], [], ["c"]]
    assert layout.reading_text(w).first()["text"] == "b a d c"
    merged = {r.group: r for r in layout.merged_lines(layout.anchored_lines(w)).collect()}
    assert (merged[1].text, merged[1].y1, merged[1].y2) == ("a b", 2, 18)


def test_numbers_without_one_task(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    got = {r.k: r.n for r in sharding.numbered(df, ["k"]).collect()}
    assert got == {i: i for i in range(1000)}
    sizes = [r["count"] for r in sharding.chunks(spark.range(10), ["id"], 3, 10).groupBy("worker").count().orderBy("worker").collect()]
    assert sizes == [3, 3, 4]


def test_splits_are_by_value(spark):
    df = spark.createDataFrame([(i, str(i % 500)) for i in range(2000)], "i int, t string")
    rows = df.select("t", sharding.split(F.col("t"), {"a": 0.8, "b": 0.1, "c": 0.1}).alias("s")).collect()
    assert len({(r.t, r.s) for r in rows}) == 500
    assert 0.7 < sum(r.s == "a" for r in rows) / 2000 < 0.9
    assert [r.r for r in spark.range(6).select(sharding.rotation(F.col("id")).alias("r")).collect()] == ["small", "90", "180", "270", "small", "90"]


def test_k_center_equals_the_matrix(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    rows = diversity.k_center(df, 20).collect()
    assert [x.vec_id for x in rows] == diversity.greedy_order(v)[:20]
    assert all(a.radius_after == b.radius_before and a.radius_before >= b.radius_before for a, b in zip(rows, rows[1:]))
    assert diversity.k_center(df.limit(0), 3).collect() == []


def test_full_order_ranks_every_row(spark):
    from vellumist.plans import registry

    r = np.random.default_rng(5)
    v = np.concatenate([r.normal(size=(60, 8)) + 3 * np.eye(8)[k] for k in range(5)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(999, None)], "vec_id long, embedding array<double>")
    want = diversity.greedy_order(v)
    for candidates in (20, 8192):
        rows = diversity.full_order(df, candidates=candidates).collect()
        assert [x.vec_id for x in rows] == want and [x.rank for x in rows] == list(range(1, 301))
        assert all(a.radius_after == b.radius_before for a, b in zip(rows, rows[1:])) and rows[-1].radius_after == 0
    assert diversity.full_order(df.limit(0)).collect() == []
    copies = spark.createDataFrame([(i, [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert [x.vec_id for x in diversity.full_order(copies, candidates=2).collect()] == list(range(9))
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").toArrow()
    rows = registry.QUERIES["kcenter_full"](spark, "/root/testdata/sf0.001").collect()
    order = diversity.greedy_order(np.array(e.column("embedding").to_pylist()))
    assert [x.vec_id for x in rows] == [e.column("vec_id")[i].as_py() for i in order] and len(rows) == e.num_rows


def test_rules_let_nulls_pass(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 50.0)], "i int, m double")
    assert [r.b for r in df.select(stats.violates([("m", ">", 10)]).alias("b")).collect()] == [False, False, True]
    assert stats.percentiles(spark.createDataFrame([(x,) for x in (1, 2, 4, 8)], "v int"), ["v"], (0.8,)).first()["value"] == 5.6


def test_tasks(spark):
    items = spark.createDataFrame([([("ab",), ("abcd",)],), ([("a",)],)], "x array<struct<text: string>>")
    assert [r.n for r in items.select(F.size(tasks.eligible(F.col("x"))).alias("n")).collect()] == [1, 1]
    assert spark.range(1).select(tasks.type_list(F.lit("[lines, box]")).alias("t")).first()["t"] == ["lines", "box"]
    def soft(e, p, least):
        used, total = set(), 0.0
        for g in e:
            best, at = 0.0, -1
            for j, x in enumerate(p):
                if j not in used and (r := ratio(g, x)) > best:
                    best, at = r, j
            if best >= least and at >= 0:
                used.add(at)
                total += best
        r, q = (total / len(x) if x else 0.0 for x in (e, p))
        return q, r, 2 * q * r / (q + r) if q + r else 0.0

    def ratio(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return 2 * t[-1][-1] / (len(a) + len(b))

    import random

    r = random.Random(3)
    token = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
    cases = [(["color", "x"], ["colour", "y", "x"]), ([], ["a"]), (["a"], []), ([], [])]
    cases += [([token() for _ in range(r.randint(0, 12))], [token() for _ in range(r.randint(0, 12))]) for _ in range(200)]
    for least in (0.85, 0.6):
        df = spark.createDataFrame([(i, e, p) for i, (e, p) in enumerate(cases)], "k int, e array<string>, p array<string>")
        for x in assignment.soft_matches(df, "k", "e", "p", least).collect():
            assert np.allclose((x.precision, x.recall, x.f1), soft(*cases[x.k], least)), cases[x.k]
    assert abs(assignment.token_ratio("color", "colour") - 10 / 11) < 1e-12


def test_answers_and_empty_pages(spark):
    items = "array<struct<text: string, box: array<int>>>"
    row = ([("b", [5, 9, 7, 12]), ("a", [0, 1, 2, 3])], [("w", [1, 1, 2, 2])], "all text", "lay out", [("w", [1, 1, 2, 2])])
    df = spark.createDataFrame([row], f"lines {items}, words {items}, text string, text2d string, chosen {items}")
    levels = {c: F.col(c) for c in ("lines", "words")}
    cases = [("[text]", "reading", "all text"), ("[text2d]", "reading", "lay out"), ("[lines, box]", "reading", '[{"text":"a","bbox":[0,1,2,3]},{"text":"b","bbox":[5,9,7,12]}]'), ("[words]", "reading", '["w"]'), ("[box]", "detection", "[[0,1,2,3],[5,9,7,12]]"), ("[box]", "conditional_detection", "[[1,1,2,2]]"), ("[lines]", "localized_reading", "w"), ("[none]", "reading", None)]
    got = df.select(*(tasks.answer(F.lit(o), F.lit(t), levels, F.col("text"), F.col("text2d"), F.col("chosen")).alias(f"c{i}") for i, (o, t, _) in enumerate(cases))).first()
    assert list(got) == [w for *_, w in cases]
    pages = spark.range(40).withColumnRenamed("id", "page")
    rows = tasks.empty_prompts(pages, tasks.catalog(spark), "page").collect()
    assert len(rows) == 40 and {r.answer for r in rows} == {"", "[]"} and len({r.template for r in rows}) > 3
    for level in tasks.EXTENTS:
        for r in pages.select(tasks.fake_boxes(F.col("page"), F.lit(800), F.lit(1000), level).alias("b")).collect():
            assert all(0 <= a < c <= 800 and 0 <= b < d <= 1000 for a, b, c, d in r.b) and len(r.b) == 3
