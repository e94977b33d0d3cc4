"""Steps that are shared by many queries: what they give beside plain Python, and that they don't move rows that lie where they are needed."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumist.functions import batches, geometry, text
from vellumist.operators import assignment, spatial
from vellumist.plans import boxes, views

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain_words(t):
    for line, s in enumerate(t.split("\n")):
        at = 0
        for j, w in enumerate(s.split(" ")):
            if w:
                yield line, j, w, 8 * at, 8 * (at + len(w))
            at += len(w) + 1


def test_words_are_placed_without_a_shuffle(spark, tmp_path):
    texts = ["a  bc\n\n é日本 x ", "", None, " ", "one", "\n", "ü ö\nä" * 50, "x " * 3000]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    w = views.words(spark, str(tmp_path))
    assert "Exchange" not in plan(w) and "Window" not in plan(w)
    got = {(r.page_id, r.line, r.j, r.text, r.x1, r.x2) for r in w.collect()}
    assert got == {(i, *x) for i, t in enumerate(texts) if t is not None for x in plain_words(t)}
    assert {tuple(r) for r in views.words(spark, str(tmp_path), by_page=True).select("page_id", "line", "j", "text", "x1", "x2").collect()} == got
    many = pa.array([None, "", "é b"] * 400_000)
    assert text.starts_of(many)[2::3].to_pylist() == [[[0, 2]]] * 400_000


def test_relative_boxes_move_nothing(spark):
    assert "Exchange" not in plan(boxes.rel_to_px(spark, DIR))


def test_four_corners_as_sorted(spark):
    r = random.Random(7)
    rows = [tuple(float(r.randint(0, 3)) for _ in range(8)) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{c}{k} double" for k in range(4) for c in "xy"))
    points = [(F.col(f"x{k}"), F.col(f"y{k}")) for k in range(4)]
    by_sort = geometry.ordered_corners(F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in points)))
    assert all(a == b for a, b in df.select(by_sort.alias("a"), F.array(*geometry.four_corners(points)).alias("b")).collect())


def random_boxes(r, n, big):
    for page in range(6):
        for i in range(n):
            x, y = r.randint(-50, 900), r.randint(-50, 300)
            yield page, r.randint(0, 1), i, x, y, x + r.randint(0, big), y + r.randint(0, big // 3)


@pytest.mark.parametrize("big, step", [(60, 100_000), (500, 7)])
def test_page_pairs_equal_the_join_and_the_matching(spark, big, step):
    rows = list(random_boxes(random.Random(big), 60, big))
    df = spark.createDataFrame(rows, "page_id long, side int, idx long, x1 long, y1 long, x2 long, y2 long")
    joined = spatial.overlap_join(df.where("side = 0"), df.where("side = 1")).select("l.page_id", F.col("l.idx").alias("e"), F.col("r.idx").alias("p"), "iou")
    local = df.coalesce(1)
    assert "Exchange" not in plan(spatial.page_pairs(local))
    got = sorted(map(tuple, spatial.page_pairs(local).collect()))
    assert got == sorted(map(tuple, joined.collect())) and len(got) > 5
    one = spatial.page_pairs(local, best=0.1).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, assignment.assign(joined, 0.1).collect()))
    for page in range(6):
        pairs = [x for x in got if x[0] == page and x[3] >= 0.1]
        e, p = sorted({x[1] for x in pairs}), sorted({x[2] for x in pairs})
        value = np.zeros((len(e), len(p)))
        for _, i, j, v in pairs:
            value[e.index(i), p.index(j)] = v
        best, mine = assignment.best_assignment(value), [x for x in one if x.page_id == page]
        assert len({x.e for x in mine}) == len(mine) == len({x.p for x in mine}) == len(best)
        assert abs(sum(x.iou for x in mine) - sum(value[i, j] for i, j in best)) < 1e-9
    key, side = np.array([x[0] for x in rows]), np.array([x[1] for x in rows])
    box = [np.array([x[k] for x in rows]) for k in (3, 4, 5, 6)]
    cut = [np.concatenate(x).tolist() for x in zip(*spatial._candidates(key, side, box, 256, 64, step))]
    assert sorted(zip(*cut)) == sorted(zip(*(np.concatenate(x).tolist() for x in zip(*spatial._candidates(key, side, box, 256, 64)))))


def test_runs_are_cut_between_pages():
    rows = [pa.RecordBatch.from_pydict({"k": k, "v": list(range(len(k)))}) for k in ([1, 1, 2], [2, 2, 2], [None, None, 3], [3])]
    got = list(batches.whole_runs(iter(rows), "k", 2))
    assert sum(t.num_rows for t in got) == 10
    assert [x for t in got for x in t.column("k").to_pylist()] == [1, 1, 2, 2, 2, 2, None, None, 3, 3]
    ends = [(a.column("k")[-1].as_py(), b.column("k")[0].as_py()) for a, b in zip(got, got[1:])]
    assert len(got) > 1 and all(a != b for a, b in ends)
    assert batches.runs(pa.chunked_array([[5, 5, None, None, 6]])).tolist()[0] == 0


def test_detection_moves_rows_of_pages_only(spark):
    for q in (boxes.bbox_iou_pairs, boxes.det_prf_at_iou, boxes.det_sweep_map, boxes.det_sweep_wide, boxes.det_micro_prf, boxes.det_pr_ap):
        p = plan(q(spark, DIR))
        assert "Window [count" not in p and "_cx" not in p, q.__name__
    assert "Exchange" not in plan(boxes.det_hungarian(spark, DIR))


def test_edit_distance_is_exact_within_and_beyond_its_bounds(spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    r = random.Random(5)
    word = lambda n: "".join(r.choice("abé日") for _ in range(n))
    rows = [(a := word(r.randint(0, 150)), "".join(c for c in a if r.random() < q) + word(r.randint(0, 5))) for q in (0.5, 0.9, 0.99) for _ in range(25)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert all(x.d == plain(x.a, x.b) for x in df.select("*", text.edit_distance(F.col("a"), F.col("b")).alias("d")).collect())
    sentences = [(" ".join(a), " ".join(b)) for a, b in rows]
    for x in spark.createDataFrame(sentences, "a string, b string").select("*", text.reading_metrics(F.col("a"), F.col("b")).alias("m")).collect():
        e, p = x.a.split(), x.b.split()
        cer, wer = plain(x.a, x.b) / max(1, len(x.a), len(x.b)), plain(e, p) / max(1, len(e), len(p))
        if x.a and x.b:
            assert abs(x.m.cer - cer) < 1e-9 and abs(x.m.wer - wer) < 1e-9 and abs(x.m.anls - (1 - cer if cer < 0.5 else 0)) < 1e-9


def test_a_text_is_measured_once(spark):
    """The edit distance of letters, that of words and the list of distinct words stand in the plan once, and none is made anew a word."""
    df = spark.createDataFrame([("a b", "a c")], "e string, p string").select(text.reading_metrics(F.col("e"), F.col("p")).alias("m"))
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("levenshtein(") <= 6 and p.count("array_distinct(") == 1


def test_lines_are_found_as_by_plain_search():
    from vellumist.operators import layout

    r = random.Random(9)
    for _ in range(300):
        y1 = [r.choice([r.randint(0, 40), r.uniform(-20, 40)]) for _ in range(r.randint(0, 40))]
        y2 = [a + r.choice([3, 9, r.uniform(1, 12)]) for a in y1]
        for tolerance in (0, 1, 5):
            anchors, want = [], []
            for a, b in zip(y1, y2):
                g = next((k for k, (p, q) in enumerate(anchors) if abs(p - a) <= tolerance and abs(q - b) <= tolerance), None)
                if g is None:
                    g = len(anchors)
                    anchors.append((a, b))
                want.append(g + 1)
            assert layout.anchored_groups(y1, y2, tolerance) == want
        height, lines, want = min((b - a for a, b in zip(y1, y2)), default=0), [], []
        for a, b in zip(y1, y2):
            mid = (a + b) / 2
            k = next((k for k, x in enumerate(lines) if abs(mid - x[0]) <= height), None)
            if k is None:
                lines.append([mid, 1, len(lines)])
            else:
                x = lines.pop(k)
                lines.append([(x[0] * x[1] + mid) / (x[1] + 1), x[1] + 1, x[2]])
            want.append(lines[-1][2])
        assert layout.moving_clusters(y1, y2) == want


def test_many_lines_cost_no_search_of_all():
    import time

    from vellumist.operators import layout

    y = [40.0 * k for k in range(5000) for _ in range(20)]
    began = time.process_time()
    assert len(set(layout.moving_clusters(y, [v + 16 for v in y]))) == len(set(layout.anchored_groups(y, [v + 16 for v in y]))) == 5000
    assert time.process_time() - began < 10


def test_pages_are_moved_once(spark):
    """One exchange of texts; what else is exchanged is none."""
    from vellumist.plans import registry

    for name in ("layout_line_islands", "line_reading_order_text1d", "paragraph_rollup", "text2d", "degenerate_filter", "cond_detection_lookup"):
        p = plan(registry.QUERIES[name](spark, DIR))
        assert "ENSURE_REQUIREMENTS" not in p and "REPARTITION_BY_NUM" in p, name
    for name in ("word_line_cluster", "moving_line_cluster"):
        assert "Exchange" not in plan(registry.QUERIES[name](spark, DIR)), name


def test_layout_text_of_long_lines_and_gaps(spark):
    from vellumist.operators import layout

    rows = [(1, i, "ab", 16 * i + 400 * (i == 3), 0, 16 * i + 16 + 400 * (i == 3), 16) for i in range(5)] + [(1, 9, "é", 0, 100, 8, 116), (1, 10, "x", 8, 116, 16, 132)]
    w = spark.createDataFrame(rows, "page_id long, idx long, text string, x1 long, y1 long, x2 long, y2 long")
    got = layout.layout_text(layout.line_islands(w), layout.line_height_and_density(w)).first()["text2d"]
    line = ""
    for x in sorted(r[3] for r in rows[:5]):
        line += " " * max(round(x * 0.125) - len(line), 1 if line else 0) + "ab"
    assert got == line + "\n\né\n x"


def test_texts_are_normalized_in_parts(spark, monkeypatch):
    import unicodedata

    texts = ["ﬁ①" * 40_000, None, "", "plain", "é" * 700_000, "ﬁ"] * 3
    sizes, cut = [], batches.parts
    monkeypatch.setattr(text, "parts", lambda s, limit: (sizes.append(b - a) or (a, b) for a, b in cut(s, limit)))
    want = [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert text.normalized(pa.array(texts), "NFKC").to_pylist() == want and len(sizes) > 3
    short = ["ﬁ①", None, "", "plain"]
    df = spark.createDataFrame(list(enumerate(short)), "i int, t string").select("i", text.normalize("NFKC")(F.col("t")).alias("t"))
    assert [r.t for r in df.orderBy("i").collect()] == ["fi1", None, "", "plain"]
    assert "rlike" in plan(df).lower()  # ASCII texts aren't sent


def test_soft_matching_takes_lists_in_parts(spark, monkeypatch):
    got, cut = [], batches.parts
    monkeypatch.setattr(assignment, "parts", lambda s, limit: (got.append(int(sum(s[a:b]))) or (a, b) for a, b in cut(s, limit)))
    rows = pa.RecordBatch.from_pydict({"k": list(range(100)), "e": [["ab"] * 3000] * 99 + [None], "p": [["ab"] * 3000] * 100})
    class Frame:
        dtypes = [("k", "bigint")]
        select = lambda self, *a: self
        mapInArrow = lambda self, run, schema: list(run(iter([rows])))
    out = assignment.soft_matches(Frame(), "k", "e", "p")
    assert sum(b.num_rows for b in out) == 100 and max(got) <= 100_000
    assert [x for b in out for x in b.column(3).to_pylist()] == [1.0] * 99 + [0.0]
