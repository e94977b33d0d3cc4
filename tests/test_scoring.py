"""Model output, vendor formats and the scorers."""

import json
import math

from pyspark.sql import functions as F

from vellumist.functions import output as O
from vellumist.operators import reshape as R
from vellumist.operators import scoring as S


def test_repair():
    for raw, want in [
        ('{"a": [1, 2', {"a": [1, 2]}),
        ("```json\n[{\"bbox_2d\": [1,2,3,4], \"label\": \"x\"},]\n```", [{"bbox_2d": [1, 2, 3, 4], "label": "x"}]),
        ("here: {'text': 'it'} and more", {"text": "it"}),
        ('{"t": "cut off', {"t": "cut off"}),
        ("nothing", None),
        (None, None),
    ]:
        assert O.repaired(raw) == want
    assert O.normalized_keys([{"bbox_2d": [1, 2, 3, 4], "label": "x"}]) == [{"bbox": [1, 2, 3, 4], "text": "x"}]
    assert O.normalized_keys([[1, 2, 3, 4]]) == [{"bbox": [1, 2, 3, 4]}]
    assert O.harvested({"a": [{"text": "x"}, {"b": {"value": "y"}}]}) == ["x", "y"]
    assert O.plain_markdown("# T\n* **b** [l](u) `c`\n") == "T\nb l c\n"


def test_output_columns(spark):
    df = spark.createDataFrame([("see [100, 200] and [0,0,1000,2000]", 500, 1000, '{"k": {"text": "a"}}'), (None, 1, 1, "plain")], "p string, w int, h int, j string")
    a, b = df.select(O.rescaled_prompt(F.col("p"), F.col("w"), F.col("h")).alias("p"), O.harvest_text(F.col("j")).alias("j")).collect()
    assert (a.p, a.j, b.p, b.j) == ("see [50, 200] and [0, 0, 500, 1000]", "a", None, "plain")
    img = spark.createDataFrame([([[0, 0, 0, 0], [0, 9, 0, 0], [0, 0, 0, 0]],), ([],)], "x array<array<int>>")
    got = [r.v for r in img.select(O.laplacian_variance(F.col("x")).alias("v")).collect()]
    assert math.isclose(got[0], ((-36 - 9) / 2) ** 2) and got[1] == 0


def test_vendor_pages(spark):
    item = {"Word": "w", "X1": 5, "Y1": 1, "X2": 9, "Y2": 2, "X3": 8, "Y3": 7, "X4": 4, "Y4": 6}
    rows = [(json.dumps({"words_data": [item, {"Word": "bad"}], "image": {"width": 3, "height": 4}}),), (json.dumps({"success": False, "error": "no", "words_data": [item]}),), ("{broken",)]
    a, b, c = R.from_vendor(spark.createDataFrame(rows, "j string"), "j").collect()
    assert [(w.text, w.box) for w in a.words] == [("w", [4, 1, 9, 7]), ("bad", [0, 0, 0, 0])] and a.lines == [] and a.width == 3
    assert (b.words, b.error) == ([], "no") and c.words == []


def test_response_walk(spark):
    word = lambda t: {"symbols": [{"text": x} for x in t], "confidence": 0.5, "boundingBox": {"vertices": [{"x": 1, "y": 2}]}}
    doc = {"fullTextAnnotation": {"pages": [{"blocks": [{"paragraphs": [{"words": [word("ab"), word("c")]}, {"words": [word("d")]}]}]}]}}
    rows = R.dense_paragraphs(R.from_response(spark.createDataFrame([("k", json.dumps(doc))], "doc_id string, j string"), "doc_id", "j")).orderBy("idx").collect()
    assert [(r.text, r.paragraph_id, r.idx) for r in rows] == [("ab", 0, 0), ("c", 0, 1), ("d", 1, 2)]


def test_parallel_lists_and_metadata(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [[0.0, 0.0, 1.0, 1.0], [1.0, 1.0, 2.0, 2.0]])], "t array<string>, b array<array<double>>")
    items = df.select(R.from_parallel(df, "t", "b").alias("i")).first()["i"]
    assert [(i.text, i.box) for i in items] == [("a", [0, 0, 1, 1]), ("b", [1, 1, 3, 3])]
    assert [i.box for i in df.select(R.scaled(R.from_parallel(df, "t", "b"), 0.36).alias("i")).first()["i"]] == [[0, 0, 0, 0], [0, 0, 1, 1]]
    truth = json.dumps({"gt_parse": {"text_lines": [{"text": "x", "bbox": [0, 0, 1, 1], "line_id": 0}], "quality_metrics": {"m": 1.5}}})
    a, b = R.decoded(spark.createDataFrame([(truth,), ("{",)], "ground_truth string")).collect()
    assert a.lines[0].text == "x" and a.quality == {"m": 1.5} and a.words == [] and b.lines == []


ROWS = [
    (1, "f", "reading", "[text]", "Read it", "hello world", '{"text": "hello  world"}'),
    (2, "f", "reading", "[text]", "Read {text}", "a", "a"),
    (3, "f", "reading", "[text]", "Read it", "", ""),
    (4, "f", "detection", "[box]", "Where?", "[[0,0,10,10],[20,20,30,30]]", "boxes (0,0,10,9) and [50, 50, 60, 60]"),
    (5, "f", "detection", "[box]", "Where?", "[]", "[[1,1,2,2]]"),
    (6, "f", "detection", "[box]", "Where?", "none", "none"),
    (7, "f", "reading", "[lines, box]", "Read", '[{"text": "b", "bbox": [0,20,10,30]}, {"text": "a", "bbox": [0,0,10,10]}]', '[{"label": "a", "bbox_2d": [0,0,10,10]}, {"label": "x", "bbox_2d": [0,20,10,29]}'),
    (8, "f", "reading", "[lines, box]", "Read", '[{"text": "b", "bbox": [0,20,10,30]}]', "nothing"),
]


def table(spark):
    return spark.createDataFrame(ROWS, "sample_id long, filename string, task_type string, output_type string, question string, expected_answer string, predicted_answer string")


def test_scorers(spark):
    parts = S.route(table(spark))
    assert {k: sorted(r.sample_id for r in v.collect()) for k, v in parts.items()} == {"text": [1, 2, 3], "detection": [4, 5, 6], "lines": [7, 8]}
    t = {r.sample_id: r for r in S.score_text(parts["text"]).collect()}
    assert (t[1].exact_match, t[2].exact_match, t[3].anls) == (1.0, None, 1.0)
    total = [r for r in S.text_summary(S.score_text(parts["text"]), "task_type").collect() if r.task_type is None][0]
    assert (total.n, total.exact_matches) == (3, 2.0)
    assert S.score_text(parts["text"], drop_templates=True).count() == 2
    d = {(r.sample_id, r.threshold): r for r in S.score_detection(parts["detection"], (50, 95)).collect()}
    assert (d[4, 50].tp, d[4, 50].fp, d[4, 50].fn, round(d[4, 50].mean_iou, 3)) == (1, 1, 1, 0.9) and d[4, 95].tp == 0
    assert (d[5, 50].precision, d[5, 50].recall) == (0.0, 1.0) and d[6, 50].f1 == 1.0
    x = {r.sample_id: r for r in S.score_lines(parts["lines"]).collect()}
    assert x[7].valid_json and x[7].matched == 2 and x[7].bbox_f1 == 1.0 and x[7].overall_cer > 0 and x[7].matched_wer == 0.5
    assert not x[8].valid_json and x[8].bbox_recall == 0
