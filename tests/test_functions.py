"""Text and geometry functions against hand-computed values and plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vellumist.functions import geometry as G
from vellumist.functions import text as T


def one(spark, expr, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expr.alias("r")).first()["r"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_text_goldens(spark):
    cases = [("", "", 0, 1, 0), ("", "x", 1, 0, 1), ("abc", "", 1, 0, 1), ("abcd", "abxd", 0.25, 0.75, 1), ("ab", "ax", 0.5, 0, 1), ("a b", "a", 2 / 3, 0, 0.5), ("a b c d", "a x c d", 1 / 7, 6 / 7, 0.25), ("日本語", "日本", 1 / 3, 2 / 3, 1)]
    df = spark.createDataFrame([(i, *c[:2], *map(float, c[2:])) for i, c in enumerate(cases)], "i int, e string, p string, cer double, anls double, wer double")
    e, p = F.col("e"), F.col("p")
    for r in df.select("*", T.distance_rate(e, p).alias("c"), T.anls(e, p).alias("a"), T.word_error_rate(e, p).alias("w")).collect():
        assert math.isclose(r.c, r.cer) and math.isclose(r.a, r.anls) and math.isclose(r.w, r.wer), r


def test_word_errors_equal_a_plain_table(spark):
    r = random.Random(1)
    rows = [(" ".join(r.choice("abcde é") for _ in range(r.randint(0, 9))), " ".join(r.choice("abcdé") for _ in range(r.randint(0, 9)))) for _ in range(200)]
    for x in spark.createDataFrame(rows, "e string, p string").select("*", T.word_error_rate(F.col("e"), F.col("p")).alias("w")).collect():
        a, b = x.e.split(), x.p.split()
        want = 0 if not a and not b else 1 if not a else distance(a, b) / max(len(a), len(b))
        assert math.isclose(x.w, want)


def test_reading_metrics_of_cjk(spark):
    m = one(spark, T.reading_metrics(F.col("e"), F.col("p")), e="日本語", p="日本")
    assert m.wer is None and 0 < m.cer < 1


def test_predicted_text(spark):
    for raw, want in [('{"text": "a"}', "a"), ('[{"answer": "b"}]', "b"), ('x ```json\n{"value": "c"}\n``` y', "c"), ("plain", "plain"), ('{"text": 3}', '{"text": 3}'), ("", "")]:
        assert one(spark, T.predicted_text(F.col("x")), x=raw) == want


def test_rouge_and_normal_forms(spark):
    r = one(spark, T.rouge_l(F.col("e"), F.col("p")), e="a b c d", p="a c e")
    assert (r.recall, round(r.precision, 6)) == (0.5, 0.666667)
    assert one(spark, T.normalize("NFKC")(F.col("x")), x="ﬁ①") == "fi1"
    assert one(spark, T.cut_at_word(F.col("x"), 8), x="abc defg hij") == "abc"


def test_iou_goldens(spark):
    for box, want in [((0, 0, 10, 10), 1), ((10, 0, 20, 10), 0), ((5, 0, 15, 10), 1 / 3), ((5, 5, 5, 5), 0)]:
        assert math.isclose(one(spark, G.iou(tuple(map(F.lit, (0, 0, 10, 10))), tuple(map(F.lit, box)))), want)


def test_boxes(spark):
    x = spark.range(1).select(*G.from_xywh(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.4), F.lit(100), F.lit(200))).first()
    assert tuple(x) == (10, 40, 40, 120)
    assert one(spark, G.boxes_in_text(F.col("t")), t="at [1, 2,3,4] and (5,6,7,8) not [1,2]") == [[1, 2, 3, 4], [5, 6, 7, 8]]
    assert one(spark, G.boxes_in_json(F.col("t")), t="[[1,2,3,4],[5,6]]") == [[1, 2, 3, 4]]
    assert one(spark, G.boxes_in_json(F.col("t")), t='[{"bbox_2d": [1,2,3,4]}]') == [[1, 2, 3, 4]]
    assert one(spark, G.boxes_in_json(F.col("t")), t="none") is None


@pytest.mark.parametrize("last, index, want", [(2, 0, "0000"), (10001, 10000, "10000")])
def test_page_names(spark, last, index, want):
    assert one(spark, T.page_name(F.lit(index), F.lit(last))) == want
