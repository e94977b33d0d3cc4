"""Boxes as column expressions: x1, y1, x2, y2 in pixels with the origin at the top left unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(F.lit(0), x2 - x1) * F.greatest(F.lit(0), y2 - y1)


def intersection(a: tuple, b: tuple) -> Column:
    return area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union; 0 for boxes that only touch or have no area."""
    i = intersection(a, b)
    union = area(*a) + area(*b) - i
    return F.when(union > 0, i / union).otherwise(F.lit(0.0))


def containment(a: tuple, b: tuple) -> Column:
    """Intersection over the smaller area."""
    least = F.least(area(*a), area(*b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(F.lit(0.0))


def box_of(alias: str) -> tuple:
    return tuple(F.col(f"{alias}.{c}") for c in ("x1", "y1", "x2", "y2"))


def from_xywh(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Relative x, y, w, h rounded to three places as corners, then pixels cut toward zero."""
    corners = [F.round(x, 3), F.round(y, 3), F.round(x + w, 3), F.round(y + h, 3)]
    return [(c * s).cast("int").alias(n) for c, s, n in zip(corners, (width, height, width, height), ("x1", "y1", "x2", "y2"))]


def hull(xs: list[Column], ys: list[Column]) -> list[Column]:
    """The upright box round a polygon."""
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def ordered_corners(vertices: Column) -> Column:
    """Four vertices as top-left, top-right, bottom-right, bottom-left: least x + y first, greatest last but one, then by larger x.

    Fewer than four give zeros.
    """
    zero = F.struct(F.lit(0).cast("double").alias("x"), F.lit(0).cast("double").alias("y"))

    def corners(v: Column) -> Column:
        b, c = F.get(v, F.lit(1)), F.get(v, F.lit(2))
        tr, bl = F.when(b["x"] >= c["x"], _point(b)).otherwise(_point(c)), F.when(b["x"] >= c["x"], _point(c)).otherwise(_point(b))
        return F.array(_point(F.get(v, F.lit(0))), tr, _point(F.get(v, F.lit(3))), bl)

    by_sum = F.array_sort(F.transform(vertices, lambda p, i: F.struct((p["x"] + p["y"]).alias("s"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
    return F.when(F.size(vertices) >= 4, let(by_sum, corners)).otherwise(F.array(zero, zero, zero, zero))


def _point(p: Column) -> Column:
    return F.struct(p["x"].alias("x"), p["y"].alias("y"))


def four_corners(points: list[tuple[Column, Column]]) -> list[Column]:
    """:func:`ordered_corners` of exactly four points given as columns, which five comparisons put in order."""
    p = [F.struct((x + y).alias("s"), F.lit(i).alias("i"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate(points)]
    low, high = (F.least(p[0], p[1]), F.least(p[2], p[3])), (F.greatest(p[0], p[1]), F.greatest(p[2], p[3]))
    mid = F.greatest(*low), F.least(*high)
    b, c = F.least(*mid), F.greatest(*mid)
    return [_point(F.least(*low)), _point(F.when(b["x"] >= c["x"], b).otherwise(c)), _point(F.greatest(*high)), _point(F.when(b["x"] >= c["x"], c).otherwise(b))]


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def any_scale(box: list[Column], width: Column, height: Column) -> list[Column]:
    """Corners that may be fractions or pixels, in order, inside the page and a pixel wide at least."""
    frac = F.greatest(*box) <= 1
    px = [F.when(frac, c * s).otherwise(c) for c, s in zip(box, (width, height, width, height))]
    x1, x2, y1, y2 = F.least(px[0], px[2]), F.greatest(px[0], px[2]), F.least(px[1], px[3]), F.greatest(px[1], px[3])
    into = lambda v, top: F.greatest(F.lit(0), F.least(top - 1, v.cast("int")))
    a, b = into(x1, width), into(y1, height)
    return [a, b, F.greatest(a + 1, into(x2, width)), F.greatest(b + 1, into(y2, height))]


def lerp_word(left: Column, right: Column, from_: Column, to: Column) -> list[Column]:
    """The stretch of a line's edge between two ratios."""
    return [left + (right - left) * from_, left + (right - left) * to]


def rotate(x: Column, y: Column, cx: Column, cy: Column, degrees: Column) -> list[Column]:
    a = F.radians(degrees)
    return [cx + (x - cx) * F.cos(a) - (y - cy) * F.sin(a), cy + (x - cx) * F.sin(a) + (y - cy) * F.cos(a)]


def luminance(v: Column) -> Column:
    """Relative luminance of a gray value of 0 to 255."""
    s = v / 255.0
    return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


BOX_TEXT = r"[\[(]\s*(-?[0-9]+)\s*,\s*(-?[0-9]+)\s*,\s*(-?[0-9]+)\s*,\s*(-?[0-9]+)\s*[\])]"


def boxes_in_text(c: Column) -> Column:
    """Every [a, b, c, d] or (a, b, c, d) of whole numbers in a text."""
    groups = [F.regexp_extract_all(c, F.lit(BOX_TEXT), F.lit(k)) for k in range(1, 5)]
    return F.transform(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "abcd")]), lambda s: F.array(*(s[n].cast("long") for n in "abcd")))


def boxes_in_json(c: Column) -> Column:
    """Boxes of strict JSON: a list of lists of four, or of objects with one of the usual keys; null if it is something else."""
    keys = ("bbox", "bounding_box", "box", "bbox_2d", "bbox2d")
    schema = "array<struct<" + ", ".join(f"{k}: array<bigint>" for k in keys) + ">>"
    lists = F.from_json(c, "array<array<bigint>>")
    objects = F.filter(F.transform(F.from_json(c, schema), lambda o: F.coalesce(*(o[k] for k in keys))), lambda b: F.size(b) == 4)
    return F.when(c.rlike(r"^\s*\[\s*\["), F.filter(lists, lambda b: F.size(b) == 4)).when(c.rlike(r"^\s*\[\s*\{"), objects)


def iou_unclamped(a: tuple, b: tuple) -> Column:
    """IoU in single precision whose areas are products of the sides as they are, so that a box given backwards has a negative one."""
    side = lambda t: (t[2] - t[0]).cast("float") * (t[3] - t[1]).cast("float")
    i = intersection(a, b).cast("float")
    union = side(a) + side(b) - i
    return F.when(union > 0, (i / union).cast("float")).otherwise(F.lit(0.0).cast("float"))


def rotated_size(w: Column, h: Column, degrees: Column) -> list[Column]:
    """Width and height of the upright box round a rotated one."""
    s, c = F.abs(F.sin(F.radians(degrees))), F.abs(F.cos(F.radians(degrees)))
    return [(w * c + h * s), (w * s + h * c)]


def placed(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    """The box of a size round a centre."""
    return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]


def quad_to_box(xs: list[Column], ys: list[Column], width: Column, height: Column) -> list[Column]:
    """A quad (top left, top right, bottom right, bottom left) as a box: x by least and greatest, y by the means of its top and bottom
    edge; relative to the page, held within 0 and 1, three places."""
    box = [F.least(*xs) / width, (ys[0] + ys[1]) / 2 / height, F.greatest(*xs) / width, (ys[2] + ys[3]) / 2 / height]
    return [F.round(clamp01(c), 3) for c in box]


def quad_relative(xs: list[Column], ys: list[Column], width: Column, height: Column) -> Column:
    """A quad's corners relative to the page, held within 0 and 1, three places: eight numbers in order."""
    return F.array(*(F.round(clamp01(c), 3) for x, y in zip(xs, ys) for c in (x / width, y / height)))


def round_down(x: Column, multiple: Column) -> Column:
    """The greatest multiple not above x; a multiple below 1 counts as 1."""
    return x - x % F.greatest(F.lit(1), multiple)
