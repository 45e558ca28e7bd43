"""Field and image geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD_LENGTH, FIELD_WIDTH = 120.0, 160.0 / 3


def right_open(value: Column, edges: list[float], labels: list[str], unknown: str = "unknown") -> Column:
    """FN-MATH-03: label i for edges[i-1] <= value < edges[i]."""
    out = F.when(value.isNull() | F.isnan(value.cast("double")), unknown)
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(value < edge, label)
    return out.otherwise(labels[len(edges)])


def right_closed(value: Column, edges: list[float], labels: list[str]) -> Column:
    """FN-MATH-04: label i for edges[i] < value <= edges[i+1]; null outside."""
    out = F.when(value.isNull() | (value <= edges[0]), F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels, strict=True):
        out = out.when(value <= edge, label)
    return out


def normalize_xy(x: Column, y: Column, direction: Column) -> tuple[Column, Column]:
    """FN-MATH-01: every play as if it went right; an unknown direction raises."""
    bad = F.raise_error(F.concat(F.lit("bad play direction "), F.coalesce(direction, F.lit("null")))).cast("double")
    turn = lambda v, size: F.when(direction == "right", v).when(direction == "left", size - v).otherwise(bad)
    return turn(x, FIELD_LENGTH), turn(y, FIELD_WIDTH)


def hash_of(y: Column, half: float, tolerance: float = 1.5) -> Column:
    """FN-MATH-02: left, middle or right of the hash marks, by distance from the centre."""
    return F.when(y.isNull(), "unknown").when(y > half - tolerance, "left").when(y < -(half - tolerance), "right").otherwise("middle")


def iou(a: list[Column], b: list[Column]) -> Column:
    """FN-MATH-11: of boxes x1, y1, x2, y2; 0 without area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda v: (v[2] - v[0]) * (v[3] - v[1])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def project(h: list, x: Column, y: Column) -> tuple[Column, Column]:
    """FN-MATH-12: a 3 x 3 homography, row by row; null at the horizon."""
    w = h[6] * x + h[7] * y + h[8]
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)


def invert3(h: list) -> list:
    """FN-MATH-12: the adjugate, which inverts up to scale; project() divides the scale out."""
    a, b, c, d, e, f, g, i, j = h
    return [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]


def intersection(p: list[Column], q: list[Column]) -> tuple[Column, Column]:
    """FN-MATH-13: of the lines through (x1, y1, x2, y2); null for parallels."""
    det = (p[0] - p[2]) * (q[1] - q[3]) - (p[1] - p[3]) * (q[0] - q[2])
    u, v = p[0] * p[3] - p[1] * p[2], q[0] * q[3] - q[1] * q[2]
    return F.try_divide(u * (q[0] - q[2]) - (p[0] - p[2]) * v, det), F.try_divide(u * (q[1] - q[3]) - (p[1] - p[3]) * v, det)


def centre_box(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """FN-ARR-07: corners of a box given by its centre and size."""
    return [x - w / 2, y - h / 2, x + w / 2, y + h / 2]


def yolo_box(box: list[Column], width: Column, height: Column) -> list[Column]:
    """FN-ARR-08: centre and size as shares of the image; null for boxes without size."""
    w, h = F.abs(box[2] - box[0]), F.abs(box[3] - box[1])
    there = (w > 0) & (h > 0)
    return [F.when(there, v) for v in ((box[0] + box[2]) / 2 / width, (box[1] + box[3]) / 2 / height, w / width, h / height)]


def success(down: Column, distance: Column, gained: Column) -> Column:
    """FN-MATH-10: 50, 70 and 100 percent of the distance by down; null without a distance."""
    need = F.when(down == 1, 0.5).when(down == 2, 0.7).otherwise(1.0)
    return F.when((distance > 0) & gained.isNotNull() & down.isNotNull(), gained >= need * distance)


def quality_score(defenders: Column, confidence: Column, error: Column, full: Column) -> Column:
    """PRJ-08: 0.4 defenders, 0.3 registration, 0.2 full-defense frames, 0.1 confidence."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return 0.4 * unit(defenders / 11.0) + 0.3 * unit(1 - error / 4.0) + 0.2 * unit(full) + 0.1 * unit(confidence)


def usable(defenders: Column, error: Column, full: Column) -> Column:
    return F.coalesce((defenders >= 10) & (error <= 2.0) & (full >= 0.6), F.lit(False))
