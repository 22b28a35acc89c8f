"""Column expressions over boxes and pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> list[Column]:
    """The box inside its page, with x1 >= x0 and y1 >= y0, to two places."""
    a = F.greatest(F.lit(0.0), F.least(x0, width))
    b = F.greatest(F.lit(0.0), F.least(y0, height))
    return [F.round(v, 2) for v in (a, b, F.greatest(a, F.least(x1, width)), F.greatest(b, F.least(y1, height)))]


def valid_box(box: Column) -> Column:
    """Array of four: negatives to 0, ordered, two places. Null if it has not four entries."""
    z = F.transform(box, lambda v: F.greatest(F.lit(0.0), v))
    return F.when(F.size(box) == 4, F.array(*[F.round(v, 2) for v in (z[0], z[1], F.greatest(z[0], z[2]), F.greatest(z[1], z[3]))]))


def scale_box(box: list[Column], factor_x: Column, factor_y: Column) -> list[Column]:
    return [F.round(box[0] * factor_x, 2), F.round(box[1] * factor_y, 2), F.round(box[2] * factor_x, 2), F.round(box[3] * factor_y, 2)]


def line_width(width: Column, height: Column, target: int = 32, least: int = 32, most: int = 1024) -> Column:
    """Width of a text line scaled to the target height, within bounds, rounded up to a multiple of 4."""
    ratio = F.when(height > 0, width / height).otherwise(1.0)
    w = F.greatest(F.lit(least), F.least(F.lit(most), F.bround(F.lit(float(target)) * ratio).cast("int")))
    return (F.ceil(w / 4) * 4).cast("int")
