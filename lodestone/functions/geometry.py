"""Image regions: pixel bounds of normalized rectangles, scaling, confirmation, rotated projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIRMED_MILLI = 800


def _scaled(value: Column, extent: Column) -> Column:
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double")))
    return F.round(v * extent).cast("long")


def pixel_bounds(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, orientation: Column) -> Column:
    """Clamped top-left pixel rectangle of a normalized lower-left one (floats); orientations 5 to 8 swap the sides."""
    x, y, w, h = (c.cast("float") for c in (x, y, w, h))
    turned = orientation.between(5, 8)
    ow, oh = F.when(turned, height).otherwise(width).cast("long"), F.when(turned, width).otherwise(height).cast("long")
    one = F.lit(1.0).cast("float")
    left = F.least(_scaled(x, ow), ow - 1)
    top = F.least(_scaled(one - y - h, oh), oh - 1)
    right = F.least(F.greatest(_scaled(x + w, ow), left + 1), ow)
    bottom = F.least(F.greatest(_scaled(one - y, oh), top + 1), oh)
    return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height"))


def scaled_milli(value: Column, scale: Column) -> Column:
    """value * scale / 1000, half up."""
    return F.floor((value.cast("long") * F.greatest(scale, F.lit(1)) + 500) / 1000).cast("long")


def confirmation(confidence_milli: Column) -> Column:
    return F.when(confidence_milli >= CONFIRMED_MILLI, "confirmed").otherwise("low_confidence")


def projected(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, turns: Column) -> Column:
    """Percent box (left, top, width, height) of a pixel rectangle in an image turned clockwise by quarter turns."""
    t = F.pmod(turns, F.lit(4))
    left = F.when(t == 0, x).when(t == 1, height - y - h).when(t == 2, width - x - w).otherwise(y)
    top = F.when(t == 0, y).when(t == 1, x).when(t == 2, height - y - h).otherwise(width - x - w)
    odd = t % 2 == 1
    ow, oh = F.when(odd, height).otherwise(width), F.when(odd, width).otherwise(height)
    return F.struct((100.0 * left / ow).alias("left"), (100.0 * top / oh).alias("top"), (100.0 * F.when(odd, h).otherwise(w) / ow).alias("width"), (100.0 * F.when(odd, w).otherwise(h) / oh).alias("height"))
