"""Rectangles and colours as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(w: Column, h: Column) -> Column:
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def distance(a: Column, b: Column) -> Column:
    """Between the edges of rectangles struct<x,y,w,h>; 0 where they overlap."""
    dx = F.greatest(F.lit(0.0), a["x"] - (b["x"] + b["w"]), b["x"] - (a["x"] + a["w"]))
    dy = F.greatest(F.lit(0.0), a["y"] - (b["y"] + b["h"]), b["y"] - (a["y"] + a["h"]))
    return F.sqrt(dx * dx + dy * dy)


def spacing(targets: Column) -> Column:
    """For each struct<x,y,w,h> of an array, the distance to the nearest other one; null if alone."""
    def nearest(x, i):
        others = F.filter(targets, lambda y, j: j != i)
        return F.bround(F.array_min(F.transform(others, lambda y: distance(x, y))), 1)
    return F.transform(targets, nearest)


def luminance(rgb: Column) -> Column:
    """Relative luminance of an array of three values from 0 to 255."""
    linear = F.transform(rgb, lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4))))
    return 0.2126 * linear[0] + 0.7152 * linear[1] + 0.0722 * linear[2]


def contrast(foreground: Column, background: Column) -> Column:
    """Contrast ratio of two colours, to two places."""
    a, b = luminance(foreground), luminance(background)
    return F.bround((F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05), 2)


def contrast_fails(ratio: Column, font_px: Column, bold: Column) -> Column:
    return ratio < F.when((font_px >= 18) | bold, 3.0).otherwise(4.5)


def overlay_hint(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.rlike("cookie|consent|gdpr"), "cookie_consent").when(t.rlike(r"age (verification|gate)|are you (over|of legal age)"), "age_gate").otherwise("none")


def is_overlay(position: Column, z_index: Column, coverage: Column) -> Column:
    return position.isin("fixed", "absolute") & (F.coalesce(z_index, F.lit(0)) >= 999) & (coverage >= 50)
