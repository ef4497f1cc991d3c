"""Boxes on a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scale(value: Column, size: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1000.0), value / size * 1000)), 2)


def normalize_box(box: Column, width: Column, height: Column) -> Column:
    """Box on a page of the given size, scaled to 0..1000."""
    return F.array(
        _scale(F.get(box, F.lit(0)), width),
        _scale(F.get(box, F.lit(1)), height),
        _scale(F.get(box, F.lit(2)), width),
        _scale(F.get(box, F.lit(3)), height),
    )


def round_box(box: Column) -> Column:
    return F.transform(box, lambda v: F.bround(v, 2))
