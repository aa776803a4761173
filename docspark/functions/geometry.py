"""Boxes [x0, top, x1, bottom] as column expressions, and the gates that tables of a page must pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import col

#: Fixed values of the table gates: overlap that drops, least words and rows, page ratio and columns of the override.
DROP, MIN_WORDS, MIN_ROWS, OVERSIZE, OVERRIDE_COLUMNS = 0.5, 4, 2, 1.0, 6


def area(b: Column | str) -> Column:
    b = col(b)
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Column | str, b: Column | str) -> Column:
    """The common area of two boxes."""
    a, b = col(a), col(b)
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def overlap(own: Column | str, boxes: Column | str) -> Column:
    """The largest share of `own` that one of `boxes` covers; 0 for a box without area and for no boxes."""
    share = F.array_max(F.transform(col(boxes), lambda b: intersection(own, b) / area(own)))
    return F.when(area(own) > 0, F.greatest(F.lit(0.0), F.coalesce(share, F.lit(0.0)))).otherwise(0.0)


def x_overlap(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.least(a[2], b[2]) - F.greatest(a[0], b[0])


def table_gate(box: Column | str, rows: Column, columns: Column, words: Column, raster: Column | str, vector: Column | str) -> Column:
    """struct<accepted, fraction, family, partial_coverage>: whether a table is kept, and which figures it partly meets."""
    r, v = overlap(box, raster), overlap(box, vector)
    most = F.greatest(r, v)
    accepted = (most < DROP) & (words >= MIN_WORDS) & (rows >= MIN_ROWS)
    return _verdict(accepted, most, F.when(r >= v, "raster").otherwise("vector"), words < rows * columns)


def table_gate_override(box: Column | str, rows: Column, columns: Column, words: Column, raster: Column | str, vector: Column | str, page_area: Column) -> Column:
    """`table_gate`, which a wide table passes too if only a vector cluster larger than the page covers it."""
    plain = table_gate(box, rows, columns, words, raster, vector)
    large = F.filter(col(vector), lambda b: area(b) > OVERSIZE * page_area)
    local = F.filter(col(vector), lambda b: ~(area(b) > OVERSIZE * page_area))
    scope = (page_area > 0) & (overlap(box, large) >= DROP) & (overlap(box, raster) < DROP) & (overlap(box, local) < DROP)
    accepted = plain["accepted"] | (scope & (columns >= OVERRIDE_COLUMNS) & (words >= MIN_WORDS) & (rows >= MIN_ROWS))
    r, v = overlap(box, raster), overlap(box, vector)
    return _verdict(accepted, F.greatest(r, v), F.when(r >= v, "raster").otherwise("vector"), words < rows * columns)


def _verdict(accepted: Column, fraction: Column, family: Column, poor: Column) -> Column:
    meets = accepted & (fraction > 0)
    return F.struct(accepted.alias("accepted"), F.when(meets, fraction).alias("fraction"), F.when(meets, family).alias("family"), (accepted & poor).alias("partial_coverage"))


def valid_box(b: Column | str) -> Column:
    b = col(b)
    return F.coalesce((F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
