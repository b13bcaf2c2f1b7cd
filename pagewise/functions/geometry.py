"""Box arithmetic as Column expressions.

Two box conventions occur: ``[x, y, w, h]`` arrays for annotated pages and
``(x0, y0, x1, y1)`` columns for parsed layout.  Helpers are explicit about
which one they take.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a box is centred when its centre is within this share of the
# page width from the page centre (strict).
CENTRED_SHARE = 0.15


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def center_inside(ix, iy, iw, ih, ox, oy, ow, oh) -> Column:
    """Centre of the inner ``[x,y,w,h]`` box lies in the outer box, both
    edges inclusive.  Any null coordinate gives false."""
    cx = _c(ix) + _c(iw) / 2.0
    cy = _c(iy) + _c(ih) / 2.0
    inside = (cx >= _c(ox)) & (cx <= _c(ox) + _c(ow)) & (cy >= _c(oy)) & (cy <= _c(oy) + _c(oh))
    return F.coalesce(inside, F.lit(False))


def is_centered(x, w, page_width) -> Column:
    """1 when ``|x + w/2 - W/2| < 0.15 W``."""
    cx = _c(x) + _c(w) / 2.0
    pw = _c(page_width)
    return F.when(F.abs(cx - pw / 2.0) < pw * CENTRED_SHARE, 1).otherwise(0).cast("int")


def ieee_divide(a, b) -> Column:
    """Floating division with IEEE results for a zero divisor (+-inf, NaN),
    as the feature definitions produce, instead of an ANSI error."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return (
        F.when(b != 0, a / b)
        .when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(a) | (a == 0), F.lit(float("nan")))
        .when(a > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
