"""Python-compatible rounding to one decimal.

Python's ``round(x, 1)`` rounds the *exact binary value* of ``x`` half to
even; Spark's ``round`` and ``bround`` start from the decimal string of the
double and so disagree on values such as 0.35 (binary 0.34999...).  For
``2**-5 <= |x| < 64`` every double is an integer multiple of ``2**-57``, so
``N = x * 2**57`` is exact and ``10 x = 10 N / 2**57`` can be split into an
exact quotient and remainder with integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = 2 ** 57
_HALF = 2 ** 56


def py_round1(col) -> Column:
    x = F.col(col) if isinstance(col, str) else col
    ax = F.abs(x)
    exact_range = (ax >= 2.0 ** -5) & (ax < 64.0)
    n = F.when(exact_range, ax * float(_SCALE)).cast("bigint")
    # 10 N = u * 2**57 + v * 2**54 + 10 b, with N = a * 2**54 + b; all terms
    # stay below 2**63, so the split is exact in 64-bit integers.
    a = F.shiftright(n, 54)
    b = n.bitwiseAND(F.lit((1 << 54) - 1))
    u = F.shiftright(a * 10, 3)
    v = (a * 10).bitwiseAND(F.lit(7))
    rem = v * F.lit(1 << 54) + b * 10
    q = u + F.shiftright(rem, 57)
    r = rem.bitwiseAND(F.lit(_SCALE - 1))
    up = (r > F.lit(_HALF)) | ((r == F.lit(_HALF)) & (q.bitwiseAND(F.lit(1)) == 1))
    rounded = (q + F.when(up, 1).otherwise(0)).cast("double") / 10.0
    signed = F.when(x < 0, -rounded).otherwise(rounded)
    return (
        F.when(x.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(x) | (ax == float("inf")), x)
        .when(ax < 2.0 ** -5, F.when(x < 0, F.lit(-0.0)).otherwise(F.lit(0.0)))
        .when(exact_range, signed)
        .otherwise(F.bround(x, 1))
    )
