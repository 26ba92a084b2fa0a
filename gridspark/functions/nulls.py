"""Missing-value rules.

Fields store missing as NULL, never NaN: ``avg``/``sum`` skip NULL while one NaN
poisons the whole aggregate, and NaN sorts above every number.
"""

import numpy as np
from pyspark.sql import Column, functions as F

# Fill markers that mean "missing" in incoming fields.
SENTINELS = (-99999.0, -9.969209968386869e36, -1e20, 1e20)


def finite(c) -> Column:
    """True where the value is present, not NaN and not infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(
        ~F.isnan(c) & (c != F.lit(float("inf"))) & (c != F.lit(float("-inf"))), F.lit(False)
    )


def clean_value(c, sentinels=SENTINELS) -> Column:
    """NaN, infinities and sentinels become NULL, sentinels rounded to single precision too."""
    c = F.col(c) if isinstance(c, str) else c
    marks = sorted({float(s) for s in sentinels} | {float(np.float32(s)) for s in sentinels})
    return F.when(finite(c) & ~c.isin(*marks), c)


def only_value(c) -> Column:
    """The one present value of a group, missing without any; two fail the job."""
    two = F.raise_error(F.lit("two values where one is expected")).cast("double")
    return F.when(F.count(c) <= 1, F.first(c, ignorenulls=True)).otherwise(two)


def strict_avg(c) -> Column:
    """Mean that is missing as soon as one input is missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def strict_sum(c) -> Column:
    """Sum that is missing as soon as one input is missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def sum0(c) -> Column:
    """Sum of present values; 0 when nothing is present."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c), F.lit(0.0))


def weighted_avg(v, w) -> Column:
    """sum(w*v)/sum(w) over rows whose value is present."""
    v = F.col(v) if isinstance(v, str) else v
    w = F.col(w) if isinstance(w, str) else w
    return F.try_divide(F.sum(w * v), F.sum(F.when(v.isNotNull(), w)))
