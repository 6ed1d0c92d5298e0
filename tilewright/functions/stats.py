"""Agreement and robust-size statistics as column expressions; a value that cannot be stated is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def both(x: Column, y: Column, value: Column) -> Column:
    """value where neither of a pair is missing."""
    return F.when(x.isNotNull() & y.isNotNull(), value)


def concordance(x: Column, y: Column, least: int = 5, textbook: bool = False) -> Column:
    """Lin's concordance of the complete pairs; NULL under `least` pairs.

    The evaluation's own form sets a sample covariance against population variances, so a column agrees with itself by
    n / (n - 1); textbook=True uses population moments throughout.
    """
    a, b = both(x, y, x), both(x, y, y)
    cov = F.covar_pop(a, b) if textbook else F.covar_samp(a, b)
    below = F.var_pop(a) + F.var_pop(b) + F.pow(F.avg(a) - F.avg(b), 2)
    return F.when((F.count(a) >= least) & (below > 0), 2 * cov / below)


def pearson(x: Column, y: Column, zero: bool = False) -> Column:
    """Correlation of the complete pairs; a column without spread gives NULL, or 0 where the caller counts it so."""
    a, b = both(x, y, x), both(x, y, y)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.coalesce(r, F.lit(0.0)) if zero else r


def relative_bias(x: Column, y: Column, floor: float = 1e-9) -> Column:
    """Mean difference of y from x, as a part of the mean of x."""
    return F.avg(both(x, y, y - x)) / F.greatest(F.abs(F.avg(both(x, y, x))), F.lit(floor))


def size_ratio(x: Column, least: int = 10, floor: float = 1e-6) -> Column:
    """90th over 10th percentile; NULL under `least` values."""
    return F.when(F.count(x) >= least, F.percentile(x, 0.9) / F.greatest(F.percentile(x, 0.1), F.lit(floor)))


def variation(x: Column, floor: float = 1e-9) -> Column:
    return F.stddev_pop(x) / F.greatest(F.avg(x), F.lit(floor))


def kappa(a: Column, b: Column) -> Column:
    """Cohen's kappa of two boolean columns; NULL without rows or where chance alone agrees fully."""
    n = F.count(a & b).cast("double")
    yy, yn, ny = (F.count_if(e).cast("double") for e in (a & b, a & ~b, ~a & b))
    nn = n - yy - yn - ny
    po, pe = (yy + nn) / n, ((yy + yn) * (yy + ny) + (nn + yn) * (nn + ny)) / (n * n)
    return F.when((n > 0) & (pe < 1), (po - pe) / (1 - pe))


def z_score(x: Column, window, eps: float = 1e-9) -> Column:
    return (x - F.avg(x).over(window)) / (F.stddev_pop(x).over(window) + eps)


def share(part: Column, whole: Column) -> Column:
    """count of part among count of whole; NULL where there is no whole."""
    return F.try_divide(F.count_if(part).cast("double"), F.count_if(whole).cast("double"))


def axis_fit(x: Column, y: Column) -> tuple[Column, Column]:
    """Scale and offset of y over x from any number of anchors: none is the identity, one an offset, more a line."""
    n = F.count(both(x, y, x))
    slope = F.when(n < 2, F.lit(1.0)).otherwise(F.regr_slope(y, x))
    offset = F.when(n == 0, F.lit(0.0)).when(n == 1, F.avg(both(x, y, y - x))).otherwise(F.regr_intercept(y, x))
    return slope, offset
