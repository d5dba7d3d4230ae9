"""Special functions that Spark SQL lacks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function; absolute error below 2e-7."""
    # Abramowitz and Stegun 7.1.26.
    coefficients = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    series = F.lit(0.0)
    for c in reversed(coefficients):
        series = (series + c) * t
    upper = series * F.exp(-x * x) / 2
    return F.when(z > 0, 1 - upper).otherwise(upper)
