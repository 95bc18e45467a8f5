"""Sound levels and spreads as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SILENCE_DB = -120.0


def rms(samples: Column) -> Column:
    """Root mean square of an array of samples; 0 for none."""
    square = F.aggregate(F.transform(samples, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(samples) > 0, F.sqrt(square / F.size(samples))).otherwise(0.0)


def decibels(level: Column) -> Column:
    """Of a linear level; -120 for null or silence."""
    return F.when(level > 0, F.greatest(20 * F.log10(level + 1e-12), F.lit(SILENCE_DB))).otherwise(SILENCE_DB)


def spread(db: Column) -> Column:
    """90th less 10th percentile, with linear interpolation."""
    p = F.percentile(db, F.array(F.lit(0.1), F.lit(0.9)))
    return p[1] - p[0]


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def rounded(value: Column, digits: int) -> Column:
    """value * 10^digits rounded half up, over 10^digits, as DuckDB does; Spark's round goes by the decimal text and makes 0.29 of 0.285, which is a bit less than that."""
    return F.round(value * 10.0**digits) / 10.0**digits


def effective_bits(levels: Column) -> Column:
    """log2 of the number of distinct sample values."""
    return F.log2(F.greatest(F.count_distinct(levels), F.lit(1)).cast("double"))


def bimodality(energy: Column, median: Column) -> Column:
    """Distance of the means above and below the median, in deviations."""
    above, below = F.avg(F.when(energy > median, energy)), F.avg(F.when(energy <= median, energy))
    return F.coalesce(F.abs(above - below) / F.nullif(F.stddev_pop(energy), F.lit(0.0)), F.lit(0.0))
