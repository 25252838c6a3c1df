"""Numeric expressions."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def smooth_idf(n: Column, df: Column) -> Column:
    """ln((1 + n) / (1 + df)) + 1."""
    return F.log((1 + n) / (1 + df)) + 1


def normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    """The normal density, null where the deviation is 0."""
    return F.when(sd > 0, F.exp(-F.pow(x - mean, 2) / (2 * sd * sd)) / (sd * sqrt(2 * pi)))


def cosine(dot: Column, a: Column, b: Column) -> Column:
    """From the inner product and both lengths; 0 if either is 0."""
    return F.coalesce(F.try_divide(dot, a * b), F.lit(0.0))
