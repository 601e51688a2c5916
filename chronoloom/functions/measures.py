"""Column functions over measurements, and small scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_intensity(total: Column, area: Column, compat: bool = False) -> Column:
    """PF-12: null for no area; compat: inf or NaN, as a division of doubles gives."""
    total, area = total.cast("double"), area.cast("double")
    if not compat:
        return F.try_divide(total, area)
    none = F.when(total > 0, F.lit(float("inf"))).when(total < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(area == 0, none).otherwise(F.try_divide(total, area))


def death_time_measures(denoised: Column, cropped: Column, uncropped: Column) -> list[Column]:
    """PF-13: v1 is the denoised score, v2_cropped the middle element of the cropped array, v2_uncropped as it is."""
    return [denoised.alias("v1"), F.element_at(cropped, 2).alias("v2_cropped"), uncropped.alias("v2_uncropped")]


def rescaled(values: list[Column], factor: Column) -> list[Column]:
    """PF-14: baseline intensities times a factor."""
    return [v * factor for v in values]


def elementwise(a: Column, b: Column, op: str) -> Column:
    """PF-15: +, - of two arrays by element; shorter arrays give nulls."""
    return F.zip_with(a, b, (lambda x, y: x + y) if op == "+" else (lambda x, y: x - y))


def elementwise_scalar(a: Column, op: str, n: int = 1) -> Column:
    """PF-15: / int, square, sqrt, zero of an array by element."""
    return F.transform(a, {"/": lambda x: x / n, "square": lambda x: x * x, "sqrt": F.sqrt, "zero": lambda x: x * 0}[op])
