"""Scalar rules over pixels, tiles, colours and kernels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def magnitude(dx: Column, dy: Column) -> Column:
    """MA-07."""
    return F.hypot(dx, dy)


def greater_times(a: Column, b: Column, d: Column, kind: str = "double") -> Column:
    """MA-08: max(a, b) * d in the component's own type (integers truncate)."""
    return (F.greatest(a, b) * d).cast(kind)


def scaled_movement(a: Column, b: Column, dx: Column, dy: Column) -> Column:
    """MA-09, in single precision."""
    return (F.greatest(a, b) * F.hypot(dx, dy)).cast("float")


def dynamic_stretch(v: Column) -> Column:
    """MA-11: 255 - v, clamped to 155..250 and stretched by whole numbers."""
    return F.floor(255 * (F.least(F.greatest(255 - v, F.lit(155)), F.lit(250)) - 155) / 95)


def edge_clamped(x: Column, width: Column) -> Column:
    """MA-12."""
    return F.least(F.greatest(x, F.lit(0)), width - 1)


def nearest_bar(width: Column, bars: list[float]) -> Column:
    """MA-13: index 0 to 2 of the nearest width. The best so far starts at ``width`` itself and only a smaller
    difference wins, so no bar near enough gives 0, and ties the lowest."""
    index, best = F.lit(0), width
    for i, bar in enumerate(bars):
        gap = F.abs(width - F.lit(bar))
        index, best = F.when(gap < best, F.lit(i)).otherwise(index), F.least(best, gap)
    return index


def detections_per_hour(interval_s: Column, samples: Column) -> Column:
    """MA-14."""
    return 1 / (interval_s / 3600 * samples)


def hex_channel(colour: Column, channel: int) -> Column:
    """MA-16: one byte of a six-digit colour; '' is black, another length fails; digits are read as far as they go."""
    part = F.regexp_extract(F.substring(colour, 2 * channel + 1, 2), "^[0-9A-Fa-f]*", 0)
    value = F.when(part == "", 0).otherwise(F.conv(part, 16, 10).cast("int"))
    return F.when(colour == "", 0).when(F.length(colour) == 6, value).otherwise(F.raise_error(F.lit("a colour has six digits")).cast("int"))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    """MA-16's inverse."""
    return F.lower(F.concat(*[F.lpad(F.hex(x), 2, "0") for x in (r, g, b)]))


def tile(x: Column, size: int = 256, border: int = 4) -> tuple[Column, Column]:
    """MA-17: tile number and place in the tile."""
    inner = size - 2 * border
    return F.floor(x / inner), x % inner


def image_kilobytes(width: Column, height: Column, components: Column, component_bytes: int) -> Column:
    """MA-18."""
    return F.floor(width * height * components * component_bytes / 1024)


def gaussian_kernel(n: int, sigma: float, compat: bool = False) -> list[float]:
    """MA-19, one dimension; compat divides by 2 sigma, not 2 sigma squared."""
    below = 2 * sigma if compat else 2 * sigma * sigma
    return [math.exp(-i * i / below) for i in range(-n, n + 1)]


def gaussian_kernel_2d(n: int, sigma: float) -> list[list[float]]:
    """MA-19, two dimensions, sums to 1."""
    raw = [[math.exp(-(i * i + j * j) / (2 * sigma * sigma)) for j in range(-n, n + 1)] for i in range(-n, n + 1)]
    total = sum(map(sum, raw))
    return [[x / total for x in row] for row in raw]


def noise_density(x: Column, alpha: float = 0.95, sigma: float = 0.05, beta: float = 0.5) -> Column:
    """MA-21: mixture of two components."""
    part = lambda s: F.exp(-x / (2 * s * s)) / (2 * math.pi * s)
    return alpha * part(sigma) + (1 - alpha) * part(beta)


def included(x: Column, y: Column, width: int, height: int, border: int, mask: Column) -> Column:
    """PF-20: pixels of the mask that aren't in the border."""
    return mask & x.between(border, width - 1 - border) & y.between(border, height - 1 - border)


def pyramid_levels(width: Column, least_width: int, ratio: float) -> Column:
    """MA-27: a ratio outside 0.4..0.98 counts as 0.75."""
    ratio = ratio if 0.4 <= ratio <= 0.98 else 0.75
    return F.floor(F.ln(F.lit(float(least_width)) / width) / math.log(ratio)).cast("int")


def wheel(sizes=(15, 6, 4, 11, 13, 6)) -> list[tuple[int, int, int]]:
    """MA-25: the colour wheel of the flow picture, red-yellow-green-cyan-blue-magenta, by linear ramps."""
    fixed, moving, out = [0, 1, 1, 2, 2, 0], [1, 0, 2, 1, 0, 2], []
    for k, n in enumerate(sizes):
        for i in range(n):
            colour = [0, 0, 0]
            ramp = 255 * i // n
            colour[fixed[k]], colour[moving[k]] = 255, ramp if k % 2 == 0 else 255 - ramp
            out.append(tuple(colour))
    return out


def flow_colour(u: Column, v: Column, channel: int, unknown: float = 1e9) -> Column:
    """MA-25: one channel of a flow vector's colour; unknown flow is black, a radius over 1 is darkened by 0.75."""
    colours = F.array(*[F.lit(c[channel] / 255) for c in wheel()])
    n = len(wheel())
    radius = F.hypot(u, v)
    # -0.0 lies at -pi; the built-in function takes it for 0.0
    angle = F.when((v == 0) & (u > 0), -math.pi).otherwise(F.atan2(-v, -u))
    at = (angle / math.pi + 1) / 2 * (n - 1)
    low = F.floor(at).cast("int")
    share = at - low
    value = (1 - share) * F.get(colours, low) + share * F.get(colours, (low + 1) % n)
    value = F.when(radius <= 1, 1 - radius * (1 - value)).otherwise(value * 0.75)
    return F.when((F.abs(u) > unknown) | (F.abs(v) > unknown), 0).otherwise(F.floor(255 * value)).cast("int")
