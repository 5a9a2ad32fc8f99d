"""Column expressions for colours and perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pixel counts from this saturation and brightness.
LEAST_SATURATION, LEAST_BRIGHTNESS = 0.35, 0.3


def hue_distance(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def saturation(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b)
    return F.when(top == 0, 0.0).otherwise((top - F.least(r, g, b)) / F.when(top != 0, top))


def hue(r: Column, g: Column, b: Column) -> Column:
    """Degrees, 0 for greys."""
    top, d = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    over = F.when(d != 0, d)
    raw = F.when(top == r, (g - b) / over).when(top == g, (b - r) / over + 2).otherwise((r - g) / over + 4)
    return F.coalesce(F.pmod(raw * 60, F.lit(360.0)), F.lit(0.0))


def coloured(r: Column, g: Column, b: Column) -> Column:
    return (saturation(r, g, b) >= LEAST_SATURATION) & (F.greatest(r, g, b) >= LEAST_BRIGHTNESS)


def gradient_hash(grid: Column, width: int, height: int) -> Column:
    """One bit for each pair of neighbours in a row, set where the left is less; at most 64, the first is highest."""
    steps = F.array(*(F.lit(y * width + x) for y in range(height) for x in range(width - 1)))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda h, k: F.shiftleft(h, 1).bitwiseOR((F.get(grid, k) < F.get(grid, k + 1)).cast("bigint")))


def wide_hash(grid: Column, width: int, height: int) -> Column:
    """The bits of gradient_hash for grids of more than 64 pairs, as an array of longs; the first is highest, and the last may have fewer bits."""
    steps = [(y * width + x) for y in range(height) for x in range(width - 1)]
    part = lambda own: F.aggregate(F.array(*map(F.lit, own)), F.lit(0).cast("bigint"), lambda h, k: F.shiftleft(h, 1).bitwiseOR((F.get(grid, k) < F.get(grid, k + 1)).cast("bigint")))
    return F.array(*(part(steps[a : a + 64]) for a in range(0, len(steps), 64)))


def wide_hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, hamming), F.lit(0), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
