"""Operations on one trace's samples as array expressions: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: what a lambda refers to is otherwise evaluated again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def max_abs(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v)))


def argmax_abs(x: Column) -> Column:
    """The index, from 0, of the first sample of largest magnitude."""
    return let(F.transform(x, lambda v: F.abs(v)), lambda a: F.array_position(a, F.array_max(a)).cast("int") - 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def demean(x: Column) -> Column:
    return let(mean(x), lambda m: F.transform(x, lambda v: v - m))


def demean_before(x: Column, split: Column) -> Column:
    """Less the mean of the samples up to index split; unchanged where there are none."""
    head = F.slice(x, 1, F.greatest(split + 1, F.lit(0)))
    return let(F.when(F.size(head) > 0, mean(head)).otherwise(0.0), lambda m: F.transform(x, lambda v: v - m))


def detrend_linear(x: Column) -> Column:
    """Less the least-squares line over the sample index."""
    n = F.size(x).cast("double")
    mid = (n - 1) / 2
    spread = n * (n * n - 1) / 12

    def line(m: Column) -> Column:
        slope = F.when(n > 1, total(F.transform(x, lambda v, i: (i - mid) * (v - m))) / spread).otherwise(0.0)
        return let(slope, lambda s: F.transform(x, lambda v, i: v - m - s * (i - mid)))

    return let(mean(x), line)


def detrend_simple(x: Column) -> Column:
    """Less the line through the first and last sample."""
    n = F.size(x)
    first, last = F.get(x, F.lit(0)), F.get(x, n - 1)
    return F.when(n > 1, F.transform(x, lambda v, i: v - first - (last - first) * i / (n - 1).cast("double"))).otherwise(x)


def taper_hann(x: Column, width: float = 0.05, side: str = "both") -> Column:
    """Each side's share of width is weighted by half a symmetric Hann window that starts at 0."""
    n, k = F.size(x), F.floor(F.size(x) * F.lit(width)).cast("int")
    w = lambda d: F.when(d < k, 0.5 * (1 - F.cos(F.lit(3.141592653589793) * d / k))).otherwise(1.0)
    left, right = side in ("both", "left"), side in ("both", "right")
    return F.transform(x, lambda v, i: v * (w(i) if left else F.lit(1.0)) * (w(n - 1 - i) if right else F.lit(1.0)))


def trapezoid(x: Column, dt: float) -> Column:
    """The integral over the whole trace, in one pass."""
    n = F.size(x)
    return F.when(n > 1, dt * (total(x) - 0.5 * (F.get(x, F.lit(0)) + F.get(x, n - 1)))).otherwise(0.0)


def zero_crossings(x: Column) -> Column:
    """Neighbouring samples of strictly opposite sign."""
    return F.size(F.filter(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x)), lambda a, b: a * b), lambda p: p < 0))


def differences(x: Column) -> Column:
    return F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x)), lambda a, b: b - a)


def gradient(x: Column, dt: float) -> Column:
    """Central differences, one-sided at the ends."""
    n = F.size(x)
    at = lambda i: F.get(x, i)
    return F.when(n < 2, F.transform(x, lambda v: F.lit(0.0))).otherwise(F.transform(x, lambda v, i: F.when(i == 0, (at(i + 1) - v) / dt).when(i == n - 1, (v - at(i - 1)) / dt).otherwise((at(i + 1) - at(i - 1)) / (2 * dt))))


def zero_pad(x: Column, n: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(0.0), n), x, F.array_repeat(F.lit(0.0), n))


def strip_pad(x: Column, n: Column) -> Column:
    return F.slice(x, n + 1, F.size(x) - 2 * n)


def decibels(signal: Column, noise: Column) -> Column:
    """10 log10 of the ratio of mean squares; null where the noise is silent or empty."""
    power = lambda y: total(F.transform(y, lambda v: v * v)) / F.nullif(F.size(y), F.lit(0))
    ratio = F.try_divide(power(signal), power(noise))
    return F.when(ratio > 0, 10 * F.log10(ratio))
