"""Source, path and site formulas, geodesy and names as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published models.
BETA, DENSITY, PARTITION, HORIZONTAL, SURFACE = 3.7, 2.8, 0.55, 0.7071068, 2.0
CRUST_HZ = (0.001, 0.009, 0.025, 0.049, 0.081, 0.15, 0.37, 0.68, 1.11, 2.36, 5.25, 60.3)
CRUST_GAIN = (1.00, 1.01, 1.03, 1.06, 1.10, 1.19, 1.39, 1.58, 1.77, 2.24, 2.75, 4.49)
NOT_FREE = ("building", "bridge", "dam", "borehole", "hole", "crest", "toe", "foundation", "body", "roof", "floor")
GAL_TO_PCTG = 1 / 9.80665
EARTH_KM = 6371.0


def moment(magnitude: Column) -> Column:
    """Seismic moment in dyne-cm."""
    return F.pow(F.lit(10.0), 1.5 * magnitude + 16.05)


def magnitude(m0: Column) -> Column:
    return 2.0 / 3.0 * (F.log10(m0) - 16.05)


def brune_f0(m0: Column, stress_drop, beta: float = BETA) -> Column:
    return F.lit(4.906e6 * beta) * F.pow(F.lit(stress_drop) / m0, F.lit(1.0 / 3.0))


def brune_stress(m0: Column, f0: Column, beta: float = BETA) -> Column:
    return F.pow(f0 / (4.906e6 * beta), F.lit(3.0)) * m0


def brune(freq: Column, m0: Column, stress_drop=150.0, power: float = 2.0) -> Column:
    """Source spectrum; power 2, 1, 0 for acceleration, velocity, displacement."""
    c = PARTITION * HORIZONTAL * SURFACE / (4 * math.pi * DENSITY * BETA**3) * 1e-20
    return F.pow(2 * math.pi * freq, F.lit(power)) * (F.lit(c) * m0 / (1 + F.pow(freq / brune_f0(m0, stress_drop), F.lit(2.0))))


def spreading(dist: Column, cross: float = 40.0) -> Column:
    return F.when(dist <= cross, 1 / dist).otherwise(1 / F.sqrt(dist * cross))


def anelastic(freq: Column, dist: Column) -> Column:
    return F.exp(-math.pi * freq * dist / (180 * F.pow(freq, F.lit(0.45))) / 3.5)


def crust(freq: Column) -> Column:
    """Amplification, linear in frequency and logarithmic in gain between the tabulated points."""
    logs = [*map(math.log, CRUST_GAIN)]
    out = F.when(freq <= CRUST_HZ[0], F.lit(logs[0]))
    for a, b, p, q in zip(CRUST_HZ, CRUST_HZ[1:], logs, logs[1:]):
        out = out.when(freq <= b, p + (freq - a) * ((q - p) / (b - a)))
    return F.exp(out.otherwise(logs[-1]))


def site(freq: Column, kappa: float = 0.035) -> Column:
    return crust(freq) * F.exp(-math.pi * kappa * freq)


def shaking_seconds(mag: Column) -> Column:
    return 30 * mag - 30


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def back_azimuth(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north at point 1 towards point 2."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    a = F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d)))
    return F.when(a < 0, a + 360).otherwise(a)


def free_field(structure: Column) -> Column:
    return ~F.lower(structure).rlike("|".join(NOT_FREE))


def band_code(rate: Column) -> Column:
    """The first letter of a channel: B from 10 to below 80 samples a second, else H."""
    return F.when((rate >= 10) & (rate < 80), "B").otherwise("H")


def glob(pattern: str) -> str:
    """A case-insensitive regular expression that matches what the glob does."""
    import re

    return "(?i)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def finite_fault_km(mag: Column) -> Column:
    """The distance added for a finite fault of that magnitude."""
    small, large = mag - 5.744, mag - 7.744
    log = F.when(small < 0, 0.7497 + 0.43 * small).when(large < 0, 0.7497 + 0.43 * small - 0.04875 * small * small).otherwise(1.4147 + 0.235 * large)
    return F.pow(F.lit(10.0), log)


def spectral_id(kind: str, period: Column, damping: Column) -> Column:
    """The name of a spectral metric: SA(T=1.0000, D=5.000)."""
    return F.format_string(kind + "(T=%.4f, D=%.3f)", period, damping * 100)


def period_of(name: Column) -> Column:
    """The number of seconds that a spectral metric's name holds; null where it holds none."""
    return F.regexp_extract(name, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
