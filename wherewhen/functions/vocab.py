"""Closed vocabularies stored as small codes (1..n, 0 is reserved), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code order, exact ratios to a kilometre, offsets of a scale's own J2000 from TAI's.
LENGTH_UNITS = ("km", "m", "cm", "mm", "au", "in", "ft", "mi", "nmi")
KM_RATIOS = ((1.0, 1.0), (1.0, 1_000.0), (1.0, 100_000.0), (1.0, 1_000_000.0), (149_597_870_700.0, 1_000.0), (254.0, 10_000_000.0), (3_048.0, 10_000_000.0), (1_609_344.0, 1_000_000.0), (1_852.0, 1_000.0))
TIME_SCALES = ("TAI", "TT", "ET", "TDB", "UTC", "GPST", "GST", "BDT", "QZSST", "TCG", "TCB", "TL", "TCL")
ESTIMATES = ("MEASURED", "ESTIMATED", "SIMULATED")
ESTIMATE_RANKS = (0, 1, 2)


def _pick(code: Column, values) -> Column:
    out = None
    for i, v in enumerate(values, 1):
        out = F.when(code == i, F.lit(v)) if out is None else out.when(code == i, F.lit(v))
    return out


def decode(code: Column, words=LENGTH_UNITS) -> Column:
    """The word of a code; null for 0, unknown codes and null."""
    return _pick(code, words)


def encode(word: Column, words=LENGTH_UNITS) -> Column:
    """The code of a word; null for unknown words."""
    out = None
    for i, w in enumerate(words, 1):
        out = F.when(word == w, F.lit(i)) if out is None else out.when(word == w, F.lit(i))
    return out.cast("smallint")


def is_code(code: Column, words) -> Column:
    """Whether a code is valid; null isn't."""
    return F.coalesce(code.between(1, len(words)), F.lit(False))


def to_km(value: Column, unit: Column) -> Column:
    return value * _pick(unit, [n for n, _ in KM_RATIOS]) / _pick(unit, [d for _, d in KM_RATIOS])


def from_km(value: Column, unit: Column) -> Column:
    return value * _pick(unit, [d for _, d in KM_RATIOS]) / _pick(unit, [n for n, _ in KM_RATIOS])


def convert(value: Column, unit: Column, to: Column) -> Column:
    """value in another unit; untouched where both are the same."""
    return F.when(unit == to, value).otherwise(from_km(to_km(value, unit), to))


def estimate_rank(code: Column) -> Column:
    """0 is preferred."""
    return _pick(code, ESTIMATE_RANKS)
