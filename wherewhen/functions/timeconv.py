"""Epochs: centuries and nanoseconds from 2000-01-01T12:00 of a row's own time scale, and instants in TAI.

The pair (centuries, nanoseconds) orders like time. total_ns() is a BIGINT, which holds 2.9 centuries either
way; wide_ns() is exact everywhere as a decimal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wherewhen.functions.vocab import TIME_SCALES, _pick

# Fixed values.
CENTURY_NS = 36525 * 86400 * 1_000_000_000
J2000_UNIX_US = 946_728_000_000_000
J1900_TO_J2000_S = 3_155_716_800
#: What to add to a scale's nanoseconds since its own J2000 for TAI's, where that is constant.
TAI_OFFSET_NS = {"TAI": 0, "TT": -32_184_000_000, "UTC": 32_000_000_000, "GPST": 19_000_000_000, "GST": 19_000_000_000, "BDT": 33_000_000_000, "QZSST": 19_000_000_000, "ET": -32_184_000_000, "TDB": -32_184_000_000}


def total_ns(centuries: Column, ns: Column) -> Column:
    return centuries.cast("bigint") * F.lit(CENTURY_NS) + ns


def wide_ns(centuries: Column, ns: Column) -> Column:
    return centuries.cast("decimal(38,0)") * F.lit(CENTURY_NS).cast("decimal(20,0)") + ns.cast("decimal(20,0)")


def parts(total: Column) -> tuple[Column, Column]:
    """(centuries, nanoseconds) with 0 <= nanoseconds < a century."""
    ns = F.pmod(total, F.lit(CENTURY_NS))
    return ((total - ns) / F.lit(CENTURY_NS)).cast("smallint"), ns


def epoch_key(centuries: Column, ns: Column) -> Column:
    """A struct that orders like time."""
    return F.struct(centuries.alias("c"), ns.alias("ns"))


def offset_ns(scale: Column) -> Column:
    """Nanoseconds to add for TAI; null for scales without a constant offset (TCG, TCB, TL, TCL). ET and TDB leave their periodic terms of under 2 ms out."""
    return _pick(scale, [TAI_OFFSET_NS.get(s) for s in TIME_SCALES]).cast("bigint")


def to_tai(total: Column, scale: Column) -> Column:
    return total + offset_ns(scale)


def _micros(ns: Column) -> Column:
    """Whole microseconds, rounded down; in decimals, as doubles don't hold nanoseconds."""
    return F.floor(ns.cast("decimal(20,0)") / F.lit(1000).cast("decimal(5,0)")).cast("bigint")


def tai_ns_of(utc: Column) -> Column:
    """TAI nanoseconds since J2000 of a UTC timestamp, by the constant offset."""
    return (F.unix_micros(utc) - F.lit(J2000_UNIX_US)) * F.lit(1000) + F.lit(TAI_OFFSET_NS["UTC"])


def utc_of(tai_ns: Column) -> Column:
    return F.timestamp_micros(_micros(tai_ns - F.lit(TAI_OFFSET_NS["UTC"])) + F.lit(J2000_UNIX_US))


def ticket_seconds(tai_ns: Column) -> Column:
    """TAI seconds since 1900, as tickets have them."""
    return tai_ns / F.lit(1e9) + F.lit(float(J1900_TO_J2000_S))


def format_tai(tai_ns: Column) -> Column:
    """Calendar text of the TAI clock to milliseconds."""
    return F.date_format(F.timestamp_micros(_micros(tai_ns) + F.lit(J2000_UNIX_US)), "yyyy-MM-dd'T'HH:mm:ss.SSS")
