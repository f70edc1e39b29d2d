"""Scalar expressions: calendar months, exact rounding, record text. Built-in functions only."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channel names that the contract permits.
CHANNEL = r"^[0-9A-Za-z_-]{1,20}(/[0-9A-Za-z_-]{1,20}){0,4}$"
#: First and last second of 2027, UTC.
YEAR_START, YEAR_END = 1798761600, 1830297599


def month_index(ts: Column) -> Column:
    """Months since year 0 of a Unix time in UTC: year * 12 + month - 1. Any year, any session time zone."""
    day = F.date_from_unix_date(((ts - F.pmod(ts, F.lit(86400).cast("bigint"))) / 86400).cast("int"))
    return F.year(day) * 12 + F.month(day) - 1


def format_month(index: Column) -> Column:
    """YYYY-MM of a month index."""
    year, month = F.floor(index / 12).cast("string"), F.pmod(index, F.lit(12)) + 1
    return F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def _small_hundredths(avg: Column) -> Column:
    """The hundredths of 0 <= avg < 1/16, rounded: how many of 0.005, 0.015 and so on are below the double.

    No double is such a threshold, and the one nearest to it is above or below, which is settled here."""
    reached = []
    for k in range(7):
        exact = Fraction(2 * k + 1, 200)
        near = float(exact)
        reached.append((avg >= near if Fraction(near) > exact else avg > near).cast("bigint"))
    return reduce(Column.__add__, reached)


def avg_printf2(total: Column, count: Column) -> Column:
    """total / count as a double, then as text with two decimals, exactly as C's printf("%.2f"); for every
    double of a magnitude below 2^63.

    That rounds the double's own binary value half to even, which no rounding function here does. The
    fraction of a double of 1 or more is a whole number of 2^-52, so it is rounded in integers. From 1/16
    to 1 the unit is 2^-56; below, the double is compared with the few thresholds there are. The sign
    stands before the rounded magnitude, as in C (-0.00).
    """
    signed = total / count
    avg = F.abs(signed)
    whole = F.floor(avg).cast("bigint")
    small = whole == 0
    unit = F.when(small, F.lit(1 << 56)).otherwise(F.lit(1 << 52)).cast("bigint")
    part = ((avg - whole) * unit.cast("double")).cast("bigint") * 100
    q = F.when(small, F.shiftright(part, 56)).otherwise(F.shiftright(part, 52))
    r = part - q * unit
    up = (r * 2 > unit) | ((r * 2 == unit) & (q % 2 == 1))
    hundredths = F.when(avg < 0.0625, _small_hundredths(avg)).otherwise(q + F.when(up, 1).otherwise(0))
    carry = hundredths == 100
    text = F.concat((whole + F.when(carry, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad(F.when(carry, 0).otherwise(hundredths).cast("string"), 2, "0"))
    return F.when(signed < 0, F.concat(F.lit("-"), text)).otherwise(text)


def format_record(channel: Column, month: Column, low: Column, avg: Column, high: Column, count: Column, stamps: Column) -> Column:
    """channel,YYYY-MM=min/avg/max/count/stamps"""
    text = lambda c: c.cast("string")
    return F.concat(channel, F.lit(","), month, F.lit("="), text(low), F.lit("/"), avg, F.lit("/"), text(high), F.lit("/"), text(count), F.lit("/"), text(stamps))


def utc_to_jst(text: Column) -> Column:
    """ISO-8601 UTC time as M/DD HH:MM of Japan; a text that isn't one stays as it is."""
    ts = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d"), F.substring(text, 1, 19)), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    local = ts.cast("timestamp_ntz") + F.expr("interval 9 hours")
    return F.coalesce(F.date_format(local, "M/dd HH:mm"), text)


def segment_count(channel: Column) -> Column:
    """Parts between slashes."""
    return F.size(F.split(channel, "/"))


def parent_prefixes(channel: Column) -> Column:
    """a and a/b of a/b/c; empty for a name of one part."""
    parts = F.split(channel, "/")
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: n < F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
