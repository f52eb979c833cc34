"""Scalar expressions: casts that do not raise, safe arithmetic, calendars, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def text_or_null(c: Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def typed(c: Column, kind: str) -> Column:
    """Text as ``kind``; blank and malformed values become null."""
    return text_or_null(c).try_cast(kind)


def parsed_time(c: Column, pattern: str = "MM/dd/yyyy hh:mm:ss a") -> Column:
    return F.try_to_timestamp(text_or_null(c), F.lit(pattern)).cast("timestamp_ntz")


def clipped(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null, unlike with greatest and least alone."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def number_or_null(c: Column) -> Column:
    """NaN and infinities as null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def largest(*columns: Column) -> Column:
    """The largest value of a row, nulls and NaN skipped."""
    return F.greatest(*[number_or_null(c) for c in columns])


def cyclical(c: Column, period: float) -> tuple[Column, Column]:
    angle = c * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def day_numbers(ts: Column) -> dict[str, Column]:
    """Calendar columns of a local time."""
    monday = F.weekday(ts)
    return {"hour": F.hour(ts), "dow_mon0": monday, "dow_sun0": (monday + 1) % 7, "month": F.month(ts), "day_of_year": F.dayofyear(ts), "is_weekend": (monday >= 5).cast("int")}


def nth_weekday(year: Column, month: Column, day: str, n: int) -> Column:
    """The n-th MON ... SUN of a month; the last one for n = -1."""
    first = F.make_date(year, month, F.lit(1))
    if n > 0:
        return F.date_add(F.next_day(F.date_sub(first, 1), day), 7 * (n - 1))
    return F.next_day(F.date_sub(F.last_day(first), 7), day)


def is_federal_holiday(d: Column) -> Column:
    """United States federal holidays, and the weekday on which a fixed one is kept when it falls on a weekend."""
    y = F.year(d)
    fixed = [F.make_date(y, F.lit(m), F.lit(n)) for m, n in ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))]
    fixed.append(F.make_date(y + 1, F.lit(1), F.lit(1)))
    kept = [F.when(F.weekday(f) == 5, F.date_sub(f, 1)).when(F.weekday(f) == 6, F.date_add(f, 1)).otherwise(f) for f in fixed]
    moving = [nth_weekday(y, F.lit(m), day, n) for m, day, n in ((1, "MON", 3), (2, "MON", 3), (5, "MON", -1), (9, "MON", 1), (10, "MON", 2), (11, "THU", 4))]
    out = F.lit(False)
    for h in (*fixed[:-1], *kept, *moving):
        out = out | (d == h)
    return out


def is_missing_hour(ts: Column) -> Column:
    """The local hour that daylight saving skips: 02:00 on the second Sunday of March."""
    return (F.hour(ts) == 2) & (F.to_date(ts) == nth_weekday(F.year(ts), F.lit(3), "SUN", 2))


def month_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 12 - d)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a local time, whatever the session's time zone."""
    t = ts.cast("timestamp_ntz")
    return F.unix_date(t.cast("date")) * F.lit(86_400_000_000) + F.hour(t) * F.lit(3_600_000_000) + F.minute(t).cast("long") * F.lit(60_000_000) + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0, by the series of positive terms; absolute error about 1e-15."""
    z = F.least(x, F.lit(6.0))
    term = F.struct(z.alias("t"), z.alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(150)), term, lambda a, k: F.struct((a["t"] * 2 * z * z / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * 2 * z * z / (2 * k + 1)).alias("s")))["s"]
    return F.greatest(F.lit(0.0), 1 - 2 / math.sqrt(math.pi) * F.exp(-z * z) * total)


def two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2))


def log_factorial(x: Column) -> Column:
    """ln(x!) of x >= 0 by Stirling's series, ten steps further up; relative error about 1e-15."""
    x = x.cast("double")
    y = x + 11
    product = x + 1
    for k in range(2, 11):
        product = product * (x + k)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7))) + 1 / (1188 * F.pow(y, F.lit(9)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def exact_mcnemar(b: Column, c: Column) -> Column:
    """Two-sided binomial p-value of discordant counts; 1 without any.

    The tail is summed from where its terms vanish, 40 standard deviations before its end, so at most 20 * sqrt(n) of them.
    """
    n, least = b + c, F.least(b, c)
    first = F.greatest(F.lit(0).cast("long"), least - F.ceil(20 * F.sqrt(n.cast("double"))).cast("long") - 1)
    log = F.when(first == 0, F.lit(0.0)).otherwise(log_factorial(n) - log_factorial(first) - log_factorial(n - first)) - n * math.log(2)
    start = F.struct(log.alias("l"), F.exp(log).alias("s"))

    def add(a, k):
        log = a["l"] + F.log((n - k + 1).cast("double") / k)
        return F.struct(log.alias("l"), (a["s"] + F.exp(log)).alias("s"))

    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(F.when(least > first, F.sequence(first + 1, least)).otherwise(F.array().cast("array<long>")), start, add)["s"]))


def uniform_hex(*parts: Column) -> Column:
    """The 13 hex digits of ``uniform``, in the same order as the numbers."""
    return F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that the parts fix."""
    return F.conv(uniform_hex(*parts), 16, 10).cast("double") / F.lit(float(1 << 52))
