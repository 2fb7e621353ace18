"""Medians, outliers, distances and civil time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_median(a: Column) -> Column:
    """The middle of a sorted array, or the mean of the two middle ones."""
    n = F.size(a)
    low, high = F.get(a, F.floor((n - 1) / 2).cast("int")), F.get(a, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def without_outliers(a: Column, least: int = 5) -> Column:
    """A sorted array without values beyond 1.5 hinge ranges of its hinges.

    Hinges are the medians of the lower floor(n/2) and the upper values from
    ceil(n/2) on. Fewer than `least` values, or no range, keep all.
    """
    n = F.size(a)
    q1 = sorted_median(F.slice(a, F.lit(1), F.floor(n / 2).cast("int")))
    q3 = sorted_median(F.slice(a, (F.ceil(n / 2) + 1).cast("int"), F.floor(n / 2).cast("int")))
    # an array of one, so that hinges are worked out once and not for every value
    once = F.array(F.struct(a.alias("a"), q1.alias("q1"), q3.alias("q3")))
    inside = lambda s: F.filter(s["a"], lambda x: (x >= s["q1"] - 1.5 * (s["q3"] - s["q1"])) & (x <= s["q3"] + 1.5 * (s["q3"] - s["q1"])))
    kept = F.transform(once, lambda s: F.when((F.size(s["a"]) < least) | (s["q3"] - s["q1"] <= 0), s["a"]).otherwise(inside(s)))
    return F.get(kept, F.lit(0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    q = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * 6371 * F.atan2(F.sqrt(q), F.sqrt(1 - q))


def days_between(a: Column, b: Column) -> Column:
    """Days from a to b, to the microsecond."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(86400e6)


def next_slot(at: Column, zone: str, hours: list[int], forward: bool = True) -> Column:
    """The next (or last) full hour after `at` that is one of `hours` in the zone's civil time; clock changes included."""
    whole = F.date_trunc("hour", at.cast("timestamp"))
    steps = F.sequence(F.lit(1 if forward else 0), F.lit(60 if forward else 59))
    sign = 1 if forward else -1
    slots = F.transform(steps, lambda h: F.timestamp_micros(F.unix_micros(whole) + sign * h * F.lit(3_600_000_000)))
    good = F.filter(slots, lambda t: F.hour(F.from_utc_timestamp(t, zone)).isin(*hours))
    return F.get(good, F.lit(0))


def monday_to_saturday(day: Column) -> tuple[Column, Column]:
    monday = F.date_trunc("week", day).cast("date")
    return monday, F.date_add(monday, 5)


def flyer_range(label: Column, year: Column) -> tuple[Column, Column]:
    """First and last day of a label such as "12.08. - 17.08."; years of four digits count, else `year`.

    A last day before the first that names no year is next year's.
    """
    pattern = r"(\d{1,2})\.(\d{1,2})\.?(\d{4})?\s*(?:-|–|bis)\s*(\d{1,2})\.(\d{1,2})\.(\d{4})?"
    part = [F.regexp_extract(label, pattern, i).try_cast("int") for i in range(1, 7)]
    own = F.coalesce(part[5], part[2], year)
    first = F.try_to_date(F.concat_ws("-", F.coalesce(part[2], own), part[1], part[0]), "y-M-d")
    last = F.try_to_date(F.concat_ws("-", own, part[4], part[3]), "y-M-d")
    return first, F.when((last < first) & part[5].isNull(), F.add_months(last, 12)).otherwise(last)
