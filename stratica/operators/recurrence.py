"""Dates of repeating appointments as column expressions: a row's rule becomes an array, so nothing is shuffled.

Days count on the wall clock of the series' own zone.  A day that a month lacks falls on the month's last day.  ``COUNT``
counts before exceptions are taken out, ``UNTIL`` is an inclusive instant (UTC, with or without its ``Z``; a day alone is that day's
end, and for a series of whole days, which begins at midnight, that day itself), and the newest 4,000 dates are kept, which is the
feature's own bound on one series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratica.functions.text import bound_once

WEEKDAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
NEWEST = 4000
FREQUENCIES = ("DAILY", "WEEKLY", "MONTHLY", "YEARLY")
PARTS = ("freq", "interval", "places", "weekdays", "monthdays", "months", "setpos", "wkst", "until", "until_day", "count")
DAY = F.date_add


def parts(found: Column) -> dict[str, Column]:
    """The parts of a rule, from the map of its text."""
    numbers = lambda key: F.filter(F.transform(F.split(F.coalesce(found[key], F.lit("")), ","), lambda x: x.try_cast("int")), lambda n: n.isNotNull() & (n != 0))
    days = F.filter(F.split(F.coalesce(found["BYDAY"], F.lit("")), ","), lambda d: F.right(d, F.lit(2)).isin(*WEEKDAYS))
    index = lambda d: F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), F.right(d, F.lit(2))).cast("int") - 1
    place = lambda d: F.coalesce(F.regexp_extract(d, r"^([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    places, weekdays = F.transform(days, place), F.transform(days, index)
    freq, setpos = found["FREQ"], numbers("BYSETPOS")
    # the same ordinal on several weekdays means a position in their whole set
    legacy = freq.isin("MONTHLY", "YEARLY") & (F.size(days) > 1) & (F.size(F.array_distinct(places)) == 1) & (F.try_element_at(places, F.lit(1)) != 0) & (F.size(setpos) == 0)
    until = F.regexp_replace(found["UNTIL"], "Z$", "")
    return {
        "freq": freq,
        "interval": F.greatest(F.lit(1), F.coalesce(found["INTERVAL"].try_cast("int"), F.lit(1))),
        "places": F.when(legacy, F.transform(places, lambda _: F.lit(0))).otherwise(places),
        "weekdays": weekdays,
        "monthdays": numbers("BYMONTHDAY"),
        "months": F.filter(numbers("BYMONTH"), lambda m: m.between(1, 12)),
        "setpos": F.when(legacy, F.slice(places, 1, 1)).otherwise(setpos),
        "wkst": F.greatest(F.lit(0), F.coalesce(F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), found["WKST"]).cast("int") - 1, F.lit(0))),
        "until": F.coalesce(F.try_to_timestamp(until, F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(F.concat(until, F.lit("T235959")), F.lit("yyyyMMdd'T'HHmmss"))).cast("timestamp_ntz"),
        "until_day": F.try_to_timestamp(found["UNTIL"], F.lit("yyyyMMdd")).cast("date"),
        "count": found["COUNT"].try_cast("int"),
    }


def in_month(first: Column, p: dict[str, Column], default_day: Column) -> Column:
    """The rule's days in the month that starts on ``first``."""
    last = F.dayofmonth(F.last_day(first))
    by_number = F.filter(F.transform(p["monthdays"], lambda d: F.when(d > 0, F.least(d, last)).otherwise(last + 1 + d)), lambda d: d.between(1, last))
    every = F.sequence(F.lit(1), last)
    matching = lambda wd: F.filter(every, lambda d: F.weekday(DAY(first, d - 1)) == wd)
    picked = lambda place, wd: F.when(place == 0, matching(wd)).otherwise(F.array_compact(F.array(F.try_element_at(matching(wd), F.when(place == 0, F.lit(1)).otherwise(place)))))
    by_day = F.array_sort(F.array_distinct(F.flatten(F.zip_with(p["places"], p["weekdays"], picked))))
    positioned = F.when(F.size(p["setpos"]) > 0, F.array_compact(F.transform(p["setpos"], lambda n: F.try_element_at(by_day, n)))).otherwise(by_day)
    numbers = F.when(F.size(p["monthdays"]) > 0, by_number).when(F.size(p["weekdays"]) > 0, positioned).otherwise(F.array(F.least(default_day, last)))
    return F.transform(F.array_sort(F.array_distinct(numbers)), lambda d: DAY(first, d - 1))


def days(first: Column, p: dict[str, Column], horizon: Column) -> Column:
    """The rule's days from ``first`` to the horizon in order; ``first`` alone for a frequency that is unknown or missing."""
    step = p["interval"]
    # no step is made that UNTIL or, where every step has a day, COUNT takes away again
    last = F.least(horizon, F.coalesce(F.date_add(F.to_date(p["until"]), 1), horizon))  # a wall clock may be a day ahead of UTC
    upto = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), n).cast("int"))
    counted = lambda n: upto(F.when(p["count"] > 0, F.least(n, p["count"])).otherwise(n))
    daily = F.transform(counted(F.datediff(last, first) / step), lambda k: DAY(first, k * step))
    week = F.date_sub(first, F.pmod(F.weekday(first) - p["wkst"], F.lit(7)))
    wanted = F.when(F.size(p["weekdays"]) > 0, F.array_distinct(p["weekdays"])).otherwise(F.array(F.weekday(first)))
    shifts = F.array_sort(F.transform(wanted, lambda d: F.pmod(d - p["wkst"], F.lit(7)).cast("int")))
    weekly = bound_once(shifts, lambda own: F.flatten(F.transform(counted(F.datediff(last, week) / 7 / step), lambda k: F.transform(own, lambda s: DAY(week, k * 7 * step + s)))))
    month = F.trunc(first, "month")
    span = F.floor(F.months_between(last, month))
    # days that every month has: by a positive number, by no rule, or by weekdays of the first or last four
    sure = F.when(F.size(p["monthdays"]) > 0, F.array_max(p["monthdays"]) > 0).otherwise((F.size(p["setpos"]) == 0) & F.forall(p["places"], lambda n: F.abs(n) <= 4))
    monthly = F.flatten(F.transform(F.when(sure, counted(span / step)).otherwise(upto(span / step)), lambda k: in_month(F.add_months(month, k * step), p, F.dayofmonth(first))))
    months = F.when(F.size(p["months"]) > 0, F.array_sort(F.array_distinct(p["months"]))).otherwise(F.array(F.month(first)))
    year = F.trunc(first, "year")
    yearly = F.flatten(F.transform(upto(F.floor(F.months_between(last, year) / 12) / step), lambda k: F.flatten(F.transform(months, lambda m: in_month(F.add_months(year, k * step * 12 + m - 1), p, F.dayofmonth(first))))))
    chosen = F.when(p["freq"] == "DAILY", daily).when(p["freq"] == "WEEKLY", weekly).when(p["freq"] == "MONTHLY", monthly).when(p["freq"] == "YEARLY", yearly)
    return F.coalesce(F.filter(chosen, lambda d: (d >= first) & (d <= last)), F.array(first))


def instant(wall: Column, tz: Column | None) -> Column:
    """The UTC clock of a clock time in a zone (null: UTC)."""
    return wall if tz is None else F.to_utc_timestamp(wall.cast("timestamp"), F.coalesce(tz, F.lit("UTC"))).cast("timestamp_ntz")


def occurrences(start: Column, rule: Column, horizon: Column, exdates: Column | None = None, tz: Column | None = None) -> Column:
    """The clock times of a series in its zone in order, the newest ``NEWEST`` of them; its rule is read once for each row."""
    text = F.str_to_map(F.upper(F.regexp_replace(F.coalesce(rule, F.lit("")), r"\s", "")), F.lit(";"), F.lit("="))

    def walls(p: Column) -> Column:
        known = {k: p[k] for k in PARTS}
        first = F.to_date(start)
        clock = start - first.cast("timestamp_ntz")
        found = days(first, known, horizon)
        counted = F.when(known["count"] > 0, F.slice(found, F.lit(1), known["count"])).otherwise(found)
        times = F.transform(counted, lambda d: d.cast("timestamp_ntz") + clock)
        kept = F.filter(times, lambda w: known["until"].isNull() | F.when(known["until_day"].isNotNull() & (start == first.cast("timestamp_ntz")), F.to_date(w) <= known["until_day"]).otherwise(instant(w, tz) <= known["until"]) | ~known["freq"].isin(*FREQUENCIES))
        if exdates is not None:
            kept = F.array_except(kept, F.coalesce(exdates, F.array().cast("array<timestamp_ntz>")))
        return bound_once(kept, lambda all_: F.when(F.size(all_) > NEWEST, F.slice(all_, -NEWEST, NEWEST)).otherwise(all_))

    return bound_once(text, lambda m: bound_once(F.struct(*[v.alias(k) for k, v in parts(m).items()]), walls))


def expand(series: DataFrame, horizon: str, start: str = "start", rule: str = "rrule", tz: str = "tz", exdates: str | None = None) -> DataFrame:
    """One row per date: the series' columns, ``wall`` (its own clock) and ``at`` (an instant).

    ``start`` is a clock time without zone; a null start gives no rows, a missing rule or one of unknown frequency its first
    date alone; a null zone is UTC.  A clock time that a spring change skips moves on by the gap.
    """
    times = occurrences(F.col(start), F.col(rule), F.lit(horizon).cast("date"), F.col(exdates) if exdates else None, F.col(tz))
    # the outer form: for the other, a filter on the array's size is put in front, and the array is made twice
    rows = series.where(F.col(start).isNotNull()).withColumn("wall", F.explode_outer(times)).where("wall is not null")
    return rows.withColumn("at", F.to_utc_timestamp(F.col("wall").cast("timestamp"), F.coalesce(F.col(tz), F.lit("UTC"))))


def with_exceptions(dates: DataFrame, exceptions: DataFrame, first: str | None = None, last: str | None = None, uid: str = "uid") -> DataFrame:
    """Dates whose slot (``wall``) an exception replaces get the exception's time; a null ``moved`` takes the date away.

    An exception whose slot is no date here counts by its own time, if that lies within ``first`` and ``last``.
    """
    known = exceptions.select(uid, F.col("slot").alias("wall"), F.col("moved").alias("_moved"), F.lit(True).alias("_hit")).dropDuplicates([uid, "wall"])
    own = dates.select(uid, "wall", F.lit(True).alias("_date")).distinct()
    joined = own.join(known, [uid, "wall"], "full_outer")
    inside = F.lit(True)
    if first is not None:
        inside = inside & (F.col("_moved") >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        inside = inside & (F.col("_moved") <= F.lit(last).cast("timestamp_ntz"))
    kept = joined.where((F.col("_date") & (F.col("_hit").isNull() | F.col("_moved").isNotNull())) | (F.col("_date").isNull() & F.col("_moved").isNotNull() & inside))
    return kept.select(uid, F.coalesce("_moved", "wall").alias("wall"))
