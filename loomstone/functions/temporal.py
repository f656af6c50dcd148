"""Dates, calendars, periods, working days and recurrences as columns.

A period is a struct(start, finish) of half-open bounds. Days of other calendars are reckoned by Julian day numbers with whole
arithmetic, so that they stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Julian day number of 1970-01-01.
EPOCH_JDN = 2_440_588


def jdn(d: Column) -> Column:
    """The Julian day number of a date."""
    return F.unix_date(d).cast("long") + EPOCH_JDN


def from_jdn(n: Column) -> Column:
    return F.date_from_unix_date((n - EPOCH_JDN).cast("int"))


def _div(a: Column, n: int) -> Column:
    """Floor division by a positive number."""
    return F.floor(a / n).cast("long") if n == 1 else ((a - F.pmod(a, F.lit(n).cast("long"))) / n).cast("long")


def _mod(a: Column, n: int) -> Column:
    return F.pmod(a, F.lit(n).cast("long"))


def _ymd(year: Column, month: Column, day: Column) -> Column:
    return F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), day.cast("int").alias("day"))


def julian(d: Column) -> Column:
    """struct(year, month, day) in the Julian calendar."""
    c = jdn(d) + 32_082
    y = _div(4 * c + 3, 1461)
    e = c - _div(1461 * y, 4)
    m = _div(5 * e + 2, 153)
    return _ymd(y - 4800 + _div(m, 10), m + 3 - 12 * _div(m, 10), e - _div(153 * m + 2, 5) + 1)


def julian_to_jdn(year: Column, month: Column, day: Column) -> Column:
    year, month, day = (c.cast("long") for c in (year, month, day))
    a = _div(14 - month, 12)
    y, m = year + 4800 - a, month + 12 * a - 3
    return day + _div(153 * m + 2, 5) + 365 * y + _div(y, 4) - 32_083


def _thirteen_months(d: Column, epoch: int) -> Column:
    """Calendars of twelve months of 30 days and a short one, with a leap day in years that leave 3 by four."""
    n = jdn(d) - epoch
    year = _div(4 * n + 1463, 1461)
    first = 365 * (year - 1) + _div(year, 4)
    day = n - first
    return _ymd(year, _div(day, 30) + 1, _mod(day, 30) + 1)


def coptic(d: Column) -> Column:
    return _thirteen_months(d, 1_825_030)


def ethiopian(d: Column) -> Column:
    return _thirteen_months(d, 1_724_221)


def islamic(d: Column) -> Column:
    """The tabular calendar: eleven leap years in thirty."""
    n = jdn(d) - 1_948_440
    year = _div(30 * n + 10_646, 10_631)
    start = 354 * (year - 1) + _div(3 + 11 * year, 30)
    day = n - start
    month = F.least(F.lit(12).cast("long"), _div(11 * day + 330, 325))
    return _ymd(year, month, day - _div(325 * month - 320, 11) + 1)


def indian(d: Column) -> Column:
    """The Indian national calendar: a year begins on 22 March, or on the 21st in leap years."""
    leap = lambda y: (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    begins = lambda y: F.make_date(y, F.lit(3), F.when(leap(y), F.lit(21)).otherwise(F.lit(22)))
    y = F.year(d) - F.when(d < begins(F.year(d)), 1).otherwise(0)
    # The first month has 30 days, or 31 in leap years; then five have 31 and six have 30.
    n = F.datediff(d, begins(y)).cast("long")
    rest = n - F.when(leap(y), 31).otherwise(30)
    month = F.when(rest < 0, F.lit(1).cast("long")).when(rest < 155, _div(rest, 31) + 2).otherwise(_div(rest - 155, 30) + 7)
    day = F.when(rest < 0, n).when(rest < 155, _mod(rest, 31)).otherwise(_mod(rest - 155, 30)) + 1
    return _ymd(y - 78, month, day)


def buddhist_year(d: Column) -> Column:
    return F.year(d) + 543


def minguo_year(d: Column) -> Column:
    return F.year(d) - 1911


def ordinal(d: Column) -> Column:
    """struct(year, day of the year)."""
    return F.struct(F.year(d).alias("year"), F.dayofyear(d).alias("day"))


def with_cutover(d: Column, first_gregorian: str) -> Column:
    """struct(year, month, day): Julian before the date of the reform, Gregorian from it on."""
    gregorian = _ymd(F.year(d), F.month(d), F.day(d))
    return F.when(d < F.lit(first_gregorian).cast("date"), julian(d)).otherwise(gregorian)


def papal(d: Column) -> Column:
    return with_cutover(d, "1582-10-15")


def british(d: Column) -> Column:
    return with_cutover(d, "1752-09-14")


# Parts of dates


def anniversary(d: Column) -> Column:
    return F.struct(F.month(d).alias("month"), F.day(d).alias("day"))


def anniversary_in(d: Column, year: Column, round_up: bool = False) -> Column:
    """The anniversary of ``d`` in ``year``; 29 February falls on the 28th in common years, or on 1 March."""
    last = F.day(F.last_day(F.make_date(year, F.month(d), F.lit(1))))
    missing = F.day(d) > last
    there = F.make_date(year, F.month(d), F.least(F.day(d), last))
    return F.when(missing, F.date_add(there, 1)).otherwise(there) if round_up else there


def week_year(d: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), d)


def iso_week_date(year: Column, week: Column, day: Column) -> Column:
    """The date of an ISO year, week and day (Monday 1)."""
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_add(fourth, ((week - 1) * 7 + day - 1 - F.weekday(fourth)).cast("int"))


def weekend(d: Column, days: Sequence[int] = (5, 6)) -> Column:
    """Whether the weekday (Monday 0) is among ``days``."""
    return F.weekday(d).isin(*days)


def count_weekday(start: Column, finish: Column, weekday: int) -> Column:
    """How many days of a weekday (Monday 0) are in [start, finish)."""
    upto = lambda d: F.floor((F.unix_date(d) + 3 - weekday + 6) / 7)
    return F.greatest(F.lit(0), upto(finish) - upto(start)).cast("long")


def add_months(d: Column, n: Column | int, policy: str = "clamp") -> Column:
    """Month arithmetic; a day that the month lacks is clamped to its end, overflows into the next, or raises."""
    n = F.lit(n) if isinstance(n, int) else n
    first = F.add_months(F.trunc(d, "MM"), n)
    lacking = F.day(d) > F.day(F.last_day(first))
    if policy == "clamp":
        return F.add_months(d, n)
    if policy == "overflow":
        return F.date_add(first, F.day(d) - 1)
    if policy == "raise":
        return F.when(lacking, F.raise_error(F.lit("no such day in the month"))).otherwise(F.date_add(first, F.day(d) - 1))
    raise ValueError("policy is clamp, overflow or raise")


# Working days


def add_working_days(d: Column, n: Column | int, holidays: Sequence[str] = (), weekend_days: Sequence[int] = (5, 6)) -> Column:
    """The day on which the ``n``-th working day after ``d`` falls; before it, for a negative ``n``.

    Looks at as many calendar days as ``n`` working days and all holidays can need.
    """
    n = F.lit(n) if isinstance(n, int) else n
    free = F.array(*[F.lit(h).cast("date") for h in holidays]) if holidays else F.array().cast("array<date>")
    reach = F.abs(n) * 7 / max(1, 7 - len(set(weekend_days))) + 2 * len(holidays) + 14
    step = F.when(n < 0, F.lit(-1)).otherwise(F.lit(1))
    ahead = F.transform(F.sequence(F.lit(1), reach.cast("int")), lambda k: F.date_add(d, k * step))
    working = F.filter(ahead, lambda x: ~F.weekday(x).isin(*weekend_days) & ~F.array_contains(free, x))
    return F.when(n == 0, d).otherwise(F.get(working, F.abs(n) - 1))


def working_days_between(start: Column, finish: Column, holidays: Sequence[str] = (), weekend_days: Sequence[int] = (5, 6)) -> Column:
    """How many working days are in [start, finish)."""
    rest = sum((count_weekday(start, finish, w) for w in weekend_days), F.lit(0))
    free = F.lit(0)
    for h in holidays:
        day = F.lit(h).cast("date")
        free = free + F.when((day >= start) & (day < finish) & ~F.weekday(day).isin(*weekend_days), 1).otherwise(0)
    return F.greatest(F.datediff(finish, start), F.lit(0)) - rest - free


# Periods


def period(start: Column, finish: Column) -> Column:
    return F.struct(start.alias("start"), finish.alias("finish"))


def contains(p: Column, point: Column) -> Column:
    return (point >= p["start"]) & (point < p["finish"])


def intersect(a: Column, b: Column) -> Column:
    """The overlap of two periods, or null where there is none."""
    start, finish = F.greatest(a["start"], b["start"]), F.least(a["finish"], b["finish"])
    return F.when(start < finish, period(start, finish))


def unite(a: Column, b: Column) -> Column:
    """One period where the two overlap, else both, as an array; periods that only touch do not overlap."""
    one = F.array(period(F.least(a["start"], b["start"]), F.greatest(a["finish"], b["finish"])))
    return F.when(intersect(a, b).isNotNull(), one).otherwise(F.array(a, b))


def points(start: Column, finish: Column, step: str) -> Column:
    """start, start + step .. below finish, as an array; ``step`` is an interval such as ``15 minutes``."""
    every = F.expr(f"interval {step}")
    return F.when(start < finish, F.filter(F.sequence(start, finish, every), lambda p: p < finish)).otherwise(F.slice(F.array(start), 1, 0))


def segments(start: Column, finish: Column, step: str, partial: bool = True) -> Column:
    """The period tiled into half-open segments; the last may be short, or is left out."""
    every = F.expr(f"interval {step}")
    tiled = F.transform(points(start, finish, step), lambda p: period(p, F.least(p + every, finish)))
    return tiled if partial else F.filter(tiled, lambda s: s["finish"] - s["start"] >= every)


# Recurrences


def recur(start: Column, every: int, unit: str, times: int) -> Column:
    """``times`` dates, each a step after the one before, so that a clamped month end drifts."""
    step = {
        "days": lambda d: F.date_add(d, every),
        "weeks": lambda d: F.date_add(d, 7 * every),
        "months": lambda d: F.add_months(d, every),
        "years": lambda d: F.add_months(d, 12 * every),
    }[unit]
    seen = F.array(start)
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(times - 1, 1))), seen, lambda s, _: F.concat(s, F.array(step(F.element_at(s, -1))))) if times > 1 else seen


def rule(
    start: Column,
    freq: str,
    until: Column,
    interval: int = 1,
    by_month: Sequence[int] = (),
    by_month_day: Sequence[int] = (),
    by_day: Sequence[int] = (),
    by_set_pos: Sequence[int] = (),
    count: int | None = None,
) -> Column:
    """Dates of a recurrence rule from ``start`` up to and with ``until``: DAILY, WEEKLY, MONTHLY or YEARLY.

    Without parts, dates keep the weekday, day or anniversary of the start, and those that a month lacks are
    skipped. ``by_day`` counts Monday as 0; a negative ``by_month_day`` counts from the month's end; ``by_set_pos``
    keeps only these of each month's dates (each year's, for YEARLY), from 1 or from -1 backwards.
    """
    days = F.sequence(start, until)
    month_no = lambda d: F.year(d) * 12 + F.month(d)
    week_no = lambda d: F.floor((F.unix_date(d) + 3) / 7)
    step = {
        "DAILY": lambda d: F.datediff(d, start),
        "WEEKLY": lambda d: week_no(d) - week_no(start),
        "MONTHLY": lambda d: month_no(d) - month_no(start),
        "YEARLY": lambda d: F.year(d) - F.year(start),
    }[freq]

    def good(d: Column) -> Column:
        ok = step(d) % interval == 0
        if by_month:
            ok = ok & F.month(d).isin(*by_month)
        if by_month_day:
            ok = ok & (F.day(d).isin(*by_month_day) | (F.day(d) - F.day(F.last_day(d)) - 1).isin(*by_month_day))
        if by_day:
            ok = ok & F.weekday(d).isin(*by_day)
        if not by_day and not by_month_day:
            if freq == "WEEKLY":
                ok = ok & (F.weekday(d) == F.weekday(start))
            elif freq in ("MONTHLY", "YEARLY"):
                ok = ok & (F.day(d) == F.day(start))
        if freq == "YEARLY" and not by_month:
            ok = ok & (F.month(d) == F.month(start))
        return ok

    found = F.when(start <= until, F.filter(days, good)).otherwise(F.array().cast("array<date>"))
    if by_set_pos:
        span_no = (lambda d: F.year(d)) if freq == "YEARLY" else month_no
        same = lambda d: F.filter(found, lambda x: span_no(x) == span_no(d))
        at = lambda d, n: d == F.try_element_at(same(d), F.lit(n))
        found = F.filter(found, lambda d: F.exists(F.array(*[F.coalesce(at(d, n), F.lit(False)) for n in by_set_pos]), lambda b: b))
    return found if count is None else F.slice(found, 1, count)


def recurrent(sets: Sequence[Column], extra: Sequence[str] = (), without: Sequence[str] = ()) -> Column:
    """The union of recurrences and single dates without some dates, sorted and distinct."""
    dates = lambda ds: F.array(*[F.lit(d).cast("date") for d in ds]) if ds else F.array().cast("array<date>")
    return F.array_sort(F.array_except(F.array_distinct(F.concat(*sets, dates(extra))), dates(without)))


# Spans


_SPAN = ("years", "months", "weeks", "days", "hours", "minutes", "seconds")


def span(**parts: int | Column) -> Column:
    """A span of independent components, which are never carried into one another."""
    return F.struct(*[(p if isinstance(p := parts.get(k, 0), Column) else F.lit(p)).cast("long").alias(k) for k in _SPAN])


def add_spans(a: Column, b: Column, sign: int = 1) -> Column:
    return F.struct(*[(a[k] + sign * b[k]).alias(k) for k in _SPAN])


def scale_span(a: Column, n: Column | int) -> Column:
    return F.struct(*[(a[k] * n).alias(k) for k in _SPAN])


def span_iso(a: Column) -> Column:
    """ISO 8601 text of a span; components of nought are left out."""
    part = lambda k, unit: F.when(a[k] != 0, F.concat(a[k].cast("string"), F.lit(unit))).otherwise(F.lit(""))
    day = F.concat(*[part(k, u) for k, u in zip(_SPAN[:4], "YMWD", strict=True)])
    time = F.concat(*[part(k, u) for k, u in zip(_SPAN[4:], "HMS", strict=True)])
    whole = F.concat(F.lit("P"), day, F.when(time != "", F.concat(F.lit("T"), time)).otherwise(F.lit("")))
    return F.when(whole == "P", F.lit("PT0S")).otherwise(whole)


def parse_span(s: Column) -> Column:
    """The span of ISO 8601 text, or null where it is none."""
    pattern = r"^P(?:(-?\d+)Y)?(?:(-?\d+)M)?(?:(-?\d+)W)?(?:(-?\d+)D)?(?:T(?:(-?\d+)H)?(?:(-?\d+)M)?(?:(-?\d+)S)?)?$"
    get = lambda i: F.coalesce(F.nullif(F.regexp_extract(s, pattern, i), F.lit("")).cast("long"), F.lit(0))
    return F.when(s.rlike(pattern) & (s != "P") & ~s.endswith("T"), F.struct(*[get(i + 1).cast("long").alias(k) for i, k in enumerate(_SPAN)]))


def difference(a: Column, b: Column) -> Column:
    """struct(days, hours, minutes, seconds) between two timestamps, the later first."""
    s = F.unix_seconds(a.cast("timestamp")) - F.unix_seconds(b.cast("timestamp"))
    whole = lambda x, n: (x / n).cast("long")
    return F.struct(
        whole(s, 86_400).alias("days"), whole(s % 86_400, 3_600).alias("hours"), whole(s % 3_600, 60).alias("minutes"), (s % 60).alias("seconds")
    )


# Zones and timelines


def to_instant(local: Column, zone: Column | str, policy: str = "forward") -> Column:
    """The instant of a local time; in a gap of the clocks it is moved ``forward``, ``backward`` (an hour) or refused (``reject``)."""
    there = F.to_utc_timestamp(local.cast("timestamp"), zone)
    in_gap = F.from_utc_timestamp(there, zone) != local.cast("timestamp")
    if policy == "forward":
        return there
    if policy == "backward":
        return F.when(in_gap, there - F.expr("interval 1 hour")).otherwise(there)
    if policy == "reject":
        return F.when(in_gap, F.raise_error(F.lit("no such local time"))).otherwise(there)
    raise ValueError("policy is forward, backward or reject")


# The days from whose start TAI - UTC grows by a second, from 10 s at 1972-01-01.
LEAP_DAYS = (
    "1972-07-01 1973-01-01 1974-01-01 1975-01-01 1976-01-01 1977-01-01 1978-01-01 1979-01-01 1980-01-01 1981-07-01 1982-07-01 1983-07-01 "
    "1985-07-01 1988-01-01 1990-01-01 1991-01-01 1992-07-01 1993-07-01 1994-07-01 1996-01-01 1997-07-01 1999-01-01 2006-01-01 2009-01-01 "
    "2012-07-01 2015-07-01 2017-01-01"
).split()


def tai_offset(d: Column) -> Column:
    """TAI - UTC in seconds at a date from 1972 on."""
    later = F.filter(F.array(*[F.lit(x).cast("date") for x in LEAP_DAYS]), lambda x: x <= d.cast("date"))
    return F.size(later) + 10


def to_tai(t: Column) -> Column:
    """An instant on the TAI timeline."""
    return F.timestamp_seconds(F.unix_seconds(t.cast("timestamp")) + tai_offset(t))


# Calendars with years of uneven length: the start of a year by arithmetic, then months by their lengths


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is reckoned once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _by_year_starts(day: Column, start: Callable[[Column], Column], guess: Column, months: Callable[[Column, Column], Column]) -> Column:
    """struct(year, month, day): the year of a day number from a guess that is at most one off, and the month from an
    array of lengths, given the year and its days."""

    def in_year(y: Column, first: Column, after: Column) -> Column:
        def place(lengths: Column) -> Column:
            zero = F.struct(F.lit(0).cast("long").alias("month"), (day - first).alias("rest"), F.lit(False).alias("found"))

            def step(s: Column, n: Column) -> Column:
                here = s["found"] | (s["rest"] < n)
                rest = F.when(here, s["rest"]).otherwise(s["rest"] - n)
                return F.struct(F.when(s["found"], s["month"]).otherwise(s["month"] + 1).alias("month"), rest.alias("rest"), here.alias("found"))

            return F.aggregate(lengths, zero, step, lambda s: _ymd(y, s["month"], s["rest"] + 1))

        return _let(months(y, after - first), place)

    def around(y: Column) -> Column:
        bounds = F.transform(F.sequence(y - 1, y + 2), start)

        def choose(b: Column) -> Column:
            k = F.when(day < F.get(b, F.lit(1)), 0).when(day >= F.get(b, F.lit(2)), 2).otherwise(1)
            return in_year(y - 1 + k, F.get(b, k), F.get(b, k + 1))

        return _let(bounds, choose)

    return _let(guess.cast("long"), around)


def _months(*lengths: Column | int) -> Column:
    return F.array(*[(n if isinstance(n, Column) else F.lit(n)).cast("long") for n in lengths])


def hebrew(d: Column) -> Column:
    """The Hebrew calendar; months count from Tishrei, and leap years have thirteen."""

    def elapsed(y: Column) -> Column:
        moons = _div(235 * y - 234, 19)
        day = 29 * moons + _div(12_084 + 13_753 * moons, 25_920)
        return day + F.when(_mod(3 * (day + 1), 7) < 3, 1).otherwise(0)

    def start(y: Column) -> Column:
        def delayed(e: Column) -> Column:
            before, here, after = (F.get(e, F.lit(i)) for i in range(3))
            return 347_998 + here + F.when(after - here == 356, 2).when(here - before == 382, 1).otherwise(0)

        return _let(F.array(elapsed(y - 1), elapsed(y), elapsed(y + 1)), delayed)

    def months(y: Column, days: Column) -> Column:
        second = F.when(days % 10 == 5, 30).otherwise(29)
        third = F.when(days % 10 == 3, 29).otherwise(30)
        rest = (30, 29, 30, 29, 30, 29)
        return F.when((7 * y + 1) % 19 < 7, _months(30, second, third, 29, 30, 30, 29, *rest)).otherwise(_months(30, second, third, 29, 30, 29, *rest))

    return _by_year_starts(jdn(d), start, F.floor((jdn(d) - 347_998) / 365.2468) + 1, months)


def persian(d: Column) -> Column:
    """The Solar Hijri calendar by the arithmetic of cycles of 2820 years."""

    def start(y: Column) -> Column:
        cycle = 474 + _mod(y - 474, 2820)
        return 1_948_321 + _div(682 * cycle - 110, 2816) + 365 * (cycle - 1) + 1_029_983 * _div(y - 474, 2820)

    def months(y: Column, days: Column) -> Column:
        return _months(*[31] * 6, *[30] * 5, F.when(days == 366, 30).otherwise(29))

    return _by_year_starts(jdn(d), start, F.floor((jdn(d) - 1_948_321) / 365.2422) + 1, months)


def french_republican(d: Column) -> Column:
    """The French Republican calendar: twelve months of thirty days and the days that follow them, as a thirteenth."""
    return _thirteen_months(d, 2_375_840)


# Texts


def parse_instant(s: Column) -> Column:
    """An instant of ISO 8601 text (a date, with or without time, fraction and offset; a week date; a day of a year) or
    of an RFC 1123 date; null where it is none. Without an offset the session's zone holds."""
    week = r"^(\d{4})-?W(\d{2})-?([1-7])$"
    ordinal_day = r"^(\d{4})-(\d{3})$"
    part = lambda p, i: F.regexp_extract(s, p, i).try_cast("int")
    by_week = F.when(s.rlike(week), iso_week_date(part(week, 1), part(week, 2), part(week, 3)))
    by_day = F.when(s.rlike(ordinal_day), F.date_add(F.make_date(part(ordinal_day, 1), F.lit(1), F.lit(1)), part(ordinal_day, 2) - 1))
    # Spark's parser for week days in text is the old one; the day of the week says nothing new.
    http = F.try_to_timestamp(F.regexp_replace(s, r"^[A-Z][a-z]{2}, | GMT$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    plain = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), s.try_cast("timestamp"))
    basic = F.when(s.rlike(r"^\d{8}$"), F.try_to_timestamp(s, F.lit("yyyyMMdd")))
    return F.coalesce(by_week.cast("timestamp"), by_day.cast("timestamp"), plain, basic, F.when(s.rlike("^[A-Z][a-z]{2}, "), http))


#: How dates and times of day are written in several places.
DATE_FORMATS = {"european": "dd.MM.yyyy", "american": "MM/dd/yyyy", "british": "dd/MM/yyyy", "south_east_asian": "dd-MM-yyyy", "iso": "yyyy-MM-dd"}
TIME_FORMATS = {"military": "HHmm", "civilian": "h:mm a", "french": "HH'h'mm", "iso": "HH:mm:ss", "railway": "HH:mm", "ledger": "HH.mm"}

# The names of months and weekdays, from January and from Monday.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
WEEKDAYS = {
    "en": "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split(),
    "fr": "lundi mardi mercredi jeudi vendredi samedi dimanche".split(),
    "de": "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag".split(),
    "es": "lunes martes miércoles jueves viernes sábado domingo".split(),
}


def month_name(d: Column, language: str = "en") -> Column:
    return F.get(F.array(*map(F.lit, MONTHS[language])), F.month(d) - 1)


def weekday_name(d: Column, language: str = "en") -> Column:
    return F.get(F.array(*map(F.lit, WEEKDAYS[language])), F.weekday(d))


def rule_parts(text: str) -> dict:
    """The arguments of ``rule`` that the text of a recurrence rule names, such as ``FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,FR``."""
    days = {name: i for i, name in enumerate("MO TU WE TH FR SA SU".split())}
    parts = dict(p.split("=", 1) for p in text.removeprefix("RRULE:").split(";") if p)
    out: dict = {"freq": parts["FREQ"]}
    if "INTERVAL" in parts:
        out["interval"] = int(parts["INTERVAL"])
    if "COUNT" in parts:
        out["count"] = int(parts["COUNT"])
    for name, key in (("BYMONTH", "by_month"), ("BYMONTHDAY", "by_month_day"), ("BYSETPOS", "by_set_pos")):
        if name in parts:
            out[key] = tuple(map(int, parts[name].split(",")))
    if "BYDAY" in parts:
        out["by_day"] = tuple(days[d] for d in parts["BYDAY"].split(","))
    return out


def from_tai(t: Column) -> Column:
    """The instant of one on the TAI timeline."""
    # Seconds of TAI from which each offset holds.
    later = F.filter(F.array(*[F.lit(x).cast("timestamp") for x in LEAP_DAYS]), lambda x: to_tai(x) <= t)
    return F.timestamp_seconds(F.unix_seconds(t) - 10 - F.size(later))


def smear_tai(t: Column) -> Column:
    """An instant on the TAI timeline on which a leap second is spread evenly over the day around it, from noon to noon."""
    micros, day = F.unix_micros(t.cast("timestamp")), 86_400_000_000
    leaps = F.array(*[F.unix_micros(F.lit(x).cast("timestamp")) for x in LEAP_DAYS])
    share = lambda x: F.least(F.greatest(micros - x + F.lit(day // 2), F.lit(0)), F.lit(day))
    total = F.aggregate(leaps, F.lit(0).cast("bigint"), lambda s, x: s + share(x))
    return F.timestamp_micros(micros + 10_000_000 + F.floor(total / 86_400))


def time_of_day(t: Column) -> Column:
    """struct(hour, minute, second, nanos) of an instant in the session's zone."""
    nanos = F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(1_000_000)) * 1000
    return F.struct(F.hour(t).alias("hour"), F.minute(t).alias("minute"), F.second(t).alias("second"), nanos.cast("int").alias("nanos"))
