"""Queries over dates, periods and recurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import temporal as D
from loomstone.plans.registry import Registry, table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
_DAYS = "(SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)"


def _days(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))


def _text(c):
    return F.date_format(c, "yyyy-MM-dd")


@_R.add(
    "q_date_parts",
    f"""
    SELECT o_orderkey, year(d) AS y, month(d) AS m, day(d) AS day, isodow(d) - 1 AS weekday, dayofyear(d) AS of_year, isodow(d) > 5 AS weekend,
           strftime(date_trunc('month', d), '%Y-%m-%d') AS month_start, epoch(d)::BIGINT // 86400 + 2440588 AS jdn FROM {_DAYS}
    """,
)
def date_parts(spark, sf_dir):
    d = F.col("d")
    longs = {"y": F.year(d), "m": F.month(d), "day": F.day(d), "weekday": F.weekday(d), "of_year": F.dayofyear(d)}
    return _days(spark, sf_dir).select(
        "o_orderkey",
        *[c.cast("long").alias(n) for n, c in longs.items()],
        D.weekend(d).alias("weekend"),
        _text(F.trunc(d, "MM")).alias("month_start"),
        D.jdn(d).alias("jdn"),
    )


@_R.add("q_iso_week", f"SELECT o_orderkey, isoyear(d) AS week_year, week(d) AS week, strftime(d, '%Y-%m-%d') AS back FROM {_DAYS}")
def iso_week(spark, sf_dir):
    """The ISO week of each date, and the date of that week and weekday again."""
    d = F.col("d")
    back = D.iso_week_date(D.week_year(d).cast("int"), F.weekofyear(d), F.weekday(d) + 1)
    return _days(spark, sf_dir).select("o_orderkey", D.week_year(d).cast("long").alias("week_year"), F.weekofyear(d).cast("long").alias("week"), _text(back).alias("back"))


@_R.add(
    "q_add_months",
    f"""
    SELECT o_orderkey, strftime(d + INTERVAL 1 MONTH, '%Y-%m-%d') AS clamped,
           strftime((date_trunc('month', d) + INTERVAL 1 MONTH) + (day(d) - 1) * INTERVAL 1 DAY, '%Y-%m-%d') AS over FROM {_DAYS}
    """,
)
def add_months(spark, sf_dir):
    d = F.col("d")
    return _days(spark, sf_dir).select("o_orderkey", _text(D.add_months(d, 1)).alias("clamped"), _text(D.add_months(d, 1, "overflow")).alias("over"))


_HOLIDAYS = ("1995-12-25", "1995-12-26", "1996-01-01")


@_R.add(
    "q_working_days",
    f"""
    WITH o AS (SELECT * FROM {_DAYS}), h AS (SELECT unnest([{", ".join(f"DATE '{h}'" for h in _HOLIDAYS)}]) AS h),
         c AS (SELECT o_orderkey, d + i AS x FROM (SELECT *, unnest(range(1, 30))::INT AS i FROM o)),
         w AS (SELECT o_orderkey, x, row_number() OVER (PARTITION BY o_orderkey ORDER BY x) AS n FROM c WHERE isodow(x) < 6 AND x NOT IN (FROM h))
    SELECT o_orderkey, strftime(x, '%Y-%m-%d') AS due FROM w WHERE n = 7
    """,
)
def working_days(spark, sf_dir):
    """Seven working days after each order."""
    return _days(spark, sf_dir).select("o_orderkey", _text(D.add_working_days(F.col("d"), 7, _HOLIDAYS)).alias("due"))


@_R.add(
    "q_working_days_between",
    f"""
    WITH o AS (SELECT * FROM {_DAYS})
    SELECT o_orderkey, (SELECT count(*) FROM (SELECT unnest(range(0, 40))::INT AS i) WHERE isodow(d + i) < 6
        AND d + i NOT IN ({", ".join(f"DATE '{h}'" for h in _HOLIDAYS)})) AS n FROM o
    """,
)
def working_days_between(spark, sf_dir):
    n = D.working_days_between(F.col("d"), F.date_add("d", 40), _HOLIDAYS)
    return _days(spark, sf_dir).select("o_orderkey", n.cast("long").alias("n"))


@_R.add(
    "q_weekday_count",
    f"SELECT o_orderkey, (SELECT count(*) FROM (SELECT unnest(range(0, 100))::INT AS i) WHERE isodow(d + i) = 5) AS fridays FROM {_DAYS}",
)
def weekday_count(spark, sf_dir):
    return _days(spark, sf_dir).select("o_orderkey", D.count_weekday(F.col("d"), F.date_add("d", 100), 4).alias("fridays"))


@_R.add(
    "q_segments",
    """
    WITH p AS (SELECT event_id, ts AS a, ts + INTERVAL 1 HOUR AS b FROM events),
         s AS (SELECT event_id, a, b, unnest(range(a, b, INTERVAL 25 MINUTE)) AS s FROM p)
    SELECT event_id, count(*) AS n, count(*) FILTER (WHERE s + INTERVAL 25 MINUTE <= b) AS whole,
           (epoch(max(least(s + INTERVAL 25 MINUTE, b)) - max(s)) / 60)::BIGINT AS last_minutes FROM s GROUP BY 1
    """,
)
def segments(spark, sf_dir):
    """An hour in segments of 25 minutes, the last of which is short."""
    a = F.col("ts").cast("timestamp")
    tiled = D.segments(a, a + F.expr("interval 1 hour"), "25 minutes")
    whole = D.segments(a, a + F.expr("interval 1 hour"), "25 minutes", partial=False)
    last = F.element_at(tiled, -1)
    minutes = (F.unix_micros(last["finish"]) - F.unix_micros(last["start"])) / 60_000_000
    return table(spark, sf_dir, "events").select("event_id", F.size(tiled).cast("long").alias("n"), F.size(whole).cast("long").alias("whole"), minutes.cast("long").alias("last_minutes"))


@_R.add(
    "q_period_ops",
    """
    WITH p AS (SELECT event_id, ts AS a0, ts + INTERVAL 2 HOUR AS a1, ts + INTERVAL (event_id % 4) HOUR AS b0,
                      ts + INTERVAL (event_id % 4 + 1) HOUR AS b1 FROM events)
    SELECT event_id, CASE WHEN greatest(a0, b0) < least(a1, b1) THEN (epoch(least(a1, b1) - greatest(a0, b0)) / 60)::BIGINT END AS overlap,
           CASE WHEN greatest(a0, b0) < least(a1, b1) THEN 1 ELSE 2 END::BIGINT AS parts, b0 >= a0 AND b0 < a1 AS inside FROM p
    """,
)
def period_ops(spark, sf_dir):
    """Overlap, union and membership of periods."""
    t, k = F.col("ts").cast("timestamp"), F.col("event_id") % 4
    hours = lambda n: F.make_dt_interval(hours=n.cast("int"))
    a, b = D.period(t, t + hours(F.lit(2))), D.period(t + hours(k), t + hours(k + 1))
    both = D.intersect(a, b)
    minutes = ((F.unix_micros(both["finish"]) - F.unix_micros(both["start"])) / 60_000_000).cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id", minutes.alias("overlap"), F.size(D.unite(a, b)).cast("long").alias("parts"), D.contains(a, t + hours(k)).alias("inside")
    )


@_R.add(
    "q_recurrence",
    f"""
    WITH o AS (SELECT * FROM {_DAYS}),
         c AS (SELECT o_orderkey, d, d + i AS x FROM (SELECT *, unnest(range(0, 400))::INT AS i FROM o)),
         r AS (SELECT *, (year(x) * 12 + month(x)) - (year(d) * 12 + month(d)) AS steps FROM c)
    SELECT o_orderkey, string_agg(strftime(x, '%m-%d'), ',' ORDER BY x) AS days FROM r WHERE steps % 2 = 0 AND day(x) = day(d) GROUP BY 1
    """,
)
def recurrence(spark, sf_dir):
    """Every second month on the day of the order; months that lack the day are skipped."""
    days = D.rule(F.col("d"), "MONTHLY", F.date_add("d", 399), interval=2)
    return _days(spark, sf_dir).select("o_orderkey", F.array_join(F.transform(days, lambda x: F.date_format(x, "MM-dd")), ",").alias("days"))


@_R.add("q_calendars")
def calendars(spark, sf_dir):
    """Order dates in other calendars; tests hold them against known days."""
    d = F.col("d")
    others = {"julian": D.julian(d), "coptic": D.coptic(d), "ethiopian": D.ethiopian(d), "islamic": D.islamic(d), "indian": D.indian(d)}
    others |= {"hebrew": D.hebrew(d), "persian": D.persian(d), "republican": D.french_republican(d)}
    show = lambda s: F.concat_ws("-", s["year"], s["month"], s["day"])
    years = [D.buddhist_year(d).alias("buddhist"), D.minguo_year(d).alias("minguo")]
    return _days(spark, sf_dir).select("o_orderkey", *[show(c).alias(n) for n, c in others.items()], *years)


@_R.add(
    "q_julian_round_trip",
    f"SELECT o_orderkey, epoch(d)::BIGINT // 86400 + 2440588 AS jdn, year(d + INTERVAL '-13' DAY)::BIGINT AS julian_year FROM {_DAYS}",
)
def julian_round_trip(spark, sf_dir):
    """Dates of the twentieth century in the Julian calendar, thirteen days behind, and back."""
    j = D.julian(F.col("d"))
    return _days(spark, sf_dir).select(
        "o_orderkey", D.julian_to_jdn(j["year"], j["month"], j["day"]).alias("jdn"), j["year"].cast("long").alias("julian_year")
    )


@_R.add(
    "q_span_text",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'PT' || (o_orderkey % 7 + 1) || 'H' ELSE 'P' || (o_orderkey % 3) || 'M' || 'T' || (o_orderkey % 7 + 1) || 'H' END AS iso, true AS same FROM orders",
)
def span_text(spark, sf_dir):
    """Spans as ISO 8601 text, and parsed again."""
    s = D.span(months=F.col("o_orderkey") % 3, hours=F.col("o_orderkey") % 7 + 1)
    spans = table(spark, sf_dir, "orders").select("o_orderkey", s.alias("span"))
    texts = spans.select("o_orderkey", D.span_iso(F.col("span")).alias("iso"))
    parsed = texts.select("o_orderkey", "iso", D.parse_span(F.col("iso")).alias("again"))
    return parsed.select("o_orderkey", "iso", (D.span_iso(F.col("again")) == F.col("iso")).alias("same"))


@_R.add(
    "q_tai",
    "SELECT event_id, floor(epoch(ts))::BIGINT + 10 + (SELECT count(*) FROM (SELECT unnest([%s]) AS l) WHERE l <= ts) AS tai FROM events"
    % ", ".join(f"DATE '{d}'" for d in D.LEAP_DAYS),
)
def tai(spark, sf_dir):
    """Instants in whole seconds on a timeline without leap seconds' gaps."""
    whole = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(D.to_tai(whole)).alias("tai"))
