"""Cron schedules: expected firings and the polls that serve them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telelake.plans.running import with_running
from telelake.session import materialize

_BOUNDS = {
    "second": (0, 59),
    "minute": (0, 59),
    "hour": (0, 23),
    "day": (1, 31),
    "month": (1, 12),
    "weekday": (0, 6),
}
_YEARS = (1970, 2100)
_HOUR_US = 3_600_000_000


# Names inside fields and shorthands for whole schedules.
_NAMES = {
    "month": "jan feb mar apr may jun jul aug sep oct nov dec".split(),
    "weekday": "sun mon tue wed thu fri sat".split(),
}
SHORTHANDS = {
    "@yearly": "0 0 0 1 1 *",
    "@annually": "0 0 0 1 1 *",
    "@monthly": "0 0 0 1 * *",
    "@weekly": "0 0 0 * * sun",
    "@daily": "0 0 0 * * *",
    "@midnight": "0 0 0 * * *",
    "@hourly": "0 0 * * * *",
}
_NUMBER = r"^\d{1,4}$"


def field_values(text: Column, low: int, high: int) -> Column:
    """Numbers selected by one cron field: ``*``, ``a``, ``a-b``, with ``/n``, in lists.

    NULL if any part cannot be read or leaves ``low`` to ``high``.
    """

    def number(item: Column) -> Column:
        return F.when(item.rlike(_NUMBER), item).try_cast("int")

    def part(item: Column) -> Column:
        base = F.substring_index(item, "/", 1)
        stepped = F.contains(item, F.lit("/"))
        whole = base.isin("*", "?")
        ranged = F.contains(base, F.lit("-"))
        step = F.when(stepped, number(F.substring(item, F.length(base) + 2, F.length(item)))).otherwise(1)
        start = F.when(whole, F.lit(low)).otherwise(number(F.substring_index(base, "-", 1)))
        # A single start with a step runs to the end of the field's range.
        stop = (
            F.when(whole, F.lit(high))
            .when(ranged, number(F.substring(base, F.length(F.substring_index(base, "-", 1)) + 2, F.length(base))))
            .otherwise(F.when(stepped, F.lit(high)).otherwise(start))
        )
        sound = (step > 0) & (start >= low) & (stop <= high) & (start <= stop)
        return F.when(sound, F.sequence(F.when(sound, start), F.when(sound, stop), F.when(sound, step)))

    parts = F.transform(F.split(text, ","), part)
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_distinct(F.flatten(parts)))


def _parsed(schedules: DataFrame, first_weekday: int) -> DataFrame:
    """Schedules with the numbers of each field; ``_readable`` is false if one has none."""
    plain = F.lower(F.trim("cron"))
    known = F.create_map(*[F.lit(x) for pair in SHORTHANDS.items() for x in pair])
    fields = F.split(F.coalesce(F.try_element_at(known, plain), plain), r"\s+")
    parsed = schedules
    for i, (name, (low, high)) in enumerate(_BOUNDS.items()):
        shift = first_weekday if name == "weekday" else 0
        text = F.get(fields, F.lit(i))
        for place, word in enumerate(_NAMES.get(name, ())):
            text = F.regexp_replace(text, rf"\b{word}\b", str(place + (1 if name == "month" else shift)))
        # Counted from 0, Sunday is 7 as well.
        top = high + shift + (1 if name == "weekday" and not first_weekday else 0)
        values = field_values(text, low + shift, top)
        if top > high + shift:
            values = F.array_distinct(F.transform(values, lambda v: v % 7))
        parsed = parsed.withColumn(f"_{name}", values)
    year = F.get(fields, F.lit(6))
    parsed = parsed.withColumn("_year", F.when(year.isNotNull(), field_values(year, *_YEARS)))
    readable = F.size(fields).isin(6, 7) & (year.isNull() | F.col("_year").isNotNull())
    for name in _BOUNDS:
        readable = readable & F.col(f"_{name}").isNotNull()
    return parsed.withColumn("_readable", F.coalesce(readable, F.lit(False)))


def _expressions(schedules: DataFrame, first_weekday: int) -> DataFrame:
    """Every expression that occurs, read once however many schedules share it.

    Stored, so that the engine knows how few or many there are before it joins them.
    """
    return materialize(_parsed(schedules.select("cron").distinct(), first_weekday), "expressions")


def _of_expressions(rows: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their expressions; an absent one counts as an expression."""
    found = found.withColumnRenamed("cron", "_cron")
    return rows.join(found, F.col("cron").eqNullSafe(F.col("_cron")), how).drop("_cron")


def cron_rejects(schedules: DataFrame, first_weekday: int = 0) -> DataFrame:
    """The rows of ``schedules`` whose expression cannot be read; they never fire."""
    unreadable = _expressions(schedules, first_weekday).where("not _readable").select("cron")
    return _of_expressions(schedules, unreadable, "left_semi")


def cron_firings(
    schedules: DataFrame,
    start: str,
    end: str,
    *,
    timezone: str = "UTC",
    first_weekday: int = 0,
) -> DataFrame:
    """``(service, firing_us)`` of every ``schedules(service, cron)`` row.

    Firings lie in ``[from_us, until_us)`` when the row has these columns, and always
    in ``[start, end)``. Days are expanded first and filtered, then hours, minutes and
    seconds of the selected days only; no step lists more than a day's worth of values.
    ``first_weekday`` is the number of Sunday; names of days mean the same in either
    numbering. Unreadable expressions fire never and are listed by :func:`cron_rejects`.
    """
    parsed = _expressions(schedules, first_weekday).where("_readable")

    day = F.col("_date")
    dates = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day")))
    of_days = parsed.withColumn("_date", dates).where(
        F.array_contains("_day", F.dayofmonth(day))
        & F.array_contains("_month", F.month(day))
        & F.array_contains("_weekday", F.dayofweek(day) - 1 + first_weekday)
        & (F.col("_year").isNull() | F.array_contains("_year", F.year(day)))
    )
    windowed = [c for c in ("from_us", "until_us") if c in schedules.columns]

    def overlapping(df: DataFrame, begin: Column, length_us: int, slack_us: int = 0) -> DataFrame:
        """Keep what can touch the row's own window, before it multiplies further."""
        if "from_us" in windowed:
            df = df.where(begin + (length_us + slack_us) > F.col("from_us"))
        if "until_us" in windowed:
            df = df.where(begin - slack_us < F.col("until_us"))
        return df

    def local(hour: Column, minute: Column) -> Column:
        at = [F.year(day), F.month(day), F.dayofmonth(day), hour, minute]
        return F.unix_micros(F.make_timestamp(*at, F.lit(0).cast("decimal(16,6)"), F.lit(timezone)))

    # Clock changes move an hour by at most one; minutes are exact.
    midnight = local(F.lit(0), F.lit(0))
    days = schedules.select("service", "cron", *windowed)
    days = _of_expressions(days, of_days.select("cron", "_date"))
    days = overlapping(days, midnight, 24 * _HOUR_US, _HOUR_US)
    # The rows are still few and narrow here; spread them before they multiply.
    spread = days.repartition("service", "_date")
    spread = _of_expressions(spread, parsed.select("cron", "_hour", "_minute", "_second"))
    hours = spread.withColumn("_h", F.explode("_hour"))
    hours = overlapping(hours, local(F.col("_h"), F.lit(0)), _HOUR_US, _HOUR_US)
    minutes = hours.withColumn("_m", F.explode("_minute"))
    minutes = minutes.withColumn("_us", local(F.col("_h"), F.col("_m")))
    minutes = overlapping(minutes, F.col("_us"), 60_000_000)
    seconds = minutes.withColumn("_s", F.explode("_second"))
    fired = seconds.withColumn("firing_us", F.col("_us") + F.col("_s") * 1_000_000)
    inside = (F.col("firing_us") >= _instant(start, timezone)) & (F.col("firing_us") < _instant(end, timezone))
    if "from_us" in windowed:
        inside = inside & (F.col("firing_us") >= F.col("from_us"))
    if "until_us" in windowed:
        inside = inside & (F.col("firing_us") < F.col("until_us"))
    return fired.where(inside).select("service", "firing_us")


def _instant(text: str, timezone: str) -> Column:
    return F.unix_micros(F.to_utc_timestamp(F.lit(text).cast("timestamp"), timezone))


def cron_runs(firings: DataFrame, polls: DataFrame, segments: int | None = None) -> DataFrame:
    """``(service, poll_us)``: polls that start a scheduled run.

    A firing is served by the first poll at or after it; firings since the previous
    poll collapse into one run. Looking forward is a running value over descending
    time, so no service is handled by one task.
    """
    nothing = F.lit(None).cast("bigint")
    # Most services may have no polls at all; their firings would be sorted for nothing.
    polled = polls.select(F.col("service").alias("_polled")).distinct()
    timeline = firings.join(polled, F.col("service").eqNullSafe(F.col("_polled")), "left_semi").select(
        "service", F.col("firing_us").alias("_at"), F.lit(1).alias("_firing"), nothing.alias("_poll")
    ).union(
        polls.select("service", F.col("poll_us").alias("_at"), F.lit(0).alias("_firing"), F.col("poll_us").alias("_poll"))
    )
    # Descending, with polls ahead of firings of the same instant.
    served = with_running(
        timeline,
        ["service"],
        [F.desc("_at"), F.asc("_firing")],
        lasts={"poll_us": F.col("_poll")},
        segments=segments,
    )
    return served.where("_firing = 1 and poll_us is not null").select("service", "poll_us").distinct()
