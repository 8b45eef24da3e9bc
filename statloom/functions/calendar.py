"""Calendar arithmetic: month ordinals, calendar lags, cadence text, clock zones."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def month_ordinal(date_col) -> Column:
    """``year * 12 + month`` as INT, the key every monthly lag works on."""
    d = _c(date_col)
    return (F.year(d) * 12 + F.month(d)).cast("int")


def ordinal_from_label(label) -> Column:
    """'YYYY-MM' text to the month ordinal."""
    c = _c(label)
    return (F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int")).cast("int")


def label_from_ordinal(ordinal) -> Column:
    m = _c(ordinal) - 1
    return F.format_string("%04d-%02d", F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"))


def ordinal_year(ordinal) -> Column:
    return F.floor((_c(ordinal) - 1) / 12).cast("int")


def ordinal_month(ordinal) -> Column:
    return ((_c(ordinal) - 1) % 12 + 1).cast("int")


def shift_label(label, months) -> Column:
    """Month arithmetic on 'YYYY-MM' text."""
    return label_from_ordinal(ordinal_from_label(label) + months)


def calendar_lag(value, by, ordinal, k: int) -> Column:
    """The value exactly ``k`` calendar steps earlier, NULL where that step is absent.

    The frame holds one row because (by, ordinal) is unique, so ``max`` is that
    row's value; a partition is one series, bounded by the length of the calendar.
    """
    by = [by] if isinstance(by, (str, Column)) else list(by)
    w = Window.partitionBy(*by).orderBy(_c(ordinal)).rangeBetween(-k, -k)
    return F.max(_c(value)).over(w)


def trailing(by, ordinal, first: int, last: int = 0):
    """A calendar frame from ``first`` to ``last`` steps relative to the row."""
    by = [by] if isinstance(by, (str, Column)) else list(by)
    return Window.partitionBy(*by).orderBy(_c(ordinal)).rangeBetween(first, last)


def pct_change(value, previous) -> Column:
    """100 * (x / previous - 1), NULL unless the previous level is positive."""
    v, p = _c(value), _c(previous)
    return F.when(p > 0, (v / p - 1) * 100)


def cadence_millis(text) -> Column:
    """'30m', '6h', '1d', '2w' to milliseconds; NULL when the text does not parse."""
    c = F.lower(F.trim(_c(text)))
    n = F.regexp_extract(c, r"^(\d+)\s*([mhdw])$", 1)
    unit = F.regexp_extract(c, r"^(\d+)\s*([mhdw])$", 2)
    per = (
        F.when(unit == "m", 60_000)
        .when(unit == "h", 3_600_000)
        .when(unit == "d", 86_400_000)
        .when(unit == "w", 604_800_000)
    )
    return n.try_cast("bigint") * per


def wall_clock_to_utc(ts, zone) -> Column:
    """A local wall clock in a named zone to UTC, correct across clock changes."""
    return F.to_utc_timestamp(_c(ts), zone)


def fixed_offset_to_utc(ts, hours: int) -> Column:
    """A stamp at a fixed offset (for example -5 or -4) to UTC."""
    return _c(ts) - F.make_dt_interval(F.lit(0), F.lit(hours))


def compact_date(text) -> Column:
    """'YYYYMMDD' to DATE."""
    return F.to_date(_c(text).cast("string"), "yyyyMMdd")


def epiweek_saturday(year, week) -> Column:
    """Week-ending Saturday of an epidemiological week.

    Week 1 is the Sunday-to-Saturday week that holds January 4th.
    """
    jan4 = F.make_date(_c(year), F.lit(1), F.lit(4))
    first_sunday = F.date_sub(jan4, F.dayofweek(jan4) - 1)
    return F.date_add(first_sunday, ((_c(week) - 1) * 7 + 6).cast("int"))


def month_grid(df, by, ordinal):
    """Every (series, month) between each series' first and last month."""
    by = [by] if isinstance(by, str) else list(by)
    return (
        df.groupBy(*by)
        .agg(F.min(ordinal).alias("_lo"), F.max(ordinal).alias("_hi"))
        .select(*by, F.explode(F.sequence("_lo", "_hi")).alias(ordinal))
    )
