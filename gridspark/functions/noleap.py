"""365-day calendar as column arithmetic. Day number t = days since 1901-01-01."""

from pyspark.sql import Column, functions as F

# Calendar origin and month lengths of a 365-day year.
ORIGIN_YEAR = 1901
MONTH_LENGTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
SECONDS_PER_DAY = 86400.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _month_lookup(values, month) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), _col(month).cast("int"))


def month_start(month) -> Column:
    """Days of the year before the first day of ``month`` (0, 31, 59, ...)."""
    return _month_lookup([sum(MONTH_LENGTHS[:i]) for i in range(12)], month)


def days_in_month(month) -> Column:
    return _month_lookup(MONTH_LENGTHS, month)


def seconds_in_month(month) -> Column:
    return days_in_month(month) * F.lit(SECONDS_PER_DAY)


def day_number(year, month=1, day=1) -> Column:
    """Day number of a (year, month, day) in the 365-day calendar."""
    month = F.lit(month) if isinstance(month, int) else month
    day = F.lit(day) if isinstance(day, int) else _col(day)
    return ((_col(year) - ORIGIN_YEAR) * 365 + month_start(month) + day - 1).cast("int")


def year_of(t) -> Column:
    return (F.floor(_col(t) / 365) + ORIGIN_YEAR).cast("int")


def doy_of(t) -> Column:
    """Day of year, 1..365."""
    return (F.pmod(_col(t), F.lit(365)) + 1).cast("int")


def month_of_doy(doy) -> Column:
    """Month 1..12 of a day of year 1..365."""
    doy, e = _col(doy), F.lit(12)
    for m in range(11, 0, -1):
        e = F.when(doy <= sum(MONTH_LENGTHS[:m]), m).otherwise(e)
    return e.cast("int")


def month_of(t) -> Column:
    return month_of_doy(doy_of(t))


def date_to_day(ts, leap_day: str = "feb28") -> Column:
    """Real date or timestamp to day number; 29 February counts as 28 February."""
    ts = _col(ts)
    m, d = F.month(ts), F.dayofmonth(ts)
    if leap_day == "clamp28":
        d = F.least(d, F.lit(28))
    else:
        d = F.when((m == 2) & (d == 29), 28).otherwise(d)
    return day_number(F.year(ts), m, d)


def date_string_to_day(s) -> Column:
    """'YYYY-MM-DD' to day number without going through a real calendar."""
    p = F.split(_col(s), "-")
    return day_number(p[0].cast("int"), p[1].cast("int"), p[2].cast("int"))


def day_to_date_string(t) -> Column:
    m = month_of(t)
    d = doy_of(t) - month_start(m)
    return F.format_string("%04d-%02d-%02d", year_of(t), m, d.cast("int"))


def day_literal(date: str) -> int:
    """Day number of a literal 'YYYY-MM-DD'."""
    y, m, d = (int(x) for x in date.split("-"))
    return (y - ORIGIN_YEAR) * 365 + sum(MONTH_LENGTHS[: m - 1]) + d - 1


def rebase(t, from_year: int, to_year: int = ORIGIN_YEAR) -> Column:
    """Shift day numbers counted from another origin year."""
    return _col(t) - (to_year - from_year) * 365


def year_file_day(year, day_index) -> Column:
    """Absolute day of the 0-based ``day_index`` inside a per-year file."""
    return ((_col(year) - ORIGIN_YEAR) * 365 + _col(day_index)).cast("int")


def fractional_year(t) -> Column:
    """year + (doy - 1) / 365."""
    return year_of(t) + (doy_of(t) - 1) / F.lit(365.0)


def year_month_key(year, month) -> Column:
    return (_col(year) * 100 + _col(month)).cast("int")


def prev_month(month) -> Column:
    return (F.pmod(_col(month) - 2, F.lit(12)) + 1).cast("int")


def next_month(month) -> Column:
    return (F.pmod(_col(month), F.lit(12)) + 1).cast("int")
