"""Date and time functions over serials of the 1900 system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import num, whole
from .registry import function
from .texts import txt
from .values import NUM, VALUE, Val, errors_of, fails, from_serial, merged, number, to_bool, to_serial


def dated(args: list[Val], i: int, fn) -> Val:
    """fn of a serial's timestamp; a serial that is no date fails."""
    ts = from_serial(num(args, i))
    return number(fn(ts), merged(errors_of(args), fails(ts.isNull(), NUM)))


def part(names: str, fn) -> None:
    @function(names, "date", signature="(serial_number)")
    def build(args: list[Val]) -> Val:
        return dated(args, 0, fn)


for name, fn in {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "ISOWEEKNUM": F.weekofyear}.items():
    part(name, fn)


@function("DATE", "date", signature="(year, month, day)")
def date(args: list[Val]) -> Val:
    """Months and days roll over; years from 1 to 9999."""
    y, m, d = (whole(num(args, i)).cast("int") for i in range(3))
    ok = (y >= 1) & (y <= 9999)
    day = F.date_add(F.add_months(F.make_date(F.when(ok, y), F.lit(1), F.lit(1)), m - 1), d - 1)
    return number(to_serial(day), merged(errors_of(args), fails(~ok, NUM)))


@function("TODAY NOW", "date", signature="()")
def today(args: list[Val]) -> Val:
    """Both are the day alone."""
    return number(to_serial(F.current_date()))


@function("WEEKDAY", "date", signature="(serial_number, [return_type])")
def weekday(args: list[Val]) -> Val:
    kind = whole(num(args, 1, 1))
    return dated(args, 0, lambda d: F.when(kind == 2, F.weekday(d) + 1).when(kind == 3, F.weekday(d)).otherwise(F.dayofweek(d)))


def parsed(s: Column) -> Column:
    """A date, a time of day (on an unnamed day) or both, in the invariant forms."""
    forms = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy/M/d", "d MMM yyyy", "MMM d, yyyy"]
    day = [F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in forms]
    clock = [F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), s), F.lit("yyyy-MM-dd " + f)).cast("timestamp_ntz") for f in ("H:mm", "H:mm:ss", "h:mm a", "h:mm:ss a")]
    return F.coalesce(*day, *clock)


@function("DATEVALUE", "date", signature="(date_text)")
def date_value(args: list[Val]) -> Val:
    ts = parsed(txt(args, 0))
    return number(to_serial(ts), merged(errors_of(args), fails(ts.isNull(), VALUE)))


def seconds(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


@function("TIMEVALUE", "date", signature="(time_text)")
def time_value(args: list[Val]) -> Val:
    ts = parsed(txt(args, 0))
    return number(seconds(ts) / F.lit(86400.0), merged(errors_of(args), fails(ts.isNull(), VALUE)))


@function("TIME", "date", signature="(hour, minute, second)")
def time(args: list[Val]) -> Val:
    return number((num(args, 0) * 3600 + num(args, 1) * 60 + num(args, 2)) / F.lit(86400.0), errors_of(args))


@function("EOMONTH", "date", signature="(start_date, months)")
def end_of_month(args: list[Val]) -> Val:
    return dated(args, 0, lambda d: to_serial(F.last_day(F.add_months(d.cast("date"), whole(num(args, 1)).cast("int")))))


@function("EDATE", "date", signature="(start_date, months)")
def edate(args: list[Val]) -> Val:
    return dated(args, 0, lambda d: to_serial(F.add_months(d.cast("date"), whole(num(args, 1)).cast("int"))))


@function("DAYS", "date", signature="(end_date, start_date)")
def days(args: list[Val]) -> Val:
    return number(F.floor(num(args, 0)) - F.floor(num(args, 1)), errors_of(args))


def both(args: list[Val]) -> tuple[Column, Column, Column | None]:
    a, b = from_serial(num(args, 0)), from_serial(num(args, 1))
    return a, b, merged(errors_of(args), fails(a.isNull() | b.isNull(), NUM))


def thirty(a: Column, b: Column, first: Column, last: Column) -> Column:
    """Days between two dates of a year of twelve months of thirty days."""
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + last - first


@function("DAYS360", "date", signature="(start_date, end_date, [method])")
def days360(args: list[Val]) -> Val:
    a, b, err = both(args)
    european = to_bool(args[2]) if len(args) > 2 else F.lit(False)
    first, last = F.dayofmonth(a), F.dayofmonth(b)
    cut = lambda c: F.least(c, F.lit(30))
    return number(thirty(a, b, cut(first), F.when(european | (first == 31), cut(last)).otherwise(last)), err)


@function("WEEKNUM", "date", signature="(serial_number, [return_type])")
def week_number(args: list[Val]) -> Val:
    """Weeks of the year from its first day on, from Sunday for type 1, else from Monday."""
    sunday = whole(num(args, 1, 1)) == 1

    def week(d: Column) -> Column:
        first = F.trunc(d.cast("date"), "year")
        offset = F.when(sunday, F.dayofweek(first) - 1).otherwise(F.weekday(first))
        return F.floor((F.dayofyear(d) - 1 + offset) / 7) + 1

    return dated(args, 0, week)


def leap(d: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(F.year(d), F.lit(2), F.lit(1)))) == 29


@function("YEARFRAC", "date", signature="(start_date, end_date, [basis])")
def year_fraction(args: list[Val]) -> Val:
    """Days over 365; basis 1 over the length of the starting year, basis 4 in twelve months of thirty days."""
    a, b, err = both(args)
    n, basis = F.datediff(b, a).cast("double"), F.rint(num(args, 2))
    first = F.least(F.dayofmonth(a), F.lit(30))
    last = F.when((F.dayofmonth(b) == 31) & (first >= 30), 30).otherwise(F.dayofmonth(b))
    return number(F.when(basis == 1, n / F.when(leap(a), 366.0).otherwise(365.0)).when(basis == 4, thirty(a, b, first, last) / 360.0).otherwise(n / 365.0), err)


@function("DATEDIF", "date", signature="(start_date, end_date, unit)")
def date_dif(args: list[Val]) -> Val:
    """M and Y don't look at the day, YM may be below 0, and an unknown unit fails."""
    a, b, err = both(args)
    unit = txt(args, 2)
    y, m, d = F.year(b) - F.year(a), F.month(b) - F.month(a), F.dayofmonth(b) - F.dayofmonth(a)
    borrowed = F.dayofmonth(F.last_day(F.add_months(b.cast("date"), -1)))
    anniversary = F.add_months(a.cast("date"), y * 12)
    by_unit = {"D": F.floor(num(args, 1)) - F.floor(num(args, 0)), "M": y * 12 + m, "Y": y, "MD": F.when(d >= 0, d).otherwise(d + borrowed), "YM": m, "YD": F.datediff(anniversary, a)}
    out = F.coalesce(*[F.when(unit == k, v.cast("double")) for k, v in by_unit.items()])
    return number(out, merged(err, fails(~unit.isin(*by_unit), VALUE)))


