"""Climate-model calendars as column expressions: integer microseconds in, civil fields out.

Days count from 0000-01-01 in fixed-length calendars, and are Julian day numbers in the others; they are only
compared within one calendar. 'standard' (also 'gregorian') is Julian before 1582-10-15.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000
# Unit names and their microseconds.
UNITS = {
    "microsecond": 1, "millisecond": 1_000, "msec": 1_000, "second": 1_000_000, "sec": 1_000_000, "s": 1_000_000,
    "minute": 60_000_000, "min": 60_000_000, "hour": 3_600_000_000, "hr": 3_600_000_000, "h": 3_600_000_000, "day": DAY, "d": DAY,
}
MONTHS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
FIELDS = "struct<year:int,month:int,day:int,hour:int,minute:int,second:int,micro:int>"


def _let(x: Column, body) -> Column:
    """body(x) with x evaluated once, however often the body uses it."""
    return F.transform(F.array(x), body)[0]


def _div(a: Column, b: int) -> Column:
    """Floor division of longs, exactly: shifted by a multiple of b, so that truncation is flooring."""
    k = (1 << 61) // b
    return F.call_function("div", a.cast("long") + F.lit(k * b), F.lit(b).cast("long")) - F.lit(k)


def _starts(leap: bool) -> list[int]:
    days = [d + (leap and i == 1) for i, d in enumerate(MONTHS)]
    return [sum(days[:i]) for i in range(12)]


def _fixed_to_days(y: Column, m: Column, d: Column, leap: bool) -> Column:
    return y * (366 if leap else 365) + F.element_at(F.array(*map(F.lit, _starts(leap))), m.cast("int")) + d - 1


def _fixed_from_days(n: Column, leap: bool) -> tuple[Column, Column, Column]:
    year = 366 if leap else 365
    y, rest = _div(n, year), F.pmod(n, F.lit(year))
    month, start = F.lit(1), F.lit(0)
    for i, s in enumerate(_starts(leap)):
        month, start = F.when(rest >= s, i + 1).otherwise(month), F.when(rest >= s, s).otherwise(start)
    return y, month, rest - start + 1


def _julian_day(y: Column, m: Column, d: Column, gregorian: bool) -> Column:
    a = F.when(m <= 2, 1).otherwise(0)
    yy, mm = y + 4800 - a, m + 12 * a - 3
    base = d + _div(153 * mm + 2, 5) + 365 * yy + _div(yy, 4)
    return base - _div(yy, 100) + _div(yy, 400) - 32045 if gregorian else base - 32083


def _from_julian_day(j: Column, gregorian: bool) -> tuple[Column, Column, Column]:
    f = j + 1401
    if gregorian:
        f = f + _div(_div(4 * j + 274277, 146097) * 3, 4) - 38
    e = 4 * f + 3
    h = 5 * _div(F.pmod(e, F.lit(1461)), 4) + 2
    month = F.pmod(_div(h, 153) + 2, F.lit(12)) + 1
    return _div(e, 1461) - 4716 + _div(14 - month, 12), month, _div(F.pmod(h, F.lit(153)), 5) + 1


def canonical(calendar: Column) -> Column:
    c = F.lower(calendar)
    return F.when(c.isin("standard", "gregorian"), "standard").when(c.isin("noleap", "365_day"), "noleap").when(c.isin("all_leap", "366_day"), "all_leap").otherwise(c)


def to_days(calendar: Column, y: Column, m: Column, d: Column) -> Column:
    """Day number of a date; null for a calendar not known."""
    date = F.struct(y.cast("long").alias("y"), m.cast("long").alias("m"), d.cast("long").alias("d"), canonical(calendar).alias("c"))
    return _let(date.cast("struct<y:bigint,m:bigint,d:bigint,c:string>"), lambda t: _days(t["y"], t["m"], t["d"], t["c"]))


def _days(y: Column, m: Column, d: Column, c: Column) -> Column:
    greg, jul = _julian_day(y, m, d, True), _julian_day(y, m, d, False)
    return (
        F.when(c == "360_day", y * 360 + (m - 1) * 30 + d - 1)
        .when(c == "noleap", _fixed_to_days(y, m, d, False)).when(c == "all_leap", _fixed_to_days(y, m, d, True))
        .when(c == "proleptic_gregorian", greg).when(c == "julian", jul)
        .when(c == "standard", F.when(greg >= 2299161, greg).otherwise(jul))
    )


def civil(calendar: Column, micros: Column) -> Column:
    """Civil fields of microseconds since day 0 of the calendar."""
    def split(m: Column) -> Column:
        return F.struct(_div(m, DAY).alias("n"), F.pmod(m, F.lit(DAY)).alias("rest"), canonical(calendar).alias("c"))

    parts = F.when(micros.isNotNull(), _let(micros, split))
    return _let(parts.cast("struct<n:bigint,rest:bigint,c:string>"), lambda t: F.when(t["n"].isNotNull(), _fields(t["n"], t["rest"], t["c"]))).cast(FIELDS)


def _fields(n: Column, rest: Column, c: Column) -> Column:
    greg, jul = _from_julian_day(n, True), _from_julian_day(n, False)
    fixed, leap = _fixed_from_days(n, False), _fixed_from_days(n, True)
    thirty = (_div(n, 360), _div(F.pmod(n, F.lit(360)), 30) + 1, F.pmod(n, F.lit(30)) + 1)
    pick = [
        F.when(c == "360_day", thirty[i]).when(c == "noleap", fixed[i]).when(c == "all_leap", leap[i]).when(c == "proleptic_gregorian", greg[i]).when(c == "julian", jul[i])
        .when(c == "standard", F.when(n >= 2299161, greg[i]).otherwise(jul[i])).cast("int")
        for i in range(3)
    ]
    names = ["year", "month", "day"]
    clock = {"hour": _div(rest, 3_600_000_000), "minute": F.pmod(_div(rest, 60_000_000), F.lit(60)), "second": F.pmod(_div(rest, 1_000_000), F.lit(60)), "micro": F.pmod(rest, F.lit(1_000_000))}
    return F.struct(*[p.alias(n) for p, n in zip(pick, names)], *[v.cast("int").alias(k) for k, v in clock.items()])


def unit_micros(units: Column) -> Column:
    """Microseconds of the unit in "<unit>s since <date>"; null for units not known."""
    name = F.regexp_replace(F.lower(F.regexp_extract(units, r"^\s*([A-Za-z]+)\s+since\s", 1)), r"(?<=..)s$", "")
    table = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.try_element_at(table, name).cast("long")


def epoch_micros(units: Column, calendar: Column) -> Column:
    """Microseconds from the calendar's day 0 to the reference date in the units."""
    stamp = r"since\s+(-?\d{1,6})-(\d{1,2})-(\d{1,2})(?:[T ]+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?"
    part = lambda i: F.coalesce(F.when(F.regexp_extract(units, stamp, i) != "", F.regexp_extract(units, stamp, i)).cast("long"), F.lit(0))
    days = to_days(calendar, part(1), F.greatest(part(2), F.lit(1)), F.greatest(part(3), F.lit(1)))
    return days * DAY + part(4) * 3_600_000_000 + part(5) * 60_000_000 + part(6) * 1_000_000


def time_micros(time: Column, units: Column, calendar: Column) -> Column:
    """Exact integer microseconds (half-even at the last one) since the calendar's day 0."""
    return scaled(time, unit_micros(units), epoch_micros(units, calendar))


def scaled(time: Column, unit: Column, epoch: Column) -> Column:
    """The same from the unit's and the reference date's microseconds."""
    return F.bround(time * unit.cast("double"), 0).cast("long") + epoch
