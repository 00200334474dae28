"""Formats of output names, labels of time steps, and alignment of a step to its bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000
ALIGNMENTS = ("midpoint", "direct_time", "start_bound", "end_bound")
#: One letter a format: from seconds to years.
FORMATS = {"s": "%Y%m%d%H%M%S", "h": "%Y%m%d%H", "d": "%Y%m%d", "m": "%Y%m", "y": "%Y"}


def aligned(time: Column, low: Column, high: Column, method: str = "midpoint") -> Column:
    """The instant (microseconds) that stands for a step; without bounds the time itself."""
    if method not in ALIGNMENTS:
        raise ValueError(f"time alignment is one of {', '.join(ALIGNMENTS)}")
    if method == "direct_time":
        return time
    whole = {"midpoint": low + F.floor((high - low) / 2).cast("long"), "start_bound": low, "end_bound": high}[method]
    return F.when(low.isNotNull() & high.isNotNull(), whole).otherwise(time)


def format_kind(delta: Column) -> Column:
    """The key of FORMATS for data with `delta` microseconds between steps."""
    return F.when(delta < MINUTE, "s").when(delta < 24 * HOUR, "h").when(delta < 28 * DAY, "d").when(delta / DAY / 30 < 12, "m").otherwise("y")


def stamp(fields: Column, kind: Column, formats: dict[str, str] | None = None) -> Column:
    """Civil fields in the format of `kind`. Years have four digits at least."""
    two = lambda name: F.lpad(fields[name].cast("string"), 2, "0")
    year = F.when(F.abs(fields["year"]) > 9999, fields["year"].cast("string")).otherwise(F.concat(F.when(fields["year"] < 0, "-").otherwise(""), F.lpad(F.abs(fields["year"]).cast("string"), 4, "0")))
    parts = {"%Y": year, "%m": two("month"), "%d": two("day"), "%H": two("hour"), "%M": two("minute"), "%S": two("second")}

    def render(fmt: str) -> Column:
        out, i = [], 0
        while i < len(fmt):
            token = fmt[i : i + 2]
            out.append(parts.get(token, F.lit(fmt[i])))
            i += 2 if token in parts else 1
        return F.concat(*out)

    result = None
    for key, fmt in {**FORMATS, **(formats or {})}.items():
        result = F.when(kind == key, render(fmt)) if result is None else result.when(kind == key, render(fmt))
    return result


def step_label(delta: Column) -> Column:
    """Directory of a time step: hour_N, day_N, month_N or year_N; rounding is half-even and goes upward."""
    hours = F.rint(delta / HOUR)
    days = F.rint(hours / 24)
    months = F.rint(days / 30)
    years = F.rint(months / 12)
    name = lambda unit, n: F.concat(F.lit(unit + "_"), n.cast("long").cast("string"))
    return F.when(hours < 24, name("hour", hours)).when(days < 28, name("day", days)).when(months < 12, name("month", months)).otherwise(name("year", years))


def slice_start(year: Column, size: int, first: Column | int) -> Column:
    """First year of the slice of `size` years that holds `year`, slices being counted from `first`."""
    base = F.lit(first) if isinstance(first, int) else first
    return (base + size * F.floor((year - base) / size)).cast("int")


def year_slices(size: int, first: int, last: int) -> list[tuple[int, int]]:
    """All slices from `first` until `last` is covered; one slice if the range is no longer than `size` years and one."""
    if size < 1:
        raise ValueError("a slice has one year at least")
    if last < first:
        raise ValueError("the last year is before the first")
    if size >= last - first:
        return [(first, last)]
    return [(y, y + size - 1) for y in range(first, last + 1, size)]
