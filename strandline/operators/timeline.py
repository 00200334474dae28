"""Time axes: steps, deltas, year bounds, slices and their index ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timestamps import slice_start


def time_axis(rows: DataFrame, group: list[str], time: str) -> DataFrame:
    """(group, time) distinct."""
    return rows.select(*group, time).distinct()


def timestep_delta(rows: DataFrame, group: list[str], time: str) -> DataFrame:
    """(group, delta): the last distinct time minus the one before; null for a group with one. Two maxima by
    aggregates; no group's times are gathered."""
    last = rows.groupBy(*group).agg(F.max(time).alias("_last"))
    before = rows.join(last, group).where(F.col(time) < F.col("_last")).groupBy(*group).agg(F.max(time).alias("_before"))
    return last.join(before, group, "left").select(*group, (F.col("_last") - F.col("_before")).alias("delta"))


def year_bounds(rows: DataFrame, group: list[str], year: Column) -> DataFrame:
    return rows.groupBy(*group).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def with_slices(rows: DataFrame, group: list[str], year: Column, size: int = 10, start_year: int | None = 0) -> DataFrame:
    """Adds slice_start and slice_end (years). start_year None: the group's first year. Years before
    start_year are in no slice and their rows go. A group no longer than one slice has the one slice of its own years."""
    base = rows.withColumn("_year", year)
    bounds = year_bounds(base, group, F.col("_year"))
    out = base.join(bounds, group) if group else base.crossJoin(bounds)
    first = F.col("first_year") if start_year is None else F.lit(start_year)
    single = F.lit(size) >= F.col("last_year") - first
    start = F.when(single, first).otherwise(slice_start(F.col("_year"), size, first))
    out = out.where(F.col("_year") >= first).withColumn("slice_start", start.cast("int"))
    return out.withColumn("slice_end", F.when(single, F.col("last_year")).otherwise(F.col("slice_start") + size - 1).cast("int")).drop("_year", "first_year", "last_year")


def slice_index_ranges(rows: DataFrame, group: list[str], time: str, slices: list[str]) -> DataFrame:
    """(group, slices, start_index, end_index): half-open positions of a slice on its group's sorted axis.
    Positions come from counts of earlier slices, so no group is sorted: rows are distinct times with
    non-overlapping slices."""
    counts = rows.groupBy(*group, *slices).agg(F.countDistinct(time).alias("_n"), F.min(time).alias("_t"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("long")
    return counts.select(*group, *slices, start.alias("start_index"), (start + F.col("_n")).cast("long").alias("end_index"))


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds each row's place (from 0) in the order of the columns `order`. Rows are dealt by range and sorted where they are; a
    range's first place is the count of the ranges before it, so no task holds more than a range."""
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    # Kept once: the ranges are sampled, and both reads below must see the same ones.
    ranged = rows.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()).cache()
    part = F.shiftright("_row", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    out = ranged.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_start") + F.col("_row").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_row", *keys)
