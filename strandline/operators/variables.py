"""Variables of a file: classification, names of time variables, schema choice, attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names and dimensions that mark a variable as secondary, and names of time bounds.
BOUNDS_NAMES = ["time_bnds", "time_bnd", "time_bounds", "time_bound"]
SECONDARY_DIMS = ["nbnd", "chars", "string_length", "hist_interval"]


def is_secondary(name: Column, dims: Column, time_name: Column | str = "time", secondary: list[str] = BOUNDS_NAMES, secondary_dims: list[str] = SECONDARY_DIMS, max_dims: int = 1) -> Column:
    """Secondary: listed by name or dimension, or without more than `max_dims` distinct dimensions with time among them."""
    time = F.lit(time_name) if isinstance(time_name, str) else time_name
    listed = F.lower(name).isin(secondary) | F.arrays_overlap(dims, F.array(*map(F.lit, secondary_dims)))
    return listed | ~((F.size(F.array_distinct(dims)) > max_dims) & F.array_contains(dims, time))


def time_name(names: Column) -> Column:
    """The variable called time in any case; null if there is none."""
    return F.try_element_at(F.filter(names, lambda n: F.lower(n) == "time"), F.lit(-1))


def bounds_name(names: Column) -> Column:
    """The last of a file's variables that has a name of time bounds."""
    return F.try_element_at(F.filter(names, lambda n: F.lower(n).isin(BOUNDS_NAMES)), F.lit(-1))


def dim_bounds(values: Column) -> Column:
    """[min, max] of a coordinate, or its only value."""
    return F.when(F.size(values) >= 2, F.array(F.array_min(values), F.array_max(values))).otherwise(values)


def majority_schema(rows: DataFrame, group: list[str], fingerprint: str) -> DataFrame:
    """Rows whose fingerprint is the only most common one of its group; groups with a tie have none."""
    counts = rows.groupBy(*group, fingerprint).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group)
    best = counts.withColumn("_most", F.max("_n").over(w)).where("_n = _most").withColumn("_ties", F.count("*").over(w)).where("_ties = 1")
    return rows.join(best.select(*group, fingerprint), [*group, fingerprint], "left_semi")


def attributes_last_wins(rows: DataFrame, group: list[str], attrs: str, order: str) -> DataFrame:
    """(group, key, value): of each attribute the value of the last row that has it."""
    entries = rows.select(*group, order, F.explode(F.map_entries(attrs)).alias("e"))
    return entries.groupBy(*group, F.col("e.key").alias("key")).agg(F.max_by("e.value", order).alias("value"))
