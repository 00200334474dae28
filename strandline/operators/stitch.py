"""Spatial tiles of one field: consistency, combined coordinates, and pasting by coordinate index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_consistency(rows: DataFrame, group: list[str], time: str) -> DataFrame:
    """(group, consistent, fragmented): every time has as many rows; more than one row a time."""
    counts = rows.groupBy(*group, time).agg(F.count("*").alias("_n"))
    return counts.groupBy(*group).agg((F.min("_n") == F.max("_n")).alias("consistent"), (F.max("_n") > 1).alias("fragmented"), F.min("_n").alias("min_tiles"), F.max("_n").alias("max_tiles"))


def concat_coords(rows: DataFrame, group: list[str], dim: str, coords: str) -> DataFrame:
    """(group, dim, axis): the ascending union of all tiles' coordinates."""
    return rows.select(*group, dim, F.explode(coords).alias("_x")).groupBy(*group, dim).agg(F.array_sort(F.collect_set("_x")).alias("axis"))


def _filled(cells: Column) -> Column:
    """An array of (position, value) structs as an array of values at their positions, null where no cell is; of cells at
    one position the last stays. One sort; each gap is filled at once, so the work is linear in the result."""
    after = lambda i: F.get("_s", i + 1)["position"]
    nulls = lambda n: F.array_repeat(F.get("_s", F.lit(-1))["value"], n.cast("int"))
    parts = F.transform("_s", lambda x, i: F.when(after(i) == x["position"], F.array_repeat(x["value"], 0)).otherwise(F.concat(F.array(x["value"]), nulls(F.coalesce(after(i) - x["position"] - 1, F.lit(0))))))
    return F.concat(nulls(F.get("_s", F.lit(0))["position"]), F.flatten(parts))


def stitch(cells: DataFrame, group: list[str], position: str, value: str) -> DataFrame:
    """One array a group from (group, position, value): each cell at its own index, null where no tile has one."""
    cell = F.struct(F.col(position).cast("long").alias("position"), F.col(value).alias("value"))
    got = cells.groupBy(*group).agg(F.array_sort(F.collect_list(cell)).alias("_s"))
    return got.select(*group, _filled(F.col("_s")).alias("data"))


def paste_tiles(tiles: DataFrame, group: list[str], value_dims: list[str]) -> DataFrame:
    """Paste 2-D tiles: rows (group, time, coords map, data flat row-major). Each cell goes to the index
    of its own coordinates on the combined axes, so descending tiles and gaps come out right. A tile's coordinates are looked up
    once, and its cells stay one array until they are pasted."""
    axes = None
    for d in value_dims:
        axis = tiles.select(*group, F.explode(F.col("coords")[d]).alias("_x")).groupBy(*group).agg(F.array_sort(F.collect_set("_x")).alias(f"axis_{d}"))
        axes = axis if axes is None else axes.join(axis, group)
    a, b = value_dims
    index = lambda d: F.transform(F.col("coords")[d], lambda x: F.array_position(f"axis_{d}", x) - 1)
    placed = tiles.join(axes, group).withColumns({"_rows": index(a), "_cols": index(b)})
    at = F.flatten(F.transform("_rows", lambda r: F.transform("_cols", lambda c: r * F.size(f"axis_{b}") + c)))
    cells = F.zip_with(at, "data", lambda p, x: F.struct(p.alias("position"), x.alias("value")))
    whole = [*group, "time", f"axis_{a}", f"axis_{b}"]
    joined = placed.select(*whole, cells.alias("_c")).groupBy(*whole).agg(F.array_sort(F.flatten(F.collect_list("_c"))).alias("_s"))
    full = F.size(f"axis_{a}") * F.size(f"axis_{b}")
    out = joined.withColumn("data", _filled(F.col("_s")))
    padded = F.concat("data", F.array_repeat(F.get("_s", F.lit(-1))["value"], full - F.size("data")))
    return out.withColumn("data", padded).withColumn("shape", F.array(F.size(f"axis_{a}"), F.size(f"axis_{b}"))).drop("_s")
