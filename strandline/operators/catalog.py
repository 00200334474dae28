"""Collections of history files: an immutable, lazy wrapper around a catalog DataFrame."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendars as C
from ..functions import paths as P
from ..functions import timestamps as T
from ..functions.globs import matches
from ..sources import history
from . import timeline, variables


@dataclass(frozen=True)
class HistoryCollection:
    """Files with their metadata. Filters, groups and slices are derived columns; nothing is changed in place."""

    frame: DataFrame
    head: str
    slice_years: int | None = None
    start_year: int | None = 0
    slice_pattern: str = "*"
    alignment: str = "midpoint"

    @classmethod
    def open(cls, spark: SparkSession, head: str, pattern: str = "*.nc*") -> HistoryCollection:
        return cls(history.catalog(spark, head, pattern), head)

    def _with(self, frame: DataFrame) -> HistoryCollection:
        return replace(self, frame=frame)

    def include(self, glob_patterns: str | list[str] | None = None, *, glob: str | list[str] | None = None) -> HistoryCollection:
        """Keep paths that match any pattern."""
        return self._with(self.frame.where(matches(F.col("path"), glob if glob_patterns is None else glob_patterns)))

    def exclude(self, glob_patterns: str | list[str] | None = None, *, glob: str | list[str] | None = None) -> HistoryCollection:
        """Drop paths that match any pattern."""
        return self._with(self.frame.where(~matches(F.col("path"), glob if glob_patterns is None else glob_patterns)))

    def include_patterns(self, patterns: list[str]) -> HistoryCollection:
        warnings.warn("use include", DeprecationWarning, stacklevel=2)
        return self.include(patterns)

    def exclude_patterns(self, patterns: list[str]) -> HistoryCollection:
        warnings.warn("use exclude", DeprecationWarning, stacklevel=2)
        return self.exclude(patterns)

    def include_years(self, start_year: int, end_year: int, glob_patterns: str | list[str] = "*", glob: str | list[str] | None = None) -> HistoryCollection:
        """Keep files whose first step lies in the years; paths that match no pattern go."""
        kept = self._clocked(self.frame.where(matches(F.col("path"), glob or glob_patterns)))
        first = kept.withColumn("_first", self._instant(F.element_at("times", 1), F.try_element_at("bounds", F.lit(1))))
        year = first.withColumn("_year", C.civil(F.col("calendar"), F.col("_first"))["year"])
        return self._with(year.where(F.col("_year").between(start_year, end_year)).select(*self.frame.columns))

    @staticmethod
    def _clocked(rows: DataFrame) -> DataFrame:
        """With what a file's times need, worked out once a file: microseconds of the unit, and of the reference date."""
        return rows.withColumns({"_unit": C.unit_micros(F.col("units")), "_epoch": C.epoch_micros(F.col("units"), F.col("calendar"))})

    @staticmethod
    def _micros(time: Column) -> Column:
        return C.scaled(time, F.col("_unit"), F.col("_epoch"))

    def _instant(self, time: Column, bound: Column, method: str = "midpoint") -> Column:
        return T.aligned(self._micros(time), self._micros(bound["lo"]), self._micros(bound["hi"]), method)

    @staticmethod
    def valid() -> Column:
        done = F.lit(False)
        for m in history.DONE_MARKERS:
            done = done | F.map_contains_key("attrs", F.lit(m))
        return F.col("error").isNull() & (F.coalesce(F.size("times"), F.lit(0)) > 0) & (F.coalesce(F.size("variables"), F.lit(0)) > 0) & ~F.coalesce(done, F.lit(False))

    def check_validity(self) -> tuple[HistoryCollection, DataFrame]:
        """Valid files, and the rows removed."""
        return self._with(self.frame.where(self.valid())), self.frame.where(~self.valid())

    def pull_metadata(self, check_valid: bool = True, raise_errors: bool = False) -> HistoryCollection:
        """Read metadata once and keep them; files that cannot be read are dropped or raise."""
        pulled = self.frame.cache()
        if raise_errors and (bad := pulled.where(F.col("error").isNotNull()).select("error").first()):
            raise ValueError(bad["error"])
        return self._with(pulled.where(self.valid()) if check_valid else pulled)

    def _first(self) -> Column:
        return C.time_micros(F.element_at("times", 1), F.col("units"), F.col("calendar"))

    def sort_along_time(self) -> DataFrame:
        return self.frame.orderBy(self._first(), "path")

    def placed_along_time(self) -> DataFrame:
        """Files with `place`, their number (from 0) in the order of sort_along_time."""
        return timeline.placed(self.frame, [self._first(), F.col("path")])

    def majority(self) -> HistoryCollection:
        """Files whose set of variables is the only most common one of their group; groups with a tie go."""
        names = F.array_join(F.array_sort(F.transform("variables", lambda v: v["name"])), ",")
        kept = variables.majority_schema(self.grouped().withColumn("_names", names), ["group_id"], "_names")
        return self._with(kept.select(*self.frame.columns))

    def attributes(self) -> DataFrame:
        """(group_id, key, value): of each global attribute the value of the group's last file (by time, then path) that has it."""
        rows = self.grouped().withColumn("_at", F.struct(self._first(), "path"))
        return variables.attributes_last_wins(rows, ["group_id"], "attrs", "_at")

    def time_axes(self) -> DataFrame:
        """(group_id, micros) distinct: each group's time axis."""
        return timeline.time_axis(self.steps(), ["group_id"], "micros")

    def multistep_slices(self) -> DataFrame:
        """(path, slice_start, slice_end, start_step, end_step, whole): the half-open range of a file's steps in each slice that holds any."""
        rows = self.steps().groupBy("path", "slice_start", "slice_end").agg(F.min("step").alias("start_step"), (F.max("step") + 1).alias("end_step"))
        sizes = self.frame.select("path", F.size("times").alias("_n"))
        return rows.join(sizes, "path").withColumn("whole", (F.col("start_step") == 0) & (F.col("end_step") == F.col("_n"))).drop("_n")

    @property
    def is_pulled(self) -> bool:
        """Whether metadata are kept already."""
        return self.frame.storageLevel.useMemory

    def check_pulled(self) -> HistoryCollection:
        return self if self.is_pulled else self.pull_metadata()

    @property
    def input_dir(self) -> str:
        return self.head

    def copy(self) -> HistoryCollection:
        return replace(self)

    def slice_groups(self, slice_size_years: int = 10, start_year: int | None = 0, pattern: str = "*", time_alignment_method: str = "midpoint") -> HistoryCollection:
        if time_alignment_method not in T.ALIGNMENTS:
            raise ValueError(f"time alignment is one of {', '.join(T.ALIGNMENTS)}")
        return replace(self, slice_years=slice_size_years, start_year=start_year, slice_pattern=pattern, alignment=time_alignment_method)

    def grouped(self) -> DataFrame:
        """Files with group_id: directory and name prefix. Tiles (names that do not end in .nc, but in
        .nc.<number>) of all times are one group."""
        tile = ~F.col("path").endswith(".nc")
        name = F.when(tile, P.group_id(F.col("path"), cut=3)).otherwise(P.group_id(F.col("path")))
        return self.frame.withColumns({"group_id": name, "is_tile": tile})

    def steps(self) -> DataFrame:
        """One row a file and step: group_id, micros (the time), instant (aligned), civil fields, slice."""
        none = F.array_repeat(F.lit(None).cast("struct<lo:double,hi:double>"), F.size("times"))
        rows = self._clocked(self.grouped()).withColumn("bounds", F.coalesce("bounds", none)).select("*", F.posexplode(F.arrays_zip("times", "bounds")).alias("step", "_s"))
        time, bound = F.col("_s.times"), F.col("_s.bounds")
        rows = rows.select("path", "group_id", "is_tile", "step", "units", "calendar", "variables", "attrs", self._micros(time).alias("micros"), time.alias("time"), self._instant(time, bound, self.alignment).alias("instant"), self._instant(time, bound).alias("midpoint"))
        rows = rows.withColumn("fields", C.civil(F.col("calendar"), F.col("instant")))
        if self.slice_years is None:
            return rows.withColumns({"slice_start": F.lit(None).cast("int"), "slice_end": F.lit(None).cast("int")})
        cut = timeline.with_slices(rows.where(matches(F.col("group_id"), self.slice_pattern)), ["group_id"], F.col("fields")["year"], self.slice_years, self.start_year)
        other = rows.where(~matches(F.col("group_id"), self.slice_pattern)).withColumns({"slice_start": F.lit(None).cast("int"), "slice_end": F.lit(None).cast("int")})
        return cut.unionByName(other.select(*cut.columns))

    def timestep_delta(self) -> DataFrame:
        """(group_id, delta) in microseconds; tiles of one time count once."""
        return timeline.timestep_delta(self.steps(), ["group_id"], "micros")

    def get_groups(self) -> DataFrame:
        """(group_id, slice_start, slice_end, paths)."""
        return self.steps().groupBy("group_id", "slice_start", "slice_end").agg(F.array_sort(F.collect_set("path")).alias("paths"))

    def get_timestep_delta(self, path: str) -> int | None:
        """Microseconds between the last two times of the path's group; None for a group with one time."""
        group = self.grouped().where(F.col("path") == path).select("group_id").first()
        if group is None:
            raise KeyError(path)
        return timeline.timestep_delta(self.steps().where(F.col("group_id") == group["group_id"]), ["group_id"], "micros").first()["delta"]

    def get_multistep_slices(self, path: str) -> dict[tuple[int | None, int | None], tuple[int, int] | None]:
        """For each slice that holds steps of a file the half-open range of its steps; None if it holds all of them."""
        total = len(self[path]["times"])
        rows = self.steps().where(F.col("path") == path).groupBy("slice_start", "slice_end").agg(F.min("step").alias("a"), (F.max("step") + 1).alias("b"))
        return {(r["slice_start"], r["slice_end"]): None if (r["a"], r["b"]) == (0, total) else (r["a"], r["b"]) for r in rows.collect()}

    # Driver-side views, for interactive use.
    def keys(self) -> list[str]:
        return [r["path"] for r in self.frame.select("path").orderBy("path").collect()]

    def __iter__(self):
        return iter(self.keys())

    def __len__(self) -> int:
        return self.frame.count()

    def __contains__(self, path: str) -> bool:
        return not self.frame.where(F.col("path") == path).isEmpty()

    def __getitem__(self, path: str):
        row = self.frame.where(F.col("path") == path).first()
        if row is None:
            raise KeyError(path)
        return row

    def values(self) -> list:
        return self.frame.orderBy("path").collect()

    def items(self) -> list:
        return [(r["path"], r) for r in self.values()]

