"""Defaults for known models: which files to take, and where their series go."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..operators.catalog import HistoryCollection
from .orders import OrderCollection


@dataclass
class Preset:
    name: str
    include: list[str] = field(default_factory=lambda: ["*.nc"])
    exclude: list[str] = field(default_factory=lambda: ["*.log"])
    path_swaps: list[tuple[str, str]] = field(default_factory=list)
    compression: tuple[int, str] | None = None

    def __post_init__(self) -> None:
        if not (self.name and self.include and all(isinstance(p, str) for p in [*self.include, *self.exclude])):
            raise ValueError("a preset has a name, include globs and exclude globs")

    def history(self, spark: SparkSession, head: str, slice_years: int = 10, start_year: int | None = None, alignment: str = "midpoint") -> HistoryCollection:
        files = HistoryCollection.open(spark, head).include(self.include).exclude(self.exclude).pull_metadata()
        return files.slice_groups(slice_years, start_year, time_alignment_method=alignment)

    def orders(self, files: HistoryCollection, output: str, append_dirs: bool = True, overwrite: bool = False) -> OrderCollection:
        out = OrderCollection.build(files, output)
        if append_dirs:
            out = out.append_timestep_dirs()
        if overwrite:
            out = out.apply_overwrite()
        for old, new in self.path_swaps:
            out = out.apply_path_swap(old, new)
        return out if self.compression is None else out.apply_compression(*self.compression)


def preset(model: str | None) -> Preset:
    """A fresh preset each time, so that changes to its lists stay with the caller."""
    name = "none" if model is None else model.lower()
    # File layouts of the models.
    if name in ("cesm3", "cesm2"):
        return Preset(name, ["*/atm/*", "*/ice/*", "*/lnd/*", "*/glc/*", "*/ocn/*", "*/rof/*", "*.nc"], ["*/proc/tseries/*", "*/rest/*", "*/logs/*", "*.ocean_geometry.nc", "*mom6.ic.*", "*cam.i.*", "*.static.*"], [("/hist/", "/proc/tseries/")], (2, "zlib"))
    if name == "e3sm":
        return Preset(name, ["*.nc"], ["*/proc/tseries/*", "*/rest/*", "*/logs/*"], [("/hist/", "/proc/tseries/")])
    if name == "none":
        return Preset(name)
    raise ValueError(f"no preset for model {model!r}")
