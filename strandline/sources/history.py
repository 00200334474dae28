"""History files as DataFrames: the path scan, the catalog (one row a file) and facts (one row a time step).

Files come through Spark's binaryFile source, so they may lie in any store; a row's content is parsed by
the task that read it. Only the catalog's metadata and the facts asked for leave that task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.globs import matches
from ..operators.variables import BOUNDS_NAMES, is_secondary
from . import cdf

MARKER = "strandline_version"
#: Global attributes that say a file is an output already. Append the marker of another tool to have its
#: outputs recognised too.
DONE_MARKERS = [MARKER]

CATALOG = """path string, attrs map<string,string>, time_name string, bounds_name string, units string, calendar string,
 times array<double>, bounds array<struct<lo:double,hi:double>>,
 variables array<struct<name:string,dims:array<string>,shape:array<int>,dtype:string,itemsize:int,secondary:boolean>>,
 dim_bounds map<string,array<double>>, error string"""
FACTS = "path string, variable string, time double, step int, dims array<string>, shape array<int>, dtype string, data array<double>"


def find_files(spark: SparkSession, head: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files below `head` whose name matches the glob, sorted by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(head)
    out = files.select(P.strip_scheme(F.col("path")).alias("path"), "length")
    return out.where(matches(P.basename(F.col("path")), pattern)).orderBy("path")


def _contents(spark: SparkSession, head: str, pattern: str) -> DataFrame:
    """(path, content). Content is null where the path is on a mounted file system: tasks map such a file and read
    the bytes that they need, so a catalog touches headers and time axes only. Other stores give whole files."""
    target = spark._jvm.org.apache.hadoop.fs.Path(head)
    mounted = target.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(head)
    content = F.lit(None).cast("binary") if mounted else F.col("content")
    out = files.select(P.strip_scheme(F.col("path")).alias("path"), content.alias("content"))
    return out.where(matches(P.basename(F.col("path")), pattern))


def _dataset(path: str, content: bytes | None) -> cdf.Dataset:
    return cdf.load(path) if content is None else cdf.read(content)


def metadata(path: str, content: bytes | None = None) -> dict:
    """One catalog row; what cannot be read gives a row with `error`."""
    row = dict.fromkeys([c.split()[0] for c in ("path", "attrs", "time_name", "bounds_name", "units", "calendar", "times", "bounds", "variables", "dim_bounds", "error")])
    row["path"] = path
    try:
        ds = _dataset(path, content)
        names = list(ds.variables)
        time = next((n for n in reversed(names) if n.lower() == "time"), None)
        bound = next((n for n in reversed(names) if n.lower() in BOUNDS_NAMES), None)
        if time is None:
            raise ValueError("no time variable")
        t = ds.variables[time]
        axis = np.atleast_1d(np.squeeze(t.data)).astype(float)
        row |= {"attrs": {k: str(v) for k, v in ds.attrs.items()}, "time_name": time, "bounds_name": bound, "units": t.attrs["units"], "calendar": t.attrs["calendar"], "times": axis.tolist()}
        if bound is not None:
            pairs = ds.variables[bound].data.astype(float).reshape(len(axis), 2)
            row["bounds"] = [{"lo": a, "hi": b} for a, b in pairs.tolist()]
        row["variables"] = [
            {"name": n, "dims": v.dims, "shape": [int(x) for x in v.data.shape], "dtype": v.data.dtype.newbyteorder("=").str.lstrip("<>|="), "itemsize": v.data.dtype.itemsize,
             "secondary": None}
            for n, v in ds.variables.items()
        ]
        coords = {d: ds.variables[d].data.astype(float).ravel() for d in ds.dims if d in ds.variables and ds.variables[d].data.dtype.kind != "S"}
        row["dim_bounds"] = {d: [float(x.min()), float(x.max())] if x.size > 1 else x.tolist() for d, x in coords.items()}
    except (OSError, ValueError, KeyError, IndexError) as e:
        row["error"] = f"{type(e).__name__}: {e}: {path}"
    return row


def catalog(spark: SparkSession, head: str, pattern: str = "*.nc*") -> DataFrame:
    """One row for each file; raises FileNotFoundError if there is none."""
    files = _contents(spark, head, pattern)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no file below {head} matches {pattern}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for p, c in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([metadata(p, c)])

    return classified(files.mapInPandas(run, CATALOG))


def classified(files: DataFrame) -> DataFrame:
    """Catalog rows with `secondary` of each variable set, time being the first dimension of the time variable."""
    own = F.get(F.filter("variables", lambda v: v["name"] == F.col("time_name")), F.lit(0))["dims"]
    tdim = F.coalesce(F.get(own, F.lit(0)), F.col("time_name"))
    return files.withColumn("variables", F.transform("variables", lambda v: v.withField("secondary", is_secondary(v["name"], v["dims"], tdim))))


def facts(spark: SparkSession, head: str, pattern: str = "*.nc*", variables: list[str] | None = None) -> DataFrame:
    """One row for each file, variable and time step; variables without time have one row with a null time."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for p, c in zip(pdf["path"], pdf["content"]):
                try:
                    ds = _dataset(p, c)
                except (OSError, ValueError):
                    continue
                time = next((n for n in ds.variables if n.lower() == "time"), None)
                axis = np.atleast_1d(ds.variables[time].data).astype(float).ravel() if time else np.zeros(0)
                rows = []
                for n, v in ds.variables.items():
                    if (variables is not None and n not in variables) or v.data.dtype.kind == "S":
                        continue
                    timed = time is not None and ds.variables[time].dims and v.dims[:1] == ds.variables[time].dims[:1]
                    for i in range(len(axis)) if timed else [0]:
                        cell = v.data[i] if timed else v.data
                        rows.append((p, n, float(axis[i]) if timed else None, i, v.dims, [int(x) for x in v.data.shape], v.data.dtype.newbyteorder("=").str.lstrip("<>|="), np.asarray(cell, float).ravel()))
                yield pd.DataFrame(rows, columns=["path", "variable", "time", "step", "dims", "shape", "dtype", "data"])

    return _contents(spark, head, pattern).mapInPandas(run, FACTS)
