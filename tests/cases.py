"""History files for tests, with distinct values for each variable, time and cell."""

from __future__ import annotations

import os

import numpy as np

from strandline.sources import cdf


def value(var: int, time: float, lat: int, lon: int) -> float:
    return var * 1e6 + time * 100 + lat * 10 + lon


def history_file(path, times, bounds=None, n_vars=2, lats=(0.0, 1.0, 2.0), lons=(0.0, 1.0), lat0=0, lon0=0, time_name="time", coords=False, attrs=None, calendar="360_day"):
    times = np.asarray(times, float)
    dims = {"time": len(times), "bnds": 2, "lat": len(lats), "lon": len(lons)}
    units = {"units": "days since 1850-01-01", "calendar": calendar}
    v = {time_name: cdf.Variable(["time"], times, units)}
    if bounds is not None:
        v["time_bounds"] = cdf.Variable(["time", "bnds"], np.asarray(bounds, float), units)
    if coords:
        v["lat"], v["lon"] = cdf.Variable(["lat"], np.asarray(lats, float)), cdf.Variable(["lon"], np.asarray(lons, float))
    for i in range(n_vars):
        data = np.array([[[value(i, t, lat0 + a, lon0 + b) for b in range(len(lons))] for a in range(len(lats))] for t in times])
        v[f"VAR{i}"] = cdf.Variable(["time", "lat", "lon"], data, {"units": "K"})
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(cdf.write(cdf.Dataset(dims, v, {"source": "test", **(attrs or {})}, "time")))


def monthly(head, n=36, prefix="case.h0", **kw):
    for i in range(n):
        history_file(f"{head}/atm/hist/{prefix}.{1850 + i // 12:04d}-{i % 12 + 1:02d}.nc", [(i + 0.5) * 30], [[30 * i, 30 * (i + 1)]], **kw)
