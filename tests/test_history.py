import fnmatch
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import cli
from strandline.functions import calendars, globs, paths, timestamps
from strandline.operators import stitch, timeline, variables
from strandline.operators.catalog import HistoryCollection
from strandline.plans import chunks
from strandline.plans.orders import OrderCollection, is_complete
from strandline.plans.presets import preset
from strandline.plans.stats import collection_stats, order_stats
from strandline.logs import enable_logging
from strandline.sources import cdf, history
from strandline.sources.multifile import MultiFile

from . import cases


def read(path):
    with open(path, "rb") as f:
        return cdf.read(f.read())


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("n_vars", [1, 3])
def test_array_file_round_trip(version, n_vars):
    v = {f"v{i}": cdf.Variable(["t", "x"], np.arange(6, dtype=d).reshape(2, 3)) for i, d in zip(range(n_vars), ("i2", "f8", "i1"))}
    v["fixed"] = cdf.Variable(["x"], np.arange(3, dtype="f4"), {"units": "m", "n": [1.5]})
    got = cdf.read(cdf.write(cdf.Dataset({"t": 2, "x": 3}, v, {"title": "é"}, "t"), version))
    assert got.attrs == {"title": "é"} and got.unlimited == "t" and got.dims == {"t": 2, "x": 3}
    assert all(np.array_equal(got.variables[k].data, x.data) for k, x in v.items()) and got.variables["fixed"].attrs["n"] == [1.5]
    with pytest.raises(ValueError):
        cdf.read(b"PK\x03\x04....")


def test_globs(spark):
    names = ["a.nc", "a.nc.0001", "x/b.nc", "a]x", "]x", "[abc", "abc", "axb", "ayb", "a\nb", "a{1}", "A.nc"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for p in ["*.nc*", "*.nc", "a?b", "a[!x]b", "[]]x", "[abc", "[abc]", "a*", "a{1}", "*/*", "", "[a-b]*"]:
        got = {r.n for r in df.where(globs.matches(F.col("n"), p)).collect()}
        assert got == {n for n in names if fnmatch.fnmatchcase(n, p)}, p
    row = spark.createDataFrame([("aaa.b",)], "s string").select(globs.find_all_indices(F.col("s"), "aa"), globs.find_all_indices(F.col("s"), "zz")).first()
    assert row[0] == [0, 1] and row[1] == []


def test_paths(spark):
    df = spark.createDataFrame([("/h/atm/hist/c.h0.1850-01.nc",), ("/h/plain.nc",)], "p string")
    rows = df.select(paths.group_id(F.col("p")), paths.output_template(paths.group_id(F.col("p")), "/h", "/o")).collect()
    assert rows[0][0] == "/h/atm/hist/c.h0*" and rows[0][1] == "/o/atm/tseries/c.h0" and rows[1][0] is None


def test_calendars(spark):
    units = "days since 1850-01-01"
    for cal, n, want in [("360_day", 15, (1850, 1, 16)), ("360_day", 1455, (1854, 1, 16)), ("360_day", -1, (1849, 12, 30)), ("noleap", 59, (1850, 3, 1)), ("noleap", 365 * 3, (1853, 1, 1)),
                         ("all_leap", 59, (1850, 2, 29)), ("proleptic_gregorian", 0, (1850, 1, 1)), ("standard", 1, (1850, 1, 2)), ("julian", 366, (1851, 1, 2))]:
        micros = calendars.time_micros(F.lit(float(n)), F.lit(units), F.lit(cal))
        f = spark.range(1).select(calendars.civil(F.lit(cal), micros).alias("f")).first().f
        assert (f.year, f.month, f.day) == want, (cal, n)
    hour = calendars.time_micros(F.lit(1.5), F.lit("hours since 2000-02-28 23:00:00"), F.lit("gregorian"))
    f = spark.range(1).select(calendars.civil(F.lit("gregorian"), hour).alias("f")).first().f
    assert (f.year, f.month, f.day, f.hour, f.minute) == (2000, 2, 29, 0, 30)
    switch = spark.range(1).select(calendars.to_days(F.lit("standard"), F.lit(1582), F.lit(10), F.lit(15)) - calendars.to_days(F.lit("standard"), F.lit(1582), F.lit(10), F.lit(4))).first()[0]
    assert switch == 1


def test_year_slices_and_labels(spark):
    assert timestamps.year_slices(10, 1850, 1860) == [(1850, 1860)]
    assert timestamps.year_slices(5, 0, 11) == [(0, 4), (5, 9), (10, 14)]
    with pytest.raises(ValueError):
        timestamps.year_slices(1, 2, 1)
    day = timestamps.DAY
    for delta, kind, label in [(day // 24, "h", "hour_1"), (day // 4, "h", "hour_6"), (day, "d", "day_1"), (30 * day, "m", "month_1"), (365 * day, "y", "year_1"), (1_000_000, "s", "hour_0")]:
        row = spark.range(1).select(timestamps.format_kind(F.lit(delta)), timestamps.step_label(F.lit(delta))).first()
        assert tuple(row) == (kind, label)


def test_end_to_end(spark, tmp_path):
    head, out = str(tmp_path / "in"), str(tmp_path / "out")
    cases.monthly(head, 36)
    hfc = HistoryCollection.open(spark, head).include("*/atm/*").exclude("*.log").pull_metadata()
    assert len(hfc) == 36 and len(hfc.include_years(1851, 1851)) == 12 and len(hfc.include_years(1850, 1852, "*-01.nc")) == 3
    sliced = hfc.slice_groups(2)
    groups = {(r.slice_start, r.slice_end): len(r.paths) for r in sliced.get_groups().collect()}
    assert groups == {(1850, 1851): 24, (1852, 1853): 12}
    orders = OrderCollection.build(sliced, out).append_timestep_dirs().apply_path_swap("/hist/", "/tseries/").add_attrs({"who": "me"})
    rows = {(r.primary_var, r.ts_string): r for r in orders.frame.collect()}
    assert set(rows) == {(v, s) for v in ("VAR0", "VAR1") for s in ("185001-185112", "185201-185212")}
    assert (rows["VAR0", "185201-185212"].ts_start_index, rows["VAR0", "185201-185212"].ts_end_index) == (24, 36)
    assert {r.status for r in orders.execute(raise_errors=True).collect()} == {"written"}
    path = f"{out}/atm/tseries/month_1/case.h0.VAR1.185201-185212.nc"
    ds = read(path)
    assert is_complete(path) and ds.attrs["who"] == "me" and ds.variables["time"].data.tolist() == [(i + 0.5) * 30 for i in range(24, 36)]
    want = [[[cases.value(1, (i + 0.5) * 30, a, b) for b in range(2)] for a in range(3)] for i in range(24, 36)]
    assert np.array_equal(ds.variables["VAR1"].data, want) and "VAR0" not in ds.variables
    with open(path, "wb") as f:
        f.write(b"broken")
    assert sorted(r.status for r in orders.execute().collect()) == ["skipped"] * 3 + ["written"]
    assert {r.status for r in orders.apply_overwrite(var_glob="VAR0").execute().collect()} == {"written", "skipped"}
    assert len(orders.include("*", "VAR0")) == 2 and len(orders.exclude("*nothing*", "VAR0")) == 2 and len(orders.exclude("*", "VAR0", strict_and=True)) == 2
    s = collection_stats(hfc.grouped()).first()
    assert s.n_files == 36 and s.n_groups == 1 and order_stats(orders.frame).first().n_orders == 4


def test_scrambled_names_steps_and_tail(spark, tmp_path):
    head = str(tmp_path / "in")
    for j, k in enumerate([2, 0, 3, 1]):  # names do not follow time; 15 steps each cross years
        t = [(k * 15 + i) * 30 + 15.0 for i in range(15)]
        cases.history_file(f"{head}/c.h1.{j:03d}.nc", t, [[x - 15, x + 15] for x in t], n_vars=1)
    hfc = HistoryCollection.open(spark, head).slice_groups(1, start_year=1850)
    orders = OrderCollection.build(hfc, str(tmp_path / "out"))
    rows = sorted(orders.frame.collect(), key=lambda r: r.slice_start)
    assert [(r.ts_start_index, r.ts_end_index) for r in rows] == [(12 * i, 12 * i + 12) for i in range(5)]
    orders.execute(raise_errors=True)
    out = read(f"{tmp_path}/out/c.h1.VAR0.185401-185412.nc")
    assert out.variables["time"].data.tolist() == [(48 + i) * 30 + 15.0 for i in range(12)]


def test_step_ranges_and_several_files(spark, tmp_path):
    head = str(tmp_path / "in")
    for j in range(2):
        t = [(j * 15 + i) * 30 + 15.0 for i in range(15)]
        cases.history_file(f"{head}/c.h1.{j:03d}.nc", t, n_vars=2)
    hfc = HistoryCollection.open(spark, head).slice_groups(1, start_year=1850)
    second = f"{head}/c.h1.001.nc"
    assert hfc.get_multistep_slices(second) == {(1851, 1851): (0, 9), (1852, 1852): (9, 15)}
    assert HistoryCollection.open(spark, head).get_multistep_slices(second) == {(None, None): None}
    assert hfc.get_timestep_delta(second) == 30 * timestamps.DAY
    with pytest.raises(KeyError):
        hfc.get_timestep_delta("none")
    with MultiFile.open([second, f"{head}/c.h1.000.nc"]) as m:
        assert m.is_time_consistent() and not m.is_fragmented() and m.shape("VAR1") == (30, 3, 2) and second in m and len(m) == 2
        assert m.time_values().tolist() == [i * 30 + 15.0 for i in range(30)]
        want = [[[cases.value(1, i * 30 + 15.0, a, b) for b in range(2)] for a in range(3)] for i in range(13, 17)]
        assert np.array_equal(m.values("VAR1", 13, 17), want) and m.dims("VAR0") == ["time", "lat", "lon"] and m.attrs()["source"] == "test"
    with open(second, "r+b") as f:
        f.truncate(os.path.getsize(second) - 8)
    with pytest.raises(ValueError):
        cdf.load(second)
    log = enable_logging(True, str(tmp_path / "log.txt"))
    log.info("seen")
    enable_logging()
    assert "seen" in (tmp_path / "log.txt").read_text()


def test_tiles_descending_and_missing(spark, tmp_path):
    head = str(tmp_path / "in")
    for step in range(2):
        t = [180.0 * (step + 1)]
        for tile, (lats, lat0) in enumerate([((0.0, 1.0), 0), ((3.0, 2.0), 2)]):
            cases.history_file(f"{head}/c.h2.{step:04d}.nc.{tile:04d}", t, n_vars=1, lats=lats, lons=(0.0, 1.0), lat0=lat0, coords=True)
    hfc = HistoryCollection.open(spark, head)
    assert [r.delta for r in hfc.timestep_delta().collect()] == [180 * timestamps.DAY]
    res = OrderCollection.build(hfc, str(tmp_path / "out")).execute(raise_errors=True).collect()
    ds = read(res[0].out_path)
    assert ds.variables["lat"].data.tolist() == [0, 1, 2, 3]
    got = ds.variables["VAR0"].data[0, :, 0]
    assert got.tolist() == [cases.value(0, 180.0, a, 0) for a in (0, 1, 3, 2)]  # the second tile's latitudes descend
    tiles = spark.createDataFrame([("g", 0.0, {"y": [0.0, 1.0], "x": [0.0]}, [1.0, 2.0]), ("g", 0.0, {"y": [3.0, 2.0], "x": [1.0]}, [4.0, 3.0])], "g string, time double, coords map<string,array<double>>, data array<double>")
    pasted = stitch.paste_tiles(tiles, ["g"], ["y", "x"]).first()
    assert pasted.shape == [4, 2] and pasted.data == [1.0, None, 2.0, None, None, 3.0, None, 4.0]


def test_odd_files(spark, tmp_path):
    head = str(tmp_path / "in")
    cases.history_file(f"{head}/c.h0.1.nc", [1.0], time_name="Time", n_vars=1)
    cases.history_file(f"{head}/c.h0.2.nc", [2.0], time_name="nottime", n_vars=1)
    cases.history_file(f"{head}/c.h3.1.nc", [1.0], n_vars=0)
    cases.history_file(f"{head}/c.h4.1.nc", [1.0], attrs={"strandline_version": "1"})
    with open(f"{head}/c.h5.1.nc", "wb") as f:
        f.write(b"junk")
    hfc = HistoryCollection.open(spark, head)
    valid, removed = hfc.check_validity()
    assert sorted(os.path.basename(p) for p in valid) == ["c.h0.1.nc", "c.h3.1.nc"] and removed.count() == 3
    with pytest.raises(ValueError):
        hfc.pull_metadata(raise_errors=True)
    orders = OrderCollection.build(valid, str(tmp_path / "out"))
    assert sorted(r.primary_var for r in orders) == ["VAR0", "auxiliary"]
    assert all(r.error is None for r in orders.execute().collect())
    with pytest.raises(FileNotFoundError):
        HistoryCollection.open(spark, head, "*.none")
    assert history.find_files(spark, head, "*h3*").count() == 1
    assert history.facts(spark, head, "*.h0.1.nc", ["VAR0"]).first().data == [cases.value(0, 1.0, a, b) for a in range(3) for b in range(2)]


def test_cli(spark, tmp_path, capsys):
    head = str(tmp_path / "in")
    cases.monthly(head, 3)
    assert cli.main([head, "-d", "-m", "E3SM"]) == 0
    assert "2 time series" in capsys.readouterr().out
    assert cli.main([head, "-o", str(tmp_path / "o"), "--exclude", "*-03.nc", "--append", "-hc", "3", "-tc", "1"]) == 0
    assert spark.conf.get("spark.sql.files.minPartitionNum") == "3"
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert os.path.exists(f"{tmp_path}/o/atm/hist/month_1/case.h0.VAR0.185001-185002.nc")
    with pytest.raises(ValueError):
        preset("other")
    a = preset("cesm3")
    a.include.append("x")
    assert "x" not in preset("cesm3").include


def test_variables_and_chunks(spark):
    df = spark.createDataFrame([("T", ["time", "lat"], [10, 3]), ("time_bnds", ["time", "nbnd"], [10, 2]), ("date", ["time"], [10]), ("name", ["time", "chars"], [10, 8]), ("big", ["time", "x"], [100, 1 << 20])], "n string, d array<string>, s array<int>")
    rows = {r.n: r for r in df.select("n", variables.is_secondary(F.col("n"), F.col("d")).alias("sec"), chunks.time_chunk(F.col("s"), 8).alias("c")).collect()}
    assert {n for n, r in rows.items() if r.sec} == {"time_bnds", "date", "name"}
    assert rows["T"].c == 10 and rows["big"].c == 1
    votes = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], "g string, f string")
    assert {tuple(r) for r in variables.majority_schema(votes, ["g"], "f").distinct().collect()} == {("a", "x")}
    attrs = spark.createDataFrame([("g", 1, {"a": "1", "b": "1"}), ("g", 2, {"a": "2"})], "g string, o int, m map<string,string>")
    assert {(r.key, r.value) for r in variables.attributes_last_wins(attrs, ["g"], "m", "o").collect()} == {("a", "2"), ("b", "1")}
    one = spark.createDataFrame([("g", 5)], "g string, t int")
    assert timeline.timestep_delta(one, ["g"], "t").first().delta is None
