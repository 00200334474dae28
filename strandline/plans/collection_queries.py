"""Registered queries that run the collections and orders themselves, over catalogs made of the `orders` table.

A "file" holds the order dates of one priority in some months: dates are its time axis, priorities are groups. Some queries take
the catalog as a DataFrame; those at the end write real array files, scan them and turn them into series.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendars as C
from ..functions import paths as P
from ..functions import timestamps as T
from ..operators import stitch, variables
from ..operators.catalog import HistoryCollection
from ..session import scratch, ship, table
from ..sources import cdf, history
from . import chunks, stats
from .orders import OrderCollection, out_path
from .registry import query

UNITS = "days since 1970-01-01"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p, day, y, m): distinct dates of each priority."""
    date = F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), date.alias("date")).distinct()
    return rows.select("p", F.datediff("date", F.lit("1970-01-01")).alias("day"), F.year("date").alias("y"), F.month("date").alias("m"))


def _group(p: Column) -> Column:
    return F.concat(F.lit("/"), F.lower(F.substring(p, 3, 40)), F.lit("/hist/case.h"), F.substring(p, 1, 1))


def files(spark: SparkSession, sf_dir: str, months: int = 1) -> HistoryCollection:
    """A catalog with files of `months` months below /in. Files of 5-LOW have no bounds and secondary variables only."""
    number = F.floor((F.col("y") * 12 + F.col("m") - 1) / months).cast("long").alias("q")
    rows = _days(spark, sf_dir).select("p", "day", number).groupBy("p", "q").agg(F.array_sort(F.collect_set(F.col("day").cast("double"))).alias("times"))
    low, n = F.col("p") == "5-LOW", F.size("times")
    variable = lambda name, dims, shape, size: F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, dims)).alias("dims"), F.array(*shape).alias("shape"), F.lit(f"f{size}").alias("dtype"), F.lit(size).alias("itemsize"), F.lit(None).cast("boolean").alias("secondary"))
    time, bound = variable("time", ["time"], [n], 8), variable("Time_Bnds", ["time", "nbnd"], [n, F.lit(2)], 8)
    price, cust = variable("o_totalprice", ["time", "lat", "lon"], [n, F.lit(4), F.lit(6)], 8), variable("o_custkey", ["time", "lat"], [n, F.lit(4)], 4)
    rows = rows.select(
        F.concat(F.lit("/in"), _group(F.col("p")), F.lit("."), F.lpad(F.col("q").cast("string"), 5, "0"), F.lit(".nc")).alias("path"),
        F.create_map(F.lit("source"), F.lit("orders"), F.lit("last"), F.col("q").cast("string"), F.concat(F.lit("k"), (F.col("q") % 3).cast("string")), F.col("q").cast("string")).alias("attrs"),
        F.lit("time").alias("time_name"), F.when(~low, F.lit("Time_Bnds")).alias("bounds_name"), F.lit(UNITS).alias("units"), F.lit("standard").alias("calendar"), "times",
        F.when(~low, F.transform("times", lambda t: F.struct(t.alias("lo"), (t + 1).alias("hi")))).alias("bounds"),
        F.when(low, F.array(time, bound)).when(F.col("q") % 5 == 0, F.array(time, bound, price)).otherwise(F.array(time, bound, price, cust)).alias("variables"),
        F.create_map(F.lit("lat"), F.array(F.lit(0.0), F.lit(3.0))).alias("dim_bounds"), F.lit(None).cast("string").alias("error"),
    )
    return HistoryCollection(history.classified(rows), "/in")


def _files_sql(months: int = 1) -> str:
    """CTEs d (dates), f (files: g without head, path, q, n, d0, d1)."""
    return f"""WITH d AS (SELECT DISTINCT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS day FROM orders),
  e AS (SELECT p, day, (year(day) * 12 + month(day) - 1) // {months} AS q, '/' || lower(substr(p, 3)) || '/hist/case.h' || substr(p, 1, 1) AS g FROM d),
  f AS (SELECT p, g, q, '/in' || g || '.' || lpad(CAST(q AS VARCHAR), 5, '0') || '.nc' AS path, count(*) AS n, min(day) AS d0, max(day) AS d1 FROM e GROUP BY p, g, q)"""


def _sliced_sql(months: int, size: int) -> str:
    """Adds b (years of a group) and t (steps with their slice)."""
    start = f"y0 + {size} * ((year(day) - y0) // {size})"
    return _files_sql(months) + f""",
  b AS (SELECT g AS bg, min(year(day)) AS y0, max(year(day)) AS y1 FROM e GROUP BY g),
  t AS (SELECT e.*, '/in' || g || '.' || lpad(CAST(q AS VARCHAR), 5, '0') || '.nc' AS path, CAST(CASE WHEN {size} >= y1 - y0 THEN y0 ELSE {start} END AS INTEGER) AS s0,
    CAST(CASE WHEN {size} >= y1 - y0 THEN y1 ELSE {start} + {size - 1} END AS INTEGER) AS s1 FROM e JOIN b ON g = bg)"""


# -- collections

@query(_files_sql() + " SELECT path, n FROM f WHERE year(d0) BETWEEN 1996 AND 1998 AND path GLOB '*[02468].nc'")
def include_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).include_years(1996, 1998, "*[02468].nc").frame.select("path", F.size("times").cast("long").alias("n"))


@query(_files_sql() + " SELECT path, path GLOB '*/high/*' AS by_alias FROM f WHERE path GLOB '*/high/*' OR (path GLOB '*7.nc' AND NOT path GLOB '*/low/*')")
def include_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    import warnings

    hfc = files(spark, sf_dir)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        high, other = hfc.include_patterns(["*/high/*"]), hfc.include("*7.nc").exclude_patterns(["*/high/*", "*/low/*"])
    return high.frame.select("path", F.lit(True).alias("by_alias")).unionByName(other.frame.select("path", F.lit(False).alias("by_alias")))


@query(_files_sql() + " SELECT path, q % 7 NOT IN (3, 5, 6) AS valid FROM f")
def validity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    hfc = files(spark, sf_dir)
    q = F.regexp_extract("path", r"(\d+)\.nc$", 1).cast("long") % 7
    spoilt = hfc.frame.withColumns({
        "attrs": F.when(q == 3, F.map_concat("attrs", F.create_map(F.lit(history.MARKER), F.lit("1")))).otherwise(F.col("attrs")),
        "error": F.when(q == 5, F.lit("OSError: cut short")), "times": F.when(q == 6, F.slice("times", 1, 0)).otherwise(F.col("times")),
    })
    valid, removed = hfc._with(spoilt).check_validity()
    return valid.frame.select("path", F.lit(True).alias("valid")).unionByName(removed.select("path", F.lit(False).alias("valid")))


@query(_files_sql() + " SELECT path, row_number() OVER (ORDER BY d0, path) - 1 AS place FROM f")
def sort_along_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).placed_along_time().select("path", "place")


@query(_sliced_sql(1, 2) + " SELECT '/in' || g || '*' AS group_id, s0 AS slice_start, s1 AS slice_end, count(DISTINCT path) AS n, min(path) AS first_path, max(path) AS last_path FROM t GROUP BY ALL")
def get_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = files(spark, sf_dir).slice_groups(2, start_year=None).get_groups()
    return groups.select("group_id", "slice_start", "slice_end", F.size("paths").cast("long").alias("n"), F.get("paths", F.lit(0)).alias("first_path"), F.element_at("paths", -1).alias("last_path"))


@query(_files_sql() + """, k AS (SELECT g, '/' || lower(substr(p, 3)) || '/' AS part, year(day) AS y FROM e), r AS (SELECT part, y - y % 5 AS s0, y - y % 5 + 4 AS s1, count(*) AS n FROM k WHERE part IN ('/urgent/', '/high/') GROUP BY ALL)
  SELECT part, CAST(s0 AS INTEGER) AS slice_start, CAST(s1 AS INTEGER) AS slice_end, n FROM r UNION ALL SELECT part, -1, -1, count(*) FROM k WHERE part NOT IN ('/urgent/', '/high/') GROUP BY part""")
def slice_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that match the pattern are cut into slices from year 0, the others pass."""
    steps = files(spark, sf_dir).slice_groups(5, start_year=0, pattern="*h[12]*").steps()
    part = F.regexp_extract("group_id", r"^/in(/[^/]*/)", 1).alias("part")
    own = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("slice_start", "slice_end")]
    return steps.groupBy(part, *own).agg(F.count("*").alias("n"))


@query(_sliced_sql(18, 1) + """, i AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY day) - 1 AS step, count(*) OVER (PARTITION BY path) AS n FROM t)
  SELECT path, s0 AS slice_start, s1 AS slice_end, CAST(min(step) AS INTEGER) AS start_step, CAST(max(step) + 1 AS INTEGER) AS end_step, min(step) = 0 AND max(step) + 1 = any_value(n) AS whole FROM i GROUP BY path, s0, s1""")
def multistep_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir, 18).slice_groups(1, start_year=None).multistep_slices()


_DELTA = "(SELECT g AS dg, max(day) - max(CASE WHEN day < mx THEN day END) AS delta FROM (SELECT g, day, max(day) OVER (PARTITION BY g) AS mx FROM e) GROUP BY g)"


_STAMPS = " ".join(f"{w} strftime(d0, '{f}') || '-' || strftime(d1, '{f}')" for w, f in (("CASE WHEN delta < 28 THEN", "%Y%m%d"), ("WHEN delta / 30.0 < 12 THEN", "%Y%m"), ("ELSE", "%Y"))) + " END"


@query(_files_sql() + f" SELECT '/in' || dg || '*' AS group_id, delta * 86400000000 AS delta FROM {_DELTA}")
def group_timestep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).timestep_delta()


@query(_files_sql() + " SELECT '/in' || g || '*' AS group_id, (2440588 + date_diff('day', DATE '1970-01-01', day)) * 86400000000 AS micros FROM e")
def time_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir, 7).time_axes()


@query(_files_sql() + """, v AS (SELECT *, CASE WHEN p = '5-LOW' THEN 0 WHEN q % 5 = 0 THEN 1 ELSE 2 END AS kind FROM f), c AS (SELECT g, kind, count(*) AS n FROM v GROUP BY ALL),
  w AS (SELECT g, kind FROM c QUALIFY n = max(n) OVER (PARTITION BY g) AND count(*) OVER (PARTITION BY g, n) = 1) SELECT v.path FROM v JOIN w ON v.g = w.g AND v.kind = w.kind""")
def collection_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).majority().frame.select("path")


@query(_files_sql() + """, a AS (SELECT g, q, d0, path, unnest(['source', 'last', 'k' || (q % 3)]) AS key, unnest(['orders', CAST(q AS VARCHAR), CAST(q AS VARCHAR)]) AS value FROM f)
  SELECT '/in' || g || '*' AS group_id, key, arg_max(value, q) AS value FROM a GROUP BY g, key""")
def collection_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).attributes()


@query(_files_sql() + """, s AS (SELECT g, n * 8 + n * 16 + CASE WHEN p = '5-LOW' THEN 0 WHEN q % 5 = 0 THEN n * 192 ELSE n * 208 END AS bytes, CASE WHEN p = '5-LOW' THEN 2 WHEN q % 5 = 0 THEN 3 ELSE 4 END AS vars FROM f),
  r AS (SELECT '/in' || g || '*' AS g, count(*) AS n, sum(bytes) AS b, max(vars) AS v FROM s GROUP BY g)
  SELECT CAST(sum(n) AS BIGINT) AS n_files, count(*) AS n_groups, CAST(sum(b) AS BIGINT) AS bytes, (SELECT g FROM r ORDER BY v DESC, g LIMIT 1) AS most_variables, (SELECT g FROM r ORDER BY n DESC, g LIMIT 1) AS most_files FROM r""")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.collection_stats(files(spark, sf_dir).grouped())


@query("""WITH d AS (SELECT DISTINCT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS day FROM orders)
  SELECT '/in/tiles/case.h' || substr(p, 1, 1) || '*' AS group_id, count(DISTINCT year(day)) * 4 AS n FROM d GROUP BY p""")
def tile_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles (names that end in .nc.<number>) of all times are one group."""
    years = _days(spark, sf_dir).select("p", "y").distinct()
    path = F.concat(F.lit("/in/tiles/case.h"), F.substring("p", 1, 1), F.lit("."), F.col("y").cast("string"), F.lit(".nc."), F.lpad(F.col("i").cast("string"), 4, "0"))
    rows = years.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(path.alias("path"))
    return HistoryCollection(rows, "/in").grouped().where("is_tile").groupBy("group_id").agg(F.count("*").alias("n"))


# -- orders

_built: dict[tuple[str, str], OrderCollection] = {}


def _orders(spark: SparkSession, sf_dir: str) -> OrderCollection:
    """Orders of two-year slices; planned once for each session and input, as collections never change."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = OrderCollection.build(files(spark, sf_dir).slice_groups(2, start_year=None), "/out")
    return _built[key]


_KEY = ["group_id", "slice_start", "slice_end", "primary_var"]
_PLAN = _sliced_sql(1, 2) + f""",
  s AS (SELECT g, p, s0, s1, count(*) AS n, count(DISTINCT path) AS n_files, min(path) AS first_path, min(day) AS d0, max(day) AS d1 FROM t GROUP BY ALL),
  i AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY g ORDER BY d0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i0 FROM s),
  x AS (SELECT i.*, delta, (SELECT f.n FROM f WHERE f.path = first_path) AS n1, (SELECT f.q FROM f WHERE f.path = first_path) AS q1 FROM i JOIN {_DELTA} ON g = dg),
  o AS (SELECT '/in' || g || '*' AS group_id, g, s0 AS slice_start, s1 AS slice_end, v.primary_var, '/out' || g AS ts_path_template, {_STAMPS} AS ts_string,
    CAST(i0 AS BIGINT) AS ts_start_index, CAST(i0 + n AS BIGINT) AS ts_end_index, n_files, delta, n1 * n_files * v.size AS n_bytes
    FROM x, (VALUES ('o_totalprice', 192, 1), ('o_custkey', 16, 2), ('auxiliary', 0, 0)) v(primary_var, size, least_kind)
    WHERE CASE WHEN p = '5-LOW' THEN v.least_kind = 0 WHEN q1 % 5 = 0 THEN v.least_kind = 1 ELSE v.least_kind > 0 END)"""


@query(_PLAN + " SELECT group_id, slice_start, slice_end, primary_var, ts_path_template, ts_string, ts_start_index, ts_end_index, n_files FROM o")
def order_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).frame.select(*_KEY, "ts_path_template", "ts_string", "ts_start_index", "ts_end_index", F.size("hf_paths").cast("long").alias("n_files"))


@query(_PLAN + " SELECT group_id, slice_start, slice_end, primary_var FROM o WHERE (group_id GLOB '*/urgent/*' OR group_id GLOB '*/low/*') AND primary_var GLOB '*a*'")
def order_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).include(["*/urgent/*.nc", "*/low/*.nc"], "*a*").frame.select(*_KEY)


@query(_PLAN + " SELECT group_id, slice_start, slice_end, primary_var FROM o WHERE NOT (group_id GLOB '*/low/*' OR primary_var GLOB '*cust*')")
def order_exclude_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).exclude("*/low/*", "*cust*").frame.select(*_KEY)


@query(_PLAN + " SELECT group_id, slice_start, slice_end, primary_var FROM o WHERE NOT (group_id GLOB '*/high/*' AND primary_var GLOB '*cust*')")
def order_exclude_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).exclude("*/high/*", "*cust*", strict_and=True).frame.select(*_KEY)


@query(_PLAN + " SELECT group_id, slice_start, slice_end, primary_var, CASE WHEN group_id GLOB '*/urgent/*' AND primary_var GLOB '*price' THEN 2 ELSE -1 END AS complevel, CASE WHEN group_id GLOB '*/urgent/*' AND primary_var GLOB '*price' THEN 'zlib' ELSE 'none' END AS compression, FALSE AS overwrite FROM o")
def add_args_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).add_args("*/urgent/*", "*price", level=2, alg="zlib").frame.select(*_KEY, F.coalesce("complevel", F.lit(-1)).alias("complevel"), F.coalesce("compression", F.lit("none")).alias("compression"), "overwrite")


@query(_PLAN + " SELECT group_id, slice_start, slice_end, primary_var, CASE WHEN group_id GLOB '*/low/*' THEN 4 ELSE -1 END AS complevel, primary_var GLOB '*cust*' AND NOT group_id GLOB '*/high/*' AS overwrite FROM o")
def order_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).apply_overwrite(var_glob="*cust*").remove_overwrite("*/high/*").apply_compression(4, "zlib", "*/low/*").frame.select(*_KEY, F.coalesce("complevel", F.lit(-1)).alias("complevel"), "overwrite")


@query(_PLAN + " SELECT group_id, slice_start, slice_end, primary_var, CASE WHEN group_id GLOB '*/medium/*' THEN replace(ts_path_template, '/hist/', '/proc/tseries/') ELSE ts_path_template END AS template FROM o")
def replace_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).apply_path_swap("/hist/", "/proc/tseries/", "*/medium/*").frame.select(*_KEY, F.col("ts_path_template").alias("template"))


@query(_PLAN + """, l AS (SELECT *, round_even(delta / 30, 0) AS months, round_even(round_even(delta / 30, 0) / 12, 0) AS years FROM o)
  SELECT group_id, slice_start, slice_end, primary_var, CASE WHEN primary_var GLOB '*price' THEN regexp_extract(ts_path_template, '^(.*)/', 1) || '/' ||
    CASE WHEN delta < 28 THEN 'day_' || delta WHEN months < 12 THEN 'month_' || CAST(months AS BIGINT) ELSE 'year_' || CAST(years AS BIGINT) END || '/' || regexp_extract(ts_path_template, '([^/]*)$', 1) ELSE ts_path_template END AS template FROM l""")
def timestep_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).append_timestep_dirs("*price").frame.select(*_KEY, F.col("ts_path_template").alias("template"))


@query(_PLAN + " SELECT group_id, slice_start, slice_end, primary_var, 'me' AS who FROM o")
def add_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).add_attrs({"x": "y"}).add_attrs({"who": "me"}).frame.select(*_KEY, F.when(F.size("append_attrs") == 1, F.col("append_attrs")["who"]).alias("who"))


@query(_PLAN + " SELECT group_id, slice_start, slice_end, primary_var FROM o WHERE primary_var = 'auxiliary'")
def auxiliary_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).include(var_glob="auxiliary").frame.select(*_KEY)


@query(_PLAN + " SELECT group_id, slice_start, slice_end, primary_var, 'time,Time_Bnds' AS secondary FROM o")
def secondary_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secondary variables go with each order of their group."""
    return _orders(spark, sf_dir).frame.select(*_KEY, F.array_join("secondary_vars", ",").alias("secondary"))


@query(_PLAN + """ SELECT count(*) AS n_orders, count(*) FILTER (primary_var = 'auxiliary') AS n_auxiliary, CAST(max(n_files) AS INTEGER) AS most_files, CAST(max(n_bytes) FILTER (primary_var <> 'auxiliary') AS BIGINT) AS largest_bytes,
  (SELECT ts_path_template || '.' || primary_var || '.' || ts_string FROM o WHERE primary_var <> 'auxiliary' ORDER BY n_bytes DESC, ts_path_template, primary_var, ts_string LIMIT 1) AS largest FROM o""")
def order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.order_stats(_orders(spark, sf_dir).frame)


@query(_PLAN + """, r AS (SELECT *, row_number() OVER (PARTITION BY group_id, slice_start ORDER BY primary_var) - 1 AS i FROM o)
  SELECT group_id, slice_start, slice_end, CAST(i AS INTEGER) AS batch, ts_path_template || '.' || primary_var || '.' || ts_string || '.nc' AS out_path, n_files FROM r""")
def order_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of one order each, and their outputs."""
    rows = _orders(spark, sf_dir).batches(optimize_batch_n=1)
    return rows.select("group_id", "slice_start", "slice_end", "batch", F.explode("orders.out_path").alias("out_path"), F.size("hf_paths").cast("long").alias("n_files"))


@query(_PLAN + " SELECT group_id, slice_start, slice_end, primary_var FROM o WHERE NOT (primary_var = 'o_custkey' AND slice_start < 1999) OR group_id GLOB '*/high/*'")
def skip_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    done = orders.frame.where("primary_var = 'o_custkey' AND slice_start < 1999").select(out_path().alias("out_path"))
    return orders.apply_overwrite("*/high/*").remaining(done).frame.select(*_KEY)


# -- times, variables, layouts

_STARTS = {"noleap": "[0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]", "all_leap": "[0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335]"}


def _civil_sql(calendar: str, year: str, day: str, starts: str) -> str:
    return f"""SELECT p_partkey, '{calendar}' AS calendar, {year} AS year, len(list_filter({starts}, lambda x: x <= {day})) AS month, {day} - list_max(list_filter({starts}, lambda x: x <= {day})) + 1 AS day FROM k"""


@query("WITH k AS (SELECT p_partkey, (p_partkey * 97) % 150000 AS n, n // 1461 AS c, n % 1461 AS r FROM part) "
       + " UNION ALL ".join([
           "SELECT p_partkey, '360_day' AS calendar, 1852 + n // 360 AS year, 1 + (n % 360) // 30 AS month, 1 + n % 30 AS day FROM k",
           _civil_sql("noleap", "1852 + n // 365", "n % 365", _STARTS["noleap"]), _civil_sql("all_leap", "1852 + n // 366", "n % 366", _STARTS["all_leap"]),
           _civil_sql("julian", "1852 + 4 * c + CASE WHEN r < 366 THEN 0 ELSE 1 + (r - 366) // 365 END", "(CASE WHEN r < 366 THEN r ELSE (r - 366) % 365 END)", f"(CASE WHEN r < 366 THEN {_STARTS['all_leap']} ELSE {_STARTS['noleap']} END)"),
           *[f"SELECT p_partkey, '{c}', year(DATE '1852-01-01' + CAST(n AS INTEGER)), month(DATE '1852-01-01' + CAST(n AS INTEGER)), day(DATE '1852-01-01' + CAST(n AS INTEGER)) FROM k" for c in ("standard", "proleptic_gregorian")],
       ]))
def calendar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["360_day", "noleap", "all_leap", "julian", "standard", "proleptic_gregorian"]))
    days = (F.col("p_partkey") * 97 % 150000).cast("double") + 0.75
    rows = table(spark, sf_dir, "part").select("p_partkey", days.alias("t"), F.explode(names).alias("calendar"))
    civil = C.civil(F.col("calendar"), C.time_micros(F.col("t"), F.lit("days since 1852-01-01"), F.col("calendar")))
    return rows.withColumn("c", civil).select("p_partkey", "calendar", *[F.col(f"c.{x}").cast("long").alias(x) for x in ("year", "month", "day")])


@query("""WITH k AS (SELECT event_id, TIMESTAMP '2000-02-28 23:15:00' + to_minutes(CAST(30 * (event_id % 20000) AS BIGINT)) AS t FROM events)
  SELECT event_id, year(t) AS year, month(t) AS month, day(t) AS day, hour(t) AS hour, minute(t) AS minute FROM k""")
def times_of_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = (F.col("event_id") % 20000).cast("double") / 2
    civil = C.civil(F.lit("gregorian"), C.time_micros(hours, F.lit("hours since 2000-02-28 23:15:00"), F.lit("gregorian")))
    return table(spark, sf_dir, "events").select("event_id", civil.alias("c")).select("event_id", *[F.col(f"c.{x}").cast("long").alias(x) for x in ("year", "month", "day", "hour", "minute")])


@query(" UNION ALL ".join(f"SELECT event_id, '{k}' AS kind, strftime(ts, '{f}') AS stamp FROM events" for k, f in {**T.FORMATS, "d": "%Y-%m-%d"}.items()))
def range_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import fields

    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.explode(F.array(*map(F.lit, "shdmy"))).alias("kind"))
    return rows.select("event_id", "kind", fields(F.col("ts")).alias("f")).select("event_id", "kind", T.stamp(F.col("f"), F.col("kind"), {"d": "%Y-%m-%d"}).alias("stamp"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Time' WHEN 1 THEN 'TIME' WHEN 3 THEN 'time' WHEN 4 THEN 'Time' END AS time_name, CASE p_size % 5 WHEN 0 THEN 'TIME_BNDS' WHEN 1 THEN 'Time_Bounds' WHEN 3 THEN 'time_bnd' END AS bounds_name FROM part""")
def time_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda *x: F.array(*map(F.lit, x))
    k = F.col("p_size") % 5
    own = F.when(k == 0, names("lat", "Time", "TIME_BNDS")).when(k == 1, names("TIME", "time_bound", "Time_Bounds")).when(k == 2, names("lat")).when(k == 3, names("time_bnd", "time")).otherwise(names("time", "Time"))
    return table(spark, sf_dir, "part").select("p_partkey", variables.time_name(own).alias("time_name"), variables.bounds_name(own).alias("bounds_name"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN CAST(embedding[1] AS DOUBLE) ELSE CAST(list_min(embedding) AS DOUBLE) END AS low, CASE WHEN vec_id % 3 <> 0 THEN CAST(list_max(embedding) AS DOUBLE) END AS high FROM embeddings")
def dim_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 1)).otherwise(F.col("embedding")).cast("array<double>")
    both = table(spark, sf_dir, "embeddings").select("vec_id", variables.dim_bounds(axis).alias("b"))
    return both.select("vec_id", F.get("b", F.lit(0)).alias("low"), F.get("b", F.lit(1)).alias("high"))


@query("""WITH s AS (SELECT p_partkey, p_size % 3 AS k, p_partkey + 1 AS n FROM part)
  SELECT p_partkey, CASE k WHEN 2 THEN TRUE WHEN 0 THEN n < 512 OR n >= 512 ELSE n = 1 END AS conforms FROM s""")
def layout_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the policy conform, single steps do not (but for one step in all), contiguous variables do."""
    k, shape = F.col("p_size") % 3, F.array((F.col("p_partkey") + 1).cast("int"), F.lit(1024))
    steps = F.when(k == 0, chunks.time_chunk(shape, 8)).otherwise(F.lit(1).cast("long")).cast("int")
    layout = F.when(k != 2, F.array(steps, F.lit(1024)))
    return table(spark, sf_dir, "part").select("p_partkey", chunks.conforms(F.lit(False), F.lit(True), shape, layout, F.lit(8)).alias("conforms"))


@query("SELECT vec_id, len(embedding) // 2 AS width, CAST(round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), 3) AS DOUBLE) AS checksum FROM embeddings")
def paste_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a field of two rows, cut into two tiles with descending rows, and pasted by coordinates again."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.floor(F.size("embedding") / 2).cast("int").alias("w"))

    def tile(low: Column, high: Column) -> DataFrame:
        xs = F.sequence(low, high)
        data = F.flatten(F.transform(F.array(F.lit(1), F.lit(0)), lambda y: F.transform(xs, lambda x: F.get("v", y * F.col("w") + x))))
        coords = F.create_map(F.lit("y"), F.array(F.lit(1.0), F.lit(0.0)), F.lit("x"), xs.cast("array<double>"))
        return rows.select("vec_id", F.lit(0.0).alias("time"), coords.alias("coords"), data.alias("data"))

    half = F.floor(F.col("w") / 2).cast("int")
    whole = stitch.paste_tiles(tile(half, F.col("w") - 1).unionByName(tile(F.lit(0), half - 1)), ["vec_id"], ["y", "x"])
    check = F.aggregate(F.transform("data", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return whole.select("vec_id", F.get("shape", F.lit(1)).cast("long").alias("width"), F.round(check, 3).alias("checksum"))


# -- files

_written: dict[tuple[str, str], str] = {}


def _write(root: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            paths = []
            for g, q, steps in zip(pdf["g"], pdf["q"], pdf["steps"]):
                days = np.array([s["day"] for s in steps], float)
                data = np.array([[s["total"], s["n"]] for s in steps], float)
                own = {"time": cdf.Variable(["time"], days, {"units": UNITS, "calendar": "standard"}), "time_bnds": cdf.Variable(["time", "nbnd"], np.column_stack([days, days + 1])), "total": cdf.Variable(["time", "lat"], data, {"units": "1"})}
                path = f"{root}/in{g}.{q:05d}.nc"
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.tmp", "wb") as f:
                    f.write(cdf.write(cdf.Dataset({"time": len(days), "nbnd": 2, "lat": 2}, own, {"source": "orders", "number": int(q)}, "time")))
                os.replace(f"{path}.tmp", path)
                paths.append(path)
            yield pd.DataFrame({"path": paths})

    return run


def array_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with files of three months each: a day's sum of prices and number of orders. Written once for each session and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        ship(spark)
        root, date = scratch(spark), F.to_date("o_orderdate")
        rows = table(spark, sf_dir, "orders").select(_group(F.col("o_orderpriority")).alias("g"), F.floor((F.year(date) * 12 + F.month(date) - 1) / 3).cast("long").alias("q"), F.datediff(date, F.lit("1970-01-01")).alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("x"))
        days = rows.groupBy("g", "q", "day").agg(F.sum("x").cast("double").alias("total"), F.count("*").alias("n"))
        steps = days.groupBy("g", "q").agg(F.array_sort(F.collect_list(F.struct("day", "total", "n"))).alias("steps"))
        steps.mapInPandas(_write(root), "path string").count()
        _written[key] = root
    return _written[key]


@query(_files_sql(3) + " SELECT regexp_extract(path, '([^/]*)$', 1) AS name FROM f WHERE path GLOB '*h[13]*'")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.find_files(spark, array_files(spark, sf_dir) + "/in", "*.h[13].*.nc")
    return found.where("length > 0").select(P.basename(F.col("path")).alias("name"))


@query(_files_sql(3) + """ SELECT regexp_extract(path, '([^/]*)$', 1) AS name, n, CAST(date_diff('day', DATE '1970-01-01', d0) AS DOUBLE) AS first_time, date_diff('day', DATE '1970-01-01', d1) + 1.0 AS last_bound,
  'time:true,time_bnds:true,total:false' AS vars, 'time' AS time_name, 'time_bnds' AS bounds_name, CAST(q AS VARCHAR) AS number, CAST(n AS VARCHAR) || 'x2' AS shape, 'standard' AS calendar FROM f""")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows of real files."""
    hfc = HistoryCollection.open(spark, array_files(spark, sf_dir) + "/in").check_pulled()
    names = F.array_join(F.transform("variables", lambda v: F.concat(v["name"], F.lit(":"), v["secondary"].cast("string"))), ",")
    total = F.get(F.filter("variables", lambda v: v["name"] == "total"), F.lit(0))
    return hfc.frame.select(
        P.basename(F.col("path")).alias("name"), F.size("times").cast("long").alias("n"), F.get("times", F.lit(0)).alias("first_time"), F.element_at("bounds", -1)["hi"].alias("last_bound"), names.alias("vars"),
        "time_name", "bounds_name", F.regexp_extract(F.col("attrs")["number"], r"(\d+)", 1).alias("number"), F.array_join(total["shape"].cast("array<string>"), "x").alias("shape"), "calendar")


_SERIES = _sliced_sql(3, 3) + f""",
  s AS (SELECT g, s0, s1, min(day) AS d0, max(day) AS d1 FROM t GROUP BY ALL),
  x AS (SELECT s.*, delta FROM s JOIN {_DELTA} ON g = dg),
  z AS (SELECT g AS zg, s0 AS z0, regexp_extract(g, '([^/]*)$', 1) || '.total.' || {_STAMPS} || '.nc' AS name FROM x)"""


def _series(spark: SparkSession, sf_dir: str, out: str) -> OrderCollection:
    root = array_files(spark, sf_dir)
    hfc = HistoryCollection.open(spark, root + "/in").pull_metadata().slice_groups(3, start_year=None)
    orders = OrderCollection.build(hfc, f"{root}/{out}").apply_path_swap("/hist/", "/tseries/").add_attrs({"who": "me"})
    orders.create_directories()
    return orders


@query(_SERIES + """, v AS (SELECT '/' || lower(substr(o_orderpriority, 3)) || '/hist/case.h' || substr(o_orderpriority, 1, 1) AS vg, CAST(o_orderdate AS DATE) AS vday, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM orders GROUP BY ALL)
  SELECT name, date_diff('day', DATE '1970-01-01', day) AS day, total, v.n AS n FROM t JOIN z ON g = zg AND s0 = z0 JOIN v ON g = vg AND day = vday""")
def series_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to series: scan, plan, write, and read the outputs back."""
    orders = _series(spark, sf_dir, "out")
    orders.execute(raise_errors=True)
    rows = history.facts(spark, orders.output, variables=["total"])
    return rows.select(P.basename(F.col("path")).alias("name"), F.col("time").cast("long").alias("day"), F.round(F.get("data", F.lit(0)), 2).alias("total"), F.get("data", F.lit(1)).cast("long").alias("n"))


@query(_SERIES + """ SELECT name, 'skipped' AS status, 'me' AS who, TRUE AS complete FROM z""")
def series_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run finds all outputs complete; each carries the attributes given and the marker."""
    orders = _series(spark, sf_dir, "again")
    orders.execute(raise_errors=True)
    again = orders.execute(raise_errors=True).select(F.col("out_path").alias("path"), "status")
    outputs = history.catalog(spark, orders.output).select("path", F.col("attrs")["who"].alias("who"), F.map_contains_key("attrs", history.MARKER).alias("complete"))
    return again.join(outputs, "path").select(P.basename(F.col("path")).alias("name"), "status", "who", "complete")
