"""Registered queries of the engine's own operators over the driver's tables, each with its SQL.

The tables stand in for history files: order and ship dates are time axes, numeric columns are primary
variables, flags, priorities and event types are groups, page urls are paths, embeddings are array fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import timestamps as T
from ..functions.globs import find_all_indices, matches
from ..operators import stitch, timeline, variables
from ..session import table
from . import chunks
from .registry import ORACLE_SQL, QUERIES, Query
from .registry import query as _query

VARIABLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def micros(col: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")


def fields(date: Column) -> Column:
    """Civil fields of a timestamp, as calendars.civil gives them."""
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
    return F.struct(*[f(date).alias(name) for name, f in parts.items()])


def _month(date: Column) -> Column:
    return T.stamp(fields(date), F.lit("m"))


def _exact(col: str) -> Column:
    return F.sum(F.col(col).cast("decimal(18,4)"))


@_query("""WITH u AS (UNPIVOT (SELECT l_returnflag AS grp, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
    ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME variable VALUE val)
  SELECT grp, CAST(1995 + 2 * floor((year(l_shipdate) - 1995) / 2.0) AS INTEGER) AS slice_start, variable,
    count(DISTINCT l_shipdate) AS n_steps, strftime(min(l_shipdate), '%Y%m') || '-' || strftime(max(l_shipdate), '%Y%m') AS ts_string,
    CAST(round(sum(CAST(val AS DECIMAL(18,4))), 2) AS DOUBLE) AS total
  FROM u GROUP BY ALL""")
def flagship_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_shipdate", *VARIABLES)
    # Sums per day first, for all variables at once: the unpivot and the distinct count then see one row a day.
    days = rows.groupBy("grp", "l_shipdate").agg(*[_exact(v).alias(v) for v in VARIABLES])
    long = days.withColumn("slice_start", T.slice_start(F.year("l_shipdate"), 2, 1995)).unpivot(["grp", "slice_start", "l_shipdate"], VARIABLES, "variable", "val")
    return long.groupBy("grp", "slice_start", "variable").agg(
        F.count("*").alias("n_steps"), F.concat(_month(F.min("l_shipdate")), F.lit("-"), _month(F.max("l_shipdate"))).alias("ts_string"),
        F.round(F.sum("val"), 2).cast("double").alias("total"),
    )


@_query("SELECT page_id, url FROM pages WHERE url GLOB '*e*' OR url GLOB 'http*1'")
def path_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url").where(matches(F.col("url"), ["*e*", "http*1"]))


@_query("SELECT page_id, url FROM pages WHERE NOT (url GLOB '*[02468]' OR url GLOB '*/a*')")
def path_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url").where(~matches(F.col("url"), ["*[02468]", "*/a*"]))


@_query("""SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, count(*) AS n_files, min(page_id) AS first_page FROM pages GROUP BY 1""")
def group_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(P.parent(F.col("url")).alias("parent")).agg(F.count("*").alias("n_files"), F.min("page_id").alias("first_page"))


@_query("""WITH n AS (SELECT '/h/' || e.event_type || '/case.' || e.event_type || '.' || (e.user_id % 10) || '.nc' AS path FROM events e)
  SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^(.*)[.][^.]*[.][^.]*$', 1) || '*' AS group_id, count(*) AS n, min(path) AS first_path FROM n GROUP BY 1""")
def group_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("/h/"), t, F.lit("/case."), t, F.lit("."), (F.col("user_id") % 10).cast("string"), F.lit(".nc")).alias("path"))
    return rows.groupBy(P.group_id(F.col("path")).alias("group_id")).agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@_query("""SELECT c_custkey, '/out/' || lower(c_mktsegment) || '/tseries/' || c_name AS template FROM customer""")
def output_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.concat(F.lit("/in/"), F.lower("c_mktsegment"), F.lit("/hist/"), F.col("c_name"), F.lit("*"))
    return table(spark, sf_dir, "customer").select("c_custkey", P.output_template(group, "/in", "/out").alias("template"))


@_query("""SELECT p_partkey, array_to_string(list_filter(range(0, greatest(length(p_name), 1)), lambda i: substr(p_name, CAST(i AS INTEGER) + 1, 1) = 'a'), ',') AS starts FROM part""")
def find_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(find_all_indices(F.col("p_name"), "a").cast("array<string>"), ",").alias("starts"))


def _aligned(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
        rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        low, high = micros("o_orderdate"), micros("l_shipdate")
        return rows.select("l_orderkey", "l_linenumber", T.aligned(high, low, high, method).alias("instant"))

    return run


_EPOCH = {"midpoint": "epoch_us(o_orderdate) + CAST(floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 2) AS BIGINT)", "direct_time": "epoch_us(l_shipdate)", "start_bound": "epoch_us(o_orderdate)", "end_bound": "epoch_us(l_shipdate)"}
for _m, _sql in _EPOCH.items():
    QUERIES[f"align_{_m}"] = _aligned(_m)
    ORACLE_SQL[f"align_{_m}"] = f"SELECT l_orderkey, l_linenumber, {_sql} AS instant FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@_query("""WITH d AS (SELECT DISTINCT event_type, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS n FROM d)
  SELECT a.event_type, epoch_us(a.ts) - epoch_us(b.ts) AS delta FROM r a LEFT JOIN r b ON a.event_type = b.event_type AND b.n = 2 WHERE a.n = 1""")
def timestep_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.timestep_delta(table(spark, sf_dir, "events").select("event_type", micros("ts").alias("t")), ["event_type"], "t")


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.withColumn("delta", (micros("l_shipdate") - micros("o_orderdate")) * F.col("l_linenumber"))


_GAP_SQL = "SELECT l_orderkey, l_linenumber, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) * l_linenumber AS delta FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@_query(f"""WITH g AS ({_GAP_SQL}), h AS (SELECT *, round_even(delta / 3600000000, 0) AS hours FROM g), d AS (SELECT *, round_even(hours / 24, 0) AS days FROM h),
  m AS (SELECT *, round_even(days / 30, 0) AS months FROM d), y AS (SELECT *, round_even(months / 12, 0) AS years FROM m)
  SELECT l_orderkey, l_linenumber, CASE WHEN hours < 24 THEN 'hour_' || CAST(hours AS BIGINT) WHEN days < 28 THEN 'day_' || CAST(days AS BIGINT)
    WHEN months < 12 THEN 'month_' || CAST(months AS BIGINT) ELSE 'year_' || CAST(years AS BIGINT) END AS label FROM y""")
def timestep_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select("l_orderkey", "l_linenumber", T.step_label(F.col("delta")).alias("label"))


@_query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN delta < 60000000 THEN 's' WHEN delta < 86400000000 THEN 'h' WHEN delta < 28 * 86400000000 THEN 'd'
    WHEN delta / 86400000000 / 30 < 12 THEN 'm' ELSE 'y' END AS kind FROM ({_GAP_SQL})""")
def timestamp_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select("l_orderkey", "l_linenumber", T.format_kind(F.col("delta")).alias("kind"))


@_query("SELECT o_orderpriority, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year FROM orders GROUP BY 1")
def year_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.year_bounds(table(spark, sf_dir, "orders"), ["o_orderpriority"], F.year("o_orderdate"))


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate")
    return timeline.with_slices(rows, ["o_orderpriority"], F.year("o_orderdate"), 3, None)


_SLICED = """WITH b AS (SELECT o_orderpriority, min(year(o_orderdate)) AS y0, max(year(o_orderdate)) AS y1 FROM orders GROUP BY 1),
  s AS (SELECT o.o_orderpriority, o_orderdate, CAST(CASE WHEN 3 >= y1 - y0 THEN y0 ELSE y0 + 3 * floor((year(o_orderdate) - y0) / 3.0) END AS INTEGER) AS slice_start,
    y0, y1 FROM orders o JOIN b ON o.o_orderpriority = b.o_orderpriority),
  t AS (SELECT o_orderpriority, o_orderdate, slice_start, CAST(CASE WHEN 3 >= y1 - y0 THEN y1 ELSE slice_start + 2 END AS INTEGER) AS slice_end FROM s)"""


@_query(_SLICED + " SELECT o_orderpriority, slice_start, slice_end, count(*) AS n FROM t GROUP BY ALL")
def year_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sliced(spark, sf_dir).groupBy("o_orderpriority", "slice_start", "slice_end").agg(F.count("*").alias("n"))


@_query(_SLICED + """, a AS (SELECT DISTINCT o_orderpriority, slice_start, slice_end, o_orderdate FROM t),
  r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) - 1 AS i FROM a)
  SELECT o_orderpriority, slice_start, slice_end, min(i) AS start_index, max(i) + 1 AS end_index FROM r GROUP BY ALL""")
def slice_index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.slice_index_ranges(_sliced(spark, sf_dir), ["o_orderpriority"], "o_orderdate", ["slice_start", "slice_end"])


@_query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 OR p_size % 3 = 0 OR p_size % 5 = 0 THEN TRUE ELSE FALSE END AS secondary FROM part""")
def classify_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    name = F.when(size % 4 == 0, "Time_Bnds").otherwise(F.col("p_brand"))
    dims = F.when(size % 3 == 0, F.array(F.lit("time"), F.lit("nbnd"))).when(size % 5 == 0, F.array(F.lit("time"), F.lit("time"))).otherwise(F.array(F.lit("time"), F.lit("lat")))
    return table(spark, sf_dir, "part").select("p_partkey", variables.is_secondary(name, dims).alias("secondary"))


@_query("""WITH f AS (SELECT event_id, user_id, event_type FROM events), c AS (SELECT user_id, event_type, count(*) AS n FROM f GROUP BY ALL),
  m AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS most FROM c), u AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS ties FROM m WHERE n = most)
  SELECT f.event_id, f.user_id, f.event_type FROM f JOIN u ON f.user_id = u.user_id AND f.event_type = u.event_type WHERE u.ties = 1""")
def majority_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variables.majority_schema(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_type")


@_query("""SELECT user_id, event_type AS key, arg_max(CAST(event_id AS VARCHAR), event_id) AS value FROM events GROUP BY ALL""")
def attr_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.create_map("event_type", F.col("event_id").cast("string")).alias("attrs"))
    return variables.attributes_last_wins(rows, ["user_id"], "attrs", "event_id")


@_query("""WITH c AS (SELECT l_returnflag, l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL)
  SELECT l_returnflag, min(n) = max(n) AS consistent, max(n) > 1 AS fragmented, min(n) AS min_tiles, max(n) AS max_tiles FROM c GROUP BY 1""")
def tile_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitch.tile_consistency(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_shipdate")


@_query("SELECT l_returnflag, 'quantity' AS dim, array_to_string(list_sort(list(DISTINCT CAST(l_quantity AS INTEGER))), ',') AS axis FROM lineitem GROUP BY 1")
def concat_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.lit("quantity").alias("dim"), F.array(F.col("l_quantity").cast("int")).alias("coords"))
    out = stitch.concat_coords(rows, ["l_returnflag"], "dim", "coords")
    return out.withColumn("axis", F.array_join(F.col("axis").cast("array<string>"), ","))


@_query("SELECT vec_id, len(embedding) AS n, CAST(round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), 3) AS DOUBLE) AS checksum FROM embeddings")
def stitch_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Cut each field into two tiles, shuffle the cells, and paste them by index again.
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    left, right = cells.where("pos % 2 = 0"), cells.where("pos % 2 = 1")
    whole = stitch.stitch(right.unionByName(left).withColumn("pos", F.col("pos").cast("long")), ["vec_id"], "pos", "x")
    check = F.aggregate(F.transform("data", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return whole.select("vec_id", F.size("data").cast("long").alias("n"), F.round(check, 3).alias("checksum"))


@_query("""SELECT vec_id, CASE WHEN len(embedding) * (vec_id + 1) * 100 * 8 < 4194304 THEN len(embedding) ELSE greatest(1, CAST(floor(4194304 / ((vec_id + 1) * 100 * 8)) AS BIGINT)) END AS chunk FROM embeddings""")
def chunk_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.array(F.size("embedding"), (F.col("vec_id") + 1).cast("int"), F.lit(100))
    return table(spark, sf_dir, "embeddings").select("vec_id", chunks.time_chunk(shape, 8).alias("chunk"))


from . import collection_queries  # noqa: E402, F401  registers the queries over catalogs
