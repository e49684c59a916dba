"""Views of general tables as the engine's inputs, so that every operator can be queried and held against SQL.

Observations come of lineitem (a supplier is a pixel, a ship date a day), segments of orders (a customer is
a pixel), rasters of part. All values are integer arithmetic on keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronotile.schema import ORDINAL

_TRI = "abs(d % 365 - 182)"
_JUMP = "(CASE WHEN pos % 3 = 0 AND d > 729700 THEN {} ELSE 0 END)"
#: Bands over o (order), p (part), n (line), d (day), pos: a season, some noise, a jump in every third pixel, odd values.
_BANDS = {
    "blue": f"CASE WHEN (o + p) % 97 = 0 THEN 20000 ELSE 400 + (o * 7 + p) % 60 + {_JUMP.format(400)} END",
    "green": f"600 + {_TRI} + (o * 13 + p * 7) % 80 + {_JUMP.format(500)}",
    "red": f"500 + {_TRI} + (o * 11 + p * 3) % 80 + {_JUMP.format(700)}",
    "nir": f"3000 - 4 * {_TRI} + (o * 5 + p) % 120 - {_JUMP.format(1200)}",
    "swir1": f"1800 - {_TRI} + (o * 3 + p * 5) % 110 + {_JUMP.format(900)}",
    "swir2": f"900 + (o * 17 + p) % 90 + {_JUMP.format(600)}",
    "thermal": "CASE WHEN (o + n) % 89 = 0 THEN 0 ELSE 2900 + (o * 3 + p) % 50 END",
}
_QA = "CASE WHEN (o + n) % 11 = 0 THEN 4 WHEN (o + n) % 13 = 0 THEN 2 WHEN (o + n) % 17 = 0 THEN 3 WHEN (o + n) % 19 = 0 THEN 1 WHEN (o + p) % 101 = 0 THEN 255 ELSE 0 END"


def obs_sql(days: str) -> str:
    """days: how the dialect turns a date into days since 1970."""
    bands = ", ".join(f"CAST({e} AS INT) AS {b}" for b, e in _BANDS.items())
    return f"""SELECT pos, CAST(seq AS INT) AS seq, CAST(d AS INT) AS date, {bands}, CAST({_QA} AS INT) AS qa FROM (
  SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY d, l_shipdate, o, n, p, l_quantity, l_extendedprice) AS seq, d, o, p, n FROM (
    SELECT l_suppkey + 1 AS pos, {days} + {ORDINAL} AS d, l_orderkey AS o, l_partkey AS p, l_linenumber AS n, l_shipdate, l_quantity, l_extendedprice FROM lineitem) AS named) AS source"""


def segments_sql(days: str, numbers) -> str:
    """numbers: how the dialect makes an array of x (an expression over k) for k from 0 to below n, of (n, x)."""
    seven = numbers
    coefs = seven(7, f"({seven(8, 'CAST((o * (k1 * 8 + k2 + 5)) % 2003 - 1000 AS FLOAT)', 'k2')})", "k1")
    return f"""SELECT pos, CAST(seg AS INT) AS seg, CAST(d AS INT) AS t_start, CAST(coalesce(later - 16, d + 400) AS INT) AS t_end, CAST(coalesce(later, 0) AS INT) AS t_break,
  CAST(20 + o % 50 AS INT) AS num_obs, CAST(8 AS SMALLINT) AS category, CAST(CASE WHEN later IS NULL THEN 0 WHEN o % 7 = 0 THEN 50 ELSE 100 END AS SMALLINT) AS change_prob,
  {coefs} AS coefs, {seven(7, 'CAST((o * (k1 + 11)) % 300 AS FLOAT)', 'k1')} AS rmse, {seven(7, 'CAST((o * (k1 + 3)) % 1201 - 600 AS FLOAT)', 'k1')} AS magnitude
FROM (SELECT *, row_number() OVER w - 1 AS seg, lead(d) OVER w AS later FROM (
  SELECT o_custkey + 1 AS pos, o_orderkey AS o, {days} + {ORDINAL} AS d FROM orders) AS s WINDOW w AS (PARTITION BY pos ORDER BY d, o)) AS t"""


def _spark_array(n, x, k):
    return f"transform(sequence(0, {n - 1}), {k} -> {x})"


def _duck_array(n, x, k):
    return f"list_transform(range({n}), lambda {k}: {x})"


SPARK_OBS, DUCK_OBS = obs_sql("unix_date(CAST(l_shipdate AS DATE))"), obs_sql("date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))")
SPARK_SEGMENTS, DUCK_SEGMENTS = segments_sql("unix_date(CAST(o_orderdate AS DATE))", _spark_array), segments_sql("date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))", _duck_array)
#: Labels of two scales, classes and magnitudes over a raster of parts; 0 is no object.
RASTER = """SELECT p_partkey + 1 AS pos, CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey / {div} % 40 + 1 END AS INT) AS s1,
  CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey / {div} % 8 + 1 END AS INT) AS s2, CAST(p_size % 8 + 1 AS INT) AS cls, CAST(p_partkey * 37 % 2500 AS DOUBLE) / 100 AS cm FROM part"""
SPARK_RASTER, DUCK_RASTER = RASTER.replace("p_partkey / {div}", "p_partkey div 50"), RASTER.replace("p_partkey / {div}", "p_partkey // 50")


def _sql(spark: SparkSession, sf_dir: str, table: str, text: str) -> DataFrame:
    view = f"source_{table}"
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(view)
    return spark.sql(text.replace(f"FROM {table}", f"FROM {view}"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "lineitem", SPARK_OBS)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "orders", SPARK_SEGMENTS)


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "part", SPARK_RASTER)
