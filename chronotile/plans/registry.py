"""The queries of the change-detection engine and the SQL that states the same results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotile.functions import columns as C
from chronotile.operators import cm, grid, kernels, landcover, objects, obs, raster, scenes, segments
from chronotile.schema import BANDS, OBS, Grid
from chronotile.plans import workflows
from chronotile.sources import adapters as A
from chronotile.streaming import nrt

GRID = Grid(n_rows=100, n_cols=200, n_block_x=4, n_block_y=5)
YEARS = (1996, 1998, 2000)
_O, _S, _R = f"WITH obs AS ({A.DUCK_OBS})", f"WITH seg AS ({A.DUCK_SEGMENTS})", f"WITH ras AS ({A.DUCK_RASTER})"
_T = "(CASE WHEN thermal = 0 THEN 0 ELSE thermal * 10 - 27320 END)"
_VALID = f"blue > -200 AND blue < 10000 AND {' AND '.join(f'{b} > 0 AND {b} < 10000' for b in BANDS[1:6])} AND {_T} > -9320 AND {_T} < 7070 AND qa < 255"
_ORD = "date_diff('day', DATE '1970-01-01', {}) + 719163"
_DAY = "(DATE '1970-01-01' + CAST({} - 719163 AS INTEGER))"

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def note(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


def _clear(spark, d) -> DataFrame:
    return obs.one_a_day(obs.clear(A.obs(spark, d)))


_CLEAR = f"{_O}, clear AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos, date ORDER BY seq) AS nth FROM obs WHERE qa < 2 AND {_VALID}) WHERE nth = 1)"


@query(f"{_O} SELECT pos, seq, date, qa, {_VALID} AS valid, CAST({_T} AS INT) AS thermal_centi FROM obs")
def obs_valid(spark: SparkSession, d: str) -> DataFrame:
    return A.obs(spark, d).select("pos", "seq", "date", "qa", C.valid_range().alias("valid"), C.thermal_centi(F.col("thermal")).cast("int").alias("thermal_centi"))


@query(f"{_O}, t AS (SELECT pos, count(*) FILTER (qa < 2) AS n_clear, count(*) FILTER (qa = 1) AS n_water, count(*) FILTER (qa = 2) AS n_shadow, count(*) FILTER (qa = 3) AS n_snow, count(*) FILTER (qa = 4) AS n_cloud FROM obs WHERE {_VALID} GROUP BY pos) SELECT *, round(n_snow / (n_snow + n_clear + 0.01::DOUBLE), 6) AS snow_share, CASE WHEN n_clear >= 24 THEN 'standard' WHEN n_snow / (n_snow + n_clear + 0.01::DOUBLE) > 0.75 THEN 'snow' ELSE 'sparse' END AS route FROM t")
def qa_tally(spark, d):
    return obs.tally(A.obs(spark, d))


@query(f"{_CLEAR} SELECT pos, seq, date, {', '.join(BANDS)} FROM clear")
def obs_clear_daily(spark, d):
    return _clear(spark, d).select("pos", "seq", "date", *BANDS)


@query(f"{_O} SELECT pos, CAST(count(*) FILTER (date < b) AS BIGINT) AS n_descending FROM (SELECT pos, date, lag(date) OVER (PARTITION BY pos ORDER BY qa, seq) AS b FROM obs) GROUP BY pos")
def obs_ascending(spark, d):
    return obs.ascending(A.obs(spark, d).withColumn("seq", F.struct("qa", "seq")))


@query(f"{_CLEAR}, s AS (SELECT pos, lead(date) OVER w - date AS gap, {', '.join(f'abs(lead({b}) OVER w - {b}) AS {b}' for b in BANDS)} FROM clear WINDOW w AS (PARTITION BY pos ORDER BY date, seq)) SELECT pos, {', '.join(f'CAST(median({b}) AS DOUBLE) AS min_rmse_{b}' for b in BANDS)}, CAST(median(gap) AS DOUBLE) AS median_gap, max(gap) AS max_gap FROM s WHERE gap > 0 GROUP BY pos")
def min_rmse(spark, d):
    return obs.variability(_clear(spark, d))


@query(f"{_CLEAR}, s AS (SELECT pos, lead(date) OVER w - date AS gap, {', '.join(f'abs(lead({b}) OVER w - {b}) AS {b}' for b in BANDS)} FROM clear WINDOW w AS (PARTITION BY pos ORDER BY date, seq)) SELECT pos, {', '.join(f'CAST(median({b}) AS DOUBLE) AS min_rmse_{b}' for b in BANDS)}, CAST(median(gap) AS DOUBLE) AS median_gap, max(gap) AS max_gap FROM s WHERE gap > 5 GROUP BY pos")
def variogram_far_pairs(spark, d):
    return obs.variability(_clear(spark, d), least_gap=5)


@query(f"{_O} SELECT min(date) AS first, max(date) AS last, CAST((max(date) - min(date) + 1) // 60 + 1 AS BIGINT) AS n_maps FROM obs")
def dataset_range(spark, d):
    return obs.date_range(A.obs(spark, d))


_BREAKS = "SELECT o_custkey % 100 + 1 AS pos, CAST(" + _ORD.format("CAST(o_orderdate AS DATE)") + " AS INT) AS break_date FROM orders GROUP BY ALL"


@query(f"{_CLEAR}, b AS ({_BREAKS}), n AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY date, seq) - 1 AS k FROM clear) SELECT pos, break_date, CAST(k AS INT) AS \"at\", date FROM (SELECT n.pos, break_date, k, date, row_number() OVER (PARTITION BY n.pos, break_date ORDER BY abs(date - break_date), k) AS nth FROM n JOIN b ON n.pos = b.pos) WHERE nth = 1")
def nearest_break(spark, d):
    breaks = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 100 + 1).alias("pos"), C.ordinal(F.col("o_orderdate")).alias("break_date")).distinct()
    return obs.nearest(_clear(spark, d), breaks).select("pos", "break_date", "at", "date")


@query(f"{_CLEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY abs(round((730000 - date) / 365.25) * 365.25 - (730000 - date)), date, seq) AS k FROM clear) SELECT pos, round(sqrt(sum(CAST((green - 700) * (green - 700) AS DOUBLE)) / 16), 6) AS rmse FROM r WHERE k <= 24 GROUP BY pos")
def seasonal_nearest_rmse(spark, d):
    rows = _clear(spark, d).select("pos", "seq", "date", (F.col("green") - 700).cast("double").alias("residual"))
    return obs.seasonal_error(rows, 730000).select("pos", F.round("rmse", 6).alias("rmse"))

_STEPS = f"{_CLEAR}, s AS (SELECT pos, date, lead(date) OVER w - date AS gap, {', '.join(f'abs(lead({b}) OVER w - {b}) AS {b}' for b in BANDS)} FROM clear WINDOW w AS (PARTITION BY pos ORDER BY date, seq))"


@query(f"{_STEPS} SELECT pos, {', '.join(f'round(median({b} / gap) FILTER (gap < 91) * ((max(date) - min(date)) / (count(*) - 1)), 6) AS min_rmse_{b}' for b in BANDS)} FROM s GROUP BY pos HAVING count(*) > 1")
def variogram_slopes(spark, d):
    out = obs.variability_by_slope(_clear(spark, d)).filter("min_rmse_blue is not null")
    return out.select("pos", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(f"{_STEPS}, m AS (SELECT *, median(gap) OVER (PARTITION BY pos) AS mg FROM s WHERE gap IS NOT NULL) SELECT pos, {', '.join(f'CAST(median({b}) AS DOUBLE) AS min_rmse_{b}' for b in BANDS)} FROM m WHERE gap < 3 * mg GROUP BY pos")
def variogram_near_pairs(spark, d):
    return obs.variability_near_pairs(_clear(spark, d))


@query(f"{_STEPS} SELECT pos, CAST(median(nir) AS DOUBLE) AS min_rmse FROM s WHERE gap > 0 GROUP BY pos")
def variogram_band(spark, d):
    return obs.band_variability(_clear(spark, d), "nir")


@query(f"{_STEPS} SELECT pos, round(median(nir / gap), 6) AS min_rmse FROM s WHERE gap > 0 GROUP BY pos")
def variogram_band_by_day(spark, d):
    return obs.band_variability(_clear(spark, d), "nir", by_day=True).withColumn("min_rmse", F.round("min_rmse", 6))


@query(f"{_O} SELECT pos, seq, date FROM obs WHERE date BETWEEN 728500 AND 729500")
def obs_between(spark, d):
    return obs.between(A.obs(spark, d), 728500, 729500).select("pos", "seq", "date")


def _qa_case(rules, default):
    return "CASE " + " ".join(f"WHEN (w >> {k}) & 1 = 1 THEN {c}" for k, c in reversed(rules)) + f" ELSE {default} END"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, CAST({_qa_case([(1, 0), (2, 1), (4, 3), (3, 2), (5, 4)], 255)} AS INT) AS c1, CAST({_qa_case([(6, 0), (7, 1), (5, 3), (4, 2), (3, 4), (1, 4)], 255)} AS INT) AS c2, CAST(CASE WHEN w = 255 THEN 255 ELSE {_qa_case([(5, 1), (4, 3), (3, 2), (2, 4), (1, 4)], 0)} END AS INT) AS hls FROM (SELECT *, l_partkey % 256 AS w FROM lineitem)")
def qa_decode(spark, d):
    w = (F.col("l_partkey") % 256).cast("int")
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", C.qa_c1(w).alias("c1"), C.qa_c2(w).alias("c2"), C.qa_hls(w).alias("hls"))


@query("SELECT p_partkey, CAST(trunc(10000 * (v * 2.75e-5::DOUBLE - 0.2::DOUBLE)) AS SMALLINT) AS sr, CAST(trunc(10 * (v * 0.00341802::DOUBLE + 149)) AS SMALLINT) AS st FROM (SELECT p_partkey, 7273 + p_partkey * 31 % 36000 AS v FROM part)")
def c2_scale(spark, d):
    v = 7273 + F.col("p_partkey") * 31 % 36000
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", C.scale_reflectance(v).alias("sr"), C.scale_temperature(v).alias("st"))


@query(f"{_O} SELECT date, round(count(*) FILTER (qa < 2) / nullif(count(*) FILTER (qa <> 255), 0), 6) AS ratio FROM obs GROUP BY date HAVING count(*) FILTER (qa < 2) / nullif(count(*) FILTER (qa <> 255), 0) > 0.7")
def clear_ratio(spark, d):
    return scenes.clear_ratio(A.obs(spark, d), 0.7).withColumn("ratio", F.round("ratio", 6))


@query(f"{_O} SELECT pos, seq, date, CAST(CASE WHEN date % 2 <> s_nationkey % 2 THEN 255 ELSE qa END AS INT) AS qa FROM obs JOIN supplier ON pos = s_suppkey + 1")
def path_mask(spark, d):
    paths = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") + 1).alias("pos"), (F.col("s_nationkey") % 2).alias("path"))
    return scenes.one_path(A.obs(spark, d), paths, F.col("date") % 2).select("pos", "seq", "date", "qa")


@query(f"{_O} SELECT CAST((pos - 1) // 10 + 1 AS BIGINT) AS block_id, date, count(*) FILTER (qa IN (0, 1, 3)) AS n_useful FROM obs GROUP BY ALL HAVING n_useful > 0")
def block_skip(spark, d):
    return scenes.useful_blocks(A.obs(spark, d).withColumn("block_id", F.floor((F.col("pos") - 1) / 10) + 1))


@query('WITH p AS (SELECT p_partkey % 20000 + 1 AS pos FROM part GROUP BY ALL), g AS (SELECT pos, (pos - 1) // 200 + 1 AS "row", (pos - 1) % 200 + 1 AS col FROM p), b AS (SELECT *, (col - 1) // 50 + 1 AS block_x, ("row" - 1) // 20 + 1 AS block_y FROM g) SELECT *, (block_y - 1) * 4 + block_x AS block_id, ("row" - 1) % 20 AS in_row, (col - 1) % 50 AS in_col, "row" * 10000 + col AS rowcol FROM b')
def grid_index(spark, d):
    pixels = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % 20000 + 1).alias("pos")).distinct()
    return grid.index(pixels, GRID).withColumn("rowcol", F.col("row") * 10000 + F.col("col"))


@query("SELECT CAST(i AS INT) AS cm_idx, CAST(728000 + 60 * i AS INT) AS date FROM range(40) t(i)")
def anchors(spark, d):
    return grid.anchors(spark, 728000, 40)


@query(f"{_O} SELECT date, CAST(date - 723742 AS SMALLINT) AS since_launch, CAST(year(x) AS INT) AS year, CAST(dayofyear(x) AS INT) AS doy, 'CM_maps_' || date || '_' || year(x) || lpad(CAST(dayofyear(x) AS VARCHAR), 3, '0') AS name FROM (SELECT DISTINCT date, {_DAY.format('date')} AS x FROM obs)")
def date_parts(spark, d):
    n, day = F.col("date"), C.from_ordinal(F.col("date"))
    return A.obs(spark, d).select("date").distinct().select("date", C.since_launch(n).alias("since_launch"), F.year(day).alias("year"), F.dayofyear(day).alias("doy"), C.scene_name("CM_maps", n).alias("name"))


_MEASURE = f"{_O}, m AS (SELECT pos, date, CAST((seq * 37 + pos) % 500 AS DOUBLE) / 4 AS magnitude, CAST((seq * 13 + pos) % 120 AS DOUBLE) AS angle FROM obs)"
_CM = f"{_MEASURE}, v AS (SELECT pos, date, CAST((date - 728200) // 90 AS INT) AS cm_idx, least(floor(greatest(0, least(1, (90 - angle) / 45)) * magnitude * 100 + 0.5), 32767) AS cm FROM m WHERE date >= 728200), cmt AS (SELECT pos, cm_idx, CAST(cm AS SMALLINT) AS cm, CAST(date - 723742 AS SMALLINT) AS cm_date FROM (SELECT *, row_number() OVER (PARTITION BY pos, cm_idx ORDER BY cm DESC, date) AS k FROM v) WHERE k = 1)"


def _measures(spark, d):
    return A.obs(spark, d).select("pos", "date", ((F.col("seq") * 37 + F.col("pos")) % 500).cast("double").alias("m"), ((F.col("seq") * 13 + F.col("pos")) % 120).cast("double").alias("angle")).select("pos", "date", (F.col("m") / 4).alias("magnitude"), "angle").filter("date >= 728200")


@query(f"{_CM} SELECT * FROM cmt")
def cm_bucket_max(spark, d):
    return cm.bucket_max(_measures(spark, d), 728200, 90)


@query(f"{_CM}, h AS (SELECT pos, cm_idx, CAST(CASE WHEN (pos + cm_idx) % 3 = 0 THEN -9999 ELSE cm END AS SMALLINT) AS cm, CAST(CASE WHEN (pos + cm_idx) % 3 = 0 THEN -9999 ELSE cm_date END AS SMALLINT) AS cm_date FROM cmt), b AS (SELECT *, lag(cm) OVER w AS pc, lag(cm_date) OVER w AS pd, lag(cm_idx) OVER w AS pi FROM h WINDOW w AS (PARTITION BY pos ORDER BY cm_idx)) SELECT pos, cm_idx, CASE WHEN cm = -9999 AND pi = cm_idx - 1 AND pc >= 924 THEN pc ELSE cm END AS cm, CASE WHEN cm = -9999 AND pi = cm_idx - 1 AND pc >= 924 THEN pd ELSE cm_date END AS cm_date FROM b")
def cm_prev_fill(spark, d):
    holes = (F.col("pos") + F.col("cm_idx")) % 3 == 0
    rows = cm.bucket_max(_measures(spark, d), 728200, 90)
    return cm.fill_previous(rows.withColumns({"cm": F.when(holes, -9999).otherwise(F.col("cm")).cast("smallint"), "cm_date": F.when(holes, -9999).otherwise(F.col("cm_date")).cast("smallint")}), 924)


@query(f"{_S}, a AS (SELECT pos, seg, magnitude, lag(magnitude) OVER (PARTITION BY pos ORDER BY seg) AS was FROM seg) SELECT pos, seg, round(degrees(acos(greatest(-1, least(1, list_sum(list_transform(range(1, 8), lambda i: CAST(magnitude[i] AS DOUBLE) * CAST(was[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(magnitude, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(was, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))))))), 4) AS angle FROM a WHERE was IS NOT NULL AND list_max(list_transform(was, lambda x: abs(x))) > 0 AND list_max(list_transform(magnitude, lambda x: abs(x))) > 0")
def residual_angle(spark, d):
    from pyspark.sql import Window

    m = F.col("magnitude").cast("array<double>")
    rows = A.segments(spark, d).select("pos", "seg", m.alias("magnitude")).withColumn("was", F.lag("magnitude").over(Window.partitionBy("pos").orderBy("seg")))
    some = F.col("was").isNotNull() & F.exists("was", lambda x: x != 0) & F.exists("magnitude", lambda x: x != 0)
    return rows.filter(some).select("pos", "seg", F.round(C.angle_between(F.col("magnitude"), F.col("was")), 4).alias("angle"))


_DAYS = f"days AS (SELECT CAST({_ORD.format('make_date(y, 7, 1)')} AS INT) AS \"day\" FROM (VALUES {', '.join(f'({y})' for y in YEARS)}) t(y))"
_HELD = "held AS (SELECT s.*, \"day\" FROM (SELECT *, coalesce(lead(t_start) OVER (PARTITION BY pos ORDER BY t_start, seg), {}) AS t_until FROM seg) s JOIN days ON \"day\" >= t_start AND \"day\" < t_until)"
_YEAR_END = _ORD.format(f"make_date(year({_DAY.format('t_end')}), 12, 31)") + " + 1"


def _days(spark):
    return spark.createDataFrame([(y,) for y in YEARS], "y int").select(C.ordinal(F.make_date("y", F.lit(7), F.lit(1))).alias("day"))


@query(f"{_S}, {_DAYS}, {_HELD.format('t_end + 1')} SELECT pos, seg, \"day\" FROM held")
def segment_at_day(spark, d):
    return segments.at_day(A.segments(spark, d), _days(spark)).select("pos", "seg", "day")


@query(f"{_S}, {_DAYS}, {_HELD.format(_YEAR_END)} SELECT pos, seg, \"day\" FROM held")
def segment_at_day_year_end(spark, d):
    return segments.at_day(A.segments(spark, d), _days(spark), to_year_end=True).select("pos", "seg", "day")


def _feature_sql(band: int) -> str:
    c = f"coefs[{band + 1}]"
    each = {"a0": f"{c}[1] + CAST({c}[2] AS DOUBLE) * \"day\" / 10000.0::DOUBLE", "c1": f"CAST({c}[2] AS DOUBLE) / 10000.0::DOUBLE"} | {n: f"CAST({c}[{k}] AS DOUBLE)" for k, n in enumerate(("a1", "b1", "a2", "b2", "a3", "b3"), 3)} | {"error": f"CAST(rmse[{band + 1}] AS DOUBLE)"}
    return f"{_S}, {_DAYS}, {_HELD.format('t_end + 1')}, p AS (SELECT DISTINCT pos FROM seg) SELECT pos, \"day\", " + ", ".join(f"round(coalesce({e}, -9999), 6) AS {n}" for n, e in each.items()) + ' FROM (SELECT * FROM p, days) JOIN_ LEFT JOIN held USING (pos, "day")'


@query(_feature_sql(3).replace("JOIN_ ", "AS q "))
def features(spark, d):
    s = A.segments(spark, d).withColumns({"coefs": F.col("coefs").cast("array<array<double>>")})
    out = segments.features(s, s.select("pos").distinct(), _days(spark), 3)
    return out.select("pos", "day", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


_M = "magnitude[4] > -{0} AND magnitude[3] < {0} AND magnitude[5] < {0}"
_GROW = "coalesce(nc[4][2] > abs(coefs[4][2]) AND nc[3][2] < -abs(coefs[3][2]) AND nc[5][2] < -abs(coefs[5][2]), false)"
_NEXT = "nx AS (SELECT *, lead(coefs) OVER (PARTITION BY pos ORDER BY t_start, seg) AS nc FROM seg)"
_KINDS = f"{_S}, {_NEXT}, kinds AS (SELECT pos, seg, t_break, CAST(CASE WHEN {_M.format(200)} AND {_GROW} THEN 3 WHEN {_M.format(200)} THEN 2 ELSE 1 END AS INT) AS kind FROM nx WHERE t_break > 0 AND change_prob = 100)"


@query(f"{_KINDS} SELECT * FROM kinds")
def break_category(spark, d):
    return segments.category(A.segments(spark, d)).select("pos", "seg", "t_break", "kind")


@query(f"{_S} SELECT pos, seg, t_break, CAST(CASE WHEN {_M.format(200)} THEN 2 ELSE 1 END AS INT) AS kind FROM seg WHERE t_break > 0 AND change_prob = 100")
def break_category_nrt(spark, d):
    return segments.category(A.segments(spark, d), "sccd").select("pos", "seg", "t_break", "kind")


_PREV = "pv AS (SELECT *, lag(t_break) OVER w AS pb, lag(magnitude) OVER w AS pm FROM nx WINDOW w AS (PARTITION BY pos ORDER BY t_start, seg))"
_FLIP = "len(list_filter(range(2, 7), lambda b: magnitude[b] * pm[b] < 0)) >= 4"


@query(f"WITH RECURSIVE seg AS ({A.DUCK_SEGMENTS}), {_NEXT}, {_PREV}, pl AS (SELECT pos, seg, t_break, CASE WHEN {_M.format(250)} AND {_GROW} THEN 3 WHEN {_M.format(250)} THEN 2 ELSE 1 END AS plain, coalesce(t_break - pb <= 365.25 * 5 AND {_FLIP}, false) AS back, row_number() OVER (PARTITION BY pos ORDER BY t_start, seg) AS k FROM pv WHERE t_break > 0 AND change_prob = 100), r AS (SELECT pos, seg, t_break, plain AS kind, k FROM pl WHERE k = 1 UNION ALL SELECT pl.pos, pl.seg, pl.t_break, CASE WHEN pl.plain = 1 AND pl.back AND r.kind = 1 THEN 4 ELSE pl.plain END, pl.k FROM r JOIN pl ON pl.pos = r.pos AND pl.k = r.k + 1) SELECT pos, seg, t_break, CAST(kind AS INT) AS kind FROM r")
def break_category_object(spark, d):
    return segments.category_obcold(A.segments(spark, d))


_MAP = f"{_KINDS}, bm AS (SELECT pos, year(x) AS year, kind * 1000 + dayofyear(x) AS value FROM (SELECT *, {_DAY.format('t_break')} AS x, row_number() OVER (PARTITION BY pos, year({_DAY.format('t_break')}) ORDER BY t_break DESC) AS k FROM kinds) WHERE k = 1)"


def _distinct_days(s):
    """Segments without breaks that share pixel and day, so that the last break of a year is one."""
    from pyspark.sql import Window

    return s.withColumn("__k", F.row_number().over(Window.partitionBy("pos", "t_break").orderBy(F.desc("seg")))).filter("__k = 1 OR t_break = 0").drop("__k")


@query(_MAP.replace("ORDER BY t_break DESC", "ORDER BY t_break DESC, seg DESC") + " SELECT pos, CAST(year AS INT) AS year, CAST(value AS INT) AS value FROM bm")
def break_map(spark, d):
    return segments.break_map(_distinct_days(segments.category(A.segments(spark, d))))


@query(_MAP.replace("ORDER BY t_break DESC", "ORDER BY t_break DESC, seg DESC") + ", p AS (SELECT DISTINCT pos FROM seg) SELECT pos, CAST(coalesce(min(year) FILTER (value // 1000 = 1), 0) AS INT) AS first_year, CAST(coalesce(max(year) FILTER (value // 1000 = 1), 0) AS INT) AS recent_year FROM p LEFT JOIN bm USING (pos) GROUP BY pos")
def first_recent_disturbance(spark, d):
    s = A.segments(spark, d)
    return segments.first_recent(segments.break_map(_distinct_days(segments.category(s))), s.select("pos").distinct())


@query(f"{_S} SELECT pos, CAST(year({_DAY.format('min(t_break)')}) AS INT) AS year FROM seg WHERE t_break > 0 AND magnitude[4] < 0 GROUP BY pos")
def first_degradation(spark, d):
    return segments.first_shift(A.segments(spark, d), 3, up=False)


@query(f"{_R} SELECT s1, round(CASE WHEN s1 = 0 THEN -9999 ELSE avg(cm) END, 6) AS mean FROM ras GROUP BY s1")
def object_mean(spark, d):
    return objects.object_mean(A.raster(spark, d)).withColumn("mean", F.round("mean", 6))


@query(f"{_R} SELECT s1, cls AS mode FROM (SELECT s1, cls, row_number() OVER (PARTITION BY s1 ORDER BY count(*) DESC, cls) AS k FROM ras GROUP BY s1, cls) WHERE k = 1")
def mode_by(spark, d):
    return objects.mode_by(A.raster(spark, d), "s1", "cls")


@query(f"{_R}, f AS (SELECT * FROM ras WHERE cm > 2) SELECT s1, mode, median FROM (SELECT s1, cls AS mode, row_number() OVER (PARTITION BY s1 ORDER BY count(*) DESC, cls) AS k FROM f GROUP BY s1, cls) JOIN (SELECT s1, median(cm) AS median FROM f GROUP BY s1) USING (s1) WHERE k = 1")
def mode_median_by(spark, d):
    rows = A.raster(spark, d).withColumn("cm", F.when(F.col("cm") > 2, F.col("cm")).otherwise(F.lit(float("nan"))))
    return objects.mode_median_by(rows, "s1", "cls", "cm")


@query(f"{_R} SELECT pos, s2, count(*) OVER (PARTITION BY s2) AS size FROM ras")
def patch_size(spark, d):
    return objects.patch_size(A.raster(spark, d)).select("pos", "s2", "size")


_CHANGE = f"ch AS (SELECT * FROM (VALUES {', '.join(f'({k}, {a}::DOUBLE, {b}::DOUBLE)' for k, (a, b) in objects.CHANGE.items())}) t(cls, slope, threshold))"


@query(f"{_R}, {_CHANGE}, o AS (SELECT s1, avg(cm) AS mean, count(*) AS size, CAST(max(cls) AS INT) AS cls FROM ras WHERE s1 > 0 GROUP BY s1) SELECT s1, cls, size, mean * least(0.95::DOUBLE + log10(size) * slope, 2) > threshold AS changed FROM o JOIN ch USING (cls)")
def is_change_object(spark, d):
    rows = A.raster(spark, d).filter("s1 > 0").groupBy("s1").agg(F.avg("cm").alias("mean"), F.count("*").alias("size"), F.max("cls").alias("cls"))
    return objects.is_change(rows).select("s1", "cls", "size", "changed")


@query(f"{_R}, {_CHANGE}, z AS (SELECT *, count(*) OVER (PARTITION BY s2) AS size FROM ras WHERE s2 > 0), md AS (SELECT s1, cls FROM (SELECT s1, cls, row_number() OVER (PARTITION BY s1 ORDER BY count(*) DESC, cls) AS k FROM z GROUP BY s1, cls) WHERE k = 1), o AS (SELECT s1, max(size) AS size FROM z GROUP BY s1), mm AS (SELECT s1, avg(cm) AS mean FROM ras GROUP BY s1) SELECT pos FROM ras SEMI JOIN (SELECT s1 FROM o JOIN md USING (s1) JOIN mm USING (s1) JOIN ch USING (cls) WHERE s1 > 0 AND mean * least(0.95::DOUBLE + log10(size) * slope, 2) > threshold) c USING (s1)")
def object_analysis(spark, d):
    rows = A.raster(spark, d)
    return objects.analyse(rows.select("pos", "s1", "s2", "cm"), rows.select("pos", "cls"))


@query(f"{_R} SELECT pos, greatest(0, least(1, (cm - 2.5::DOUBLE) / 15)) AS x FROM ras")
def normalize_clip(spark, d):
    return A.raster(spark, d).select("pos", C.normalize_clip(F.col("cm"), 2.5, 17.5).alias("x"))


@query(f"{_R}, n AS (SELECT cls, count(*) AS n FROM ras GROUP BY cls) SELECT cls, n, CAST(least(greatest(least(round_even(n * 300 / sum(n) OVER (), 0), 60), 20), n) AS BIGINT) AS n_sample FROM n")
def class_sampling(spark, d):
    return landcover.allocation(A.raster(spark, d), 300, 20, 60)


@query(f"{_S}, {_DAYS} SELECT pos, seg, \"day\", round(coefs[2][1] + CAST(coefs[2][2] AS DOUBLE) / 10000.0::DOUBLE * \"day\" + " + " + ".join(f"CAST(coefs[2][{2 * k + 1}] AS DOUBLE) * cos(\"day\" * {k * C.W!r}::DOUBLE) + CAST(coefs[2][{2 * k + 2}] AS DOUBLE) * sin(\"day\" * {k * C.W!r}::DOUBLE)" for k in (1, 2, 3)) + ", 4) AS value FROM seg, days")
def harmonic_prediction(spark, d):
    s = A.segments(spark, d).select("pos", "seg", F.col("coefs")[1].cast("array<double>").alias("c"))
    return s.crossJoin(F.broadcast(_days(spark))).select("pos", "seg", "day", F.round(C.harmonic(F.col("c"), F.col("day")), 4).alias("value"))

def _duck_angle(a: str, b: str) -> str:
    norm = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
    dot = f"list_sum(list_transform(range(1, 8), lambda i: {a}[i] * {b}[i]))"
    return f"CASE WHEN {norm(a)} > 0 AND {norm(b)} > 0 THEN degrees(acos(greatest(-1, least(1, {dot} / ({norm(a)} * {norm(b)}))))) END"


_VECTORS = f"{_S}, v AS (SELECT pos, seg, list_transform(magnitude, lambda x: CAST(x AS DOUBLE)) AS v FROM seg), a AS (SELECT *, lag(v) OVER (PARTITION BY pos ORDER BY seg) AS was, [{', '.join(f'median(v[{k}]) OVER (PARTITION BY pos)' for k in range(1, 8))}] AS middle FROM v)"


@query(f"{_VECTORS}, d AS (SELECT pos, CASE WHEN was IS NOT NULL THEN {_duck_angle('v', 'was')} END AS step, {_duck_angle('v', 'middle')} AS off FROM a) SELECT pos, round(avg(step), 4) AS mean, round(median(step), 4) AS median, round(avg(off), 4) AS mean_to_median FROM d GROUP BY pos")
def residual_angles(spark, d):
    out = segments.angles(A.segments(spark, d))
    return out.select("pos", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


@query(f"{_S}, i AS (SELECT pos, list(t_break ORDER BY seg) AS ids FROM seg GROUP BY pos) SELECT pos, CAST(len(list_filter(ids, lambda x: x <> 0)) AS INT) AS n_ids FROM i")
def count_ids(spark, d):
    ids = A.segments(spark, d).groupBy("pos").agg(F.collect_list("t_break").alias("ids"))  # a pixel has a few dozen segments
    return ids.select("pos", segments.count_ids(F.col("ids")).alias("n_ids"))


@query("SELECT p_partkey, CAST(CASE " + " ".join(f"WHEN p_partkey % 100 IN ({', '.join(map(str, codes))}) THEN {g}" for g, codes in C.LAND_COVER.items()) + " ELSE -9999 END AS INT) AS cover FROM part")
def land_cover_group(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", C.land_cover_group(F.col("p_partkey") % 100).alias("cover"))


@query(f"{_R}, n AS (SELECT cls, count(*) AS n FROM ras GROUP BY cls), k AS (SELECT cls, CAST(least(greatest(least(round_even(n * 300 / sum(n) OVER (), 0), 60), 20), n) AS BIGINT) AS n_sample FROM n) SELECT pos, cls FROM (SELECT pos, cls, n_sample, row_number() OVER (PARTITION BY cls ORDER BY md5(pos || '-42'), pos) AS nth FROM ras JOIN k USING (cls)) WHERE nth <= n_sample")
def class_sample(spark, d):
    rows = A.raster(spark, d).select("pos", "cls")
    return landcover.sample(rows, landcover.allocation(rows, 300, 20, 60), most=60)


@query(f"{_CM}, ch AS (SELECT DISTINCT pos, cm_idx FROM cmt WHERE (pos + cm_idx) % 4 = 0) SELECT pos, CAST(cm_date + 723742 AS INT) AS break_date FROM cmt JOIN ch USING (pos, cm_idx) WHERE cm_date <> -9999")
def change_dates(spark, d):
    rows = cm.bucket_max(_measures(spark, d), 728200, 90)
    return workflows.change_maps(rows.filter((F.col("pos") + F.col("cm_idx")) % 4 == 0).select("pos", "cm_idx"), rows)


@query(f"{_S}, {_DAYS}, {_HELD.format('t_end + 1')}, p AS (SELECT DISTINCT pos FROM seg) SELECT pos, CAST(year({_DAY.format('\"day\"')}) AS INT) AS year, band, round(coalesce(coefs[band + 1][1] + CAST(coefs[band + 1][2] AS DOUBLE) * \"day\" / 10000.0::DOUBLE, -9999), 6) AS a0, round(coalesce(CAST(coefs[band + 1][3] AS DOUBLE), -9999), 6) AS a1 FROM (SELECT * FROM p, days, (SELECT unnest(range(7)) AS band)) q LEFT JOIN held USING (pos, \"day\")")
def yearly_features(spark, d):
    s = A.segments(spark, d).withColumn("coefs", F.col("coefs").cast("array<array<double>>"))
    rows = workflows.yearly_features(s, s.select("pos").distinct(), list(YEARS), names=("a0", "a1"))
    each = rows.select("pos", "year", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda b: F.struct(F.get("f", 2 * b).alias("a0"), F.get("f", 2 * b + 1).alias("a1")))).alias("band", "x"))
    return each.select("pos", "year", F.col("band").cast("long").alias("band"), F.round("x.a0", 6).alias("a0"), F.round("x.a1", 6).alias("a1"))



@query()
def cold(spark, d):
    return kernels.detect(A.obs(spark, d))


@query()
def obcold(spark, d):
    breaks = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") + 1).alias("pos"), F.lit(729701).alias("break_date"))
    return kernels.reconstruct(A.obs(spark, d), breaks)


@query()
def cold_magnitudes(spark, d):
    return kernels.magnitudes(A.obs(spark, d), 728000, 50, 60)


@query()
def sccd(spark, d):
    return nrt.detect(A.obs(spark, d))


@query()
def sccd_change_magnitude(spark, d):
    return nrt.change_magnitude(nrt.detect(A.obs(spark, d)))


@query()
def sccd_update(spark, d):
    o = A.obs(spark, d)
    return nrt.update(nrt.detect(o.filter("date < 729900")), o.filter("date >= 729900"))


@query()
def sccd_identify(spark, d):
    return nrt.identify(nrt.detect(A.obs(spark, d)))


def _shared(spark) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of this machine if all runs here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return (found or f"file://{tempfile.gettempdir()}").rstrip("/")


@query()
def sccd_stream(spark, d):
    """The observations as a stream of two batches; the newest state of each pixel."""
    base = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    o = A.obs(spark, d)
    for k, part in enumerate((o.filter("date < 729900"), o.filter("date >= 729900"))):
        part.write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(OBS).parquet(f"{base}/in")
        q = nrt.stream(source).writeStream.outputMode("update").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{base}/out/batch={n}")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return nrt.latest(spark.read.parquet(f"{base}/out"))


@query()
def forest_landcover(spark, d):
    """Classes of vectors by a forest that learned from a stratified sample of them."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("f"), F.col("label").alias("cls"))
    labels = e.select("pos", "cls")
    model = landcover.train(e.select("pos", "f"), landcover.sample(labels, landcover.allocation(labels, 400, 20, 100)), trees=20, depth=8)
    return landcover.classify(e.select("pos", F.lit(2001).alias("year"), "f"), model)


def _raster_maps(spark, d) -> DataFrame:
    """Two maps of 50 columns: bumps over parts."""
    n = F.col("p_partkey")
    bump = F.greatest(F.lit(0), 25 - F.abs(n % 50 - 12)) * F.greatest(F.lit(0), 12 - F.abs(F.floor(n / 50) % 25 - 11))
    part = spark.read.parquet(f"{d}/part.parquet")
    maps = part.select((n + 1).alias("pos"), F.explode(F.array(F.lit(1), F.lit(2))).alias("cm_idx"), bump.alias("bump"), "p_size")
    return maps.select("pos", "cm_idx", (F.col("bump") * 12 * F.col("cm_idx") + F.col("p_size")).cast("smallint").alias("cm"), F.lit(5000).cast("smallint").alias("cm_date"))


def _segmented(spark, d, method):
    rows = _raster_maps(spark, d)
    return raster.segment(rows, Grid(n_rows=-(-rows.agg(F.max("pos")).first()[0] // 50), n_cols=50), method)


@query()
def segment_floodfill(spark, d):
    return _segmented(spark, d, "floodfill")


@query()
def segment_slic(spark, d):
    return _segmented(spark, d, "slic")


@query()
def segment_watershed(spark, d):
    return _segmented(spark, d, "watershed")


@query()
def obcold_objects(spark, d):
    """Magnitudes, objects, confirmed breaks and segments over the observations as a tile of ten columns."""
    o = A.obs(spark, d)
    rows = -(-o.agg(F.max("pos")).first()[0] // 10)
    return workflows.object_based(o, Grid(n_rows=rows, n_cols=10), 728000, 45, 60)


def entry(spark: SparkSession) -> DataFrame:
    return cold(spark, "/root/testdata/sf0.001")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict:
    return dict(SQL)
