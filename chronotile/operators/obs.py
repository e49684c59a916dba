"""Observations: screening, tallies, variability, gaps. Rows are of schema.OBS; order within a day is seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotile.functions import columns as C
from chronotile.schema import BANDS



def series():
    return Window.partitionBy("pos").orderBy("date", "seq")


def tally(obs: DataFrame) -> DataFrame:
    """By pixel how many valid observations are clear (water among them), water, shadow, snow, cloud; the snow share; the route."""
    v = obs.filter(C.valid_range())
    out = v.groupBy("pos").agg(*[F.count_if(cond).alias(n) for n, cond in (("n_clear", F.col("qa") < 2), ("n_water", F.col("qa") == 1), ("n_shadow", F.col("qa") == 2), ("n_snow", F.col("qa") == 3), ("n_cloud", F.col("qa") == 4))])
    share = F.col("n_snow") / (F.col("n_snow") + F.col("n_clear") + 0.01)
    return out.withColumn("snow_share", F.round(share, 6)).withColumn("route", F.when(F.col("n_clear") >= 24, "standard").when(share > 0.75, "snow").otherwise("sparse"))


def clear(obs: DataFrame) -> DataFrame:
    """Clear observations in range. A filter would have what bands are computed from put into each of its conditions, which
    took six times as long as all else; a generator's input is evaluated once a row."""
    return obs.select(F.inline(F.when((F.col("qa") < 2) & C.valid_range(), F.array(F.struct(*obs.columns)))))


def one_a_day(obs: DataFrame) -> DataFrame:
    """Of a pixel's observations on a day the first."""
    before = F.lag(F.struct("date")).over(series())  # a window by pixel and day would be opened for every row or two
    return obs.withColumn("__before", before).filter("__before IS NULL OR NOT __before.date <=> date").drop("__before")


def ascending(obs: DataFrame) -> DataFrame:
    """Pixels and how many of their observations, in the order of seq, are earlier than the one before."""
    before = F.lag("date").over(Window.partitionBy("pos").orderBy("seq"))
    return obs.withColumn("__late", F.col("date") < before).groupBy("pos").agg(F.count_if("__late").alias("n_descending"))


def variability(obs: DataFrame, least_gap: int = 0) -> DataFrame:
    """By pixel and band the median absolute difference of successive observations (more than least_gap days
    apart), with the median and the largest gap in days."""
    gap = (F.lead("date").over(series()) - F.col("date")).alias("gap")
    steps = obs.select("pos", gap, *[F.abs(F.lead(b).over(series()) - F.col(b)).alias(b) for b in BANDS]).filter(F.col("gap") > least_gap)
    return steps.groupBy("pos").agg(*[F.median(b).alias(f"min_rmse_{b}") for b in BANDS], F.median("gap").alias("median_gap"), F.max("gap").alias("max_gap"))


def date_range(obs: DataFrame, interval: int = 60) -> DataFrame:
    """First and last day of all, and how many magnitude maps of `interval` days they need."""
    return obs.agg(F.min("date").alias("first"), F.max("date").alias("last")).withColumn("n_maps", F.floor((F.col("last") - F.col("first") + 1) / interval) + 1)


def nearest(obs: DataFrame, breaks: DataFrame) -> DataFrame:
    """For each (pos, break_date) the observation on that day, else the nearest (of equals the first), by its number from 0."""
    numbered = obs.withColumn("at", F.row_number().over(series()) - 1)
    away = F.abs(F.col("date") - F.col("break_date"))
    return numbered.join(breaks, "pos").groupBy("pos", "break_date").agg(F.min_by(F.struct("at", "date"), F.struct(away, F.col("at"))).alias("m")).select("pos", "break_date", F.col("m.at").alias("at"), F.col("m.date").alias("date"))


def seasonal_error(residuals: DataFrame, day: int, n: int = 24, df: int = 8) -> DataFrame:
    """By pixel the error at a day's season: of the n residuals (pos, seq, date, residual) nearest to it in the year."""
    off = F.lit(day) - F.col("date")
    away = F.abs(F.round(off / 365.25) * 365.25 - off)
    nth = F.row_number().over(Window.partitionBy("pos").orderBy(away, "date", "seq"))
    return residuals.withColumn("__nth", nth).filter(F.col("__nth") <= n).groupBy("pos").agg(F.sqrt(F.sum(F.col("residual") * F.col("residual")) / (n - df)).alias("rmse"))


def _steps(obs: DataFrame) -> DataFrame:
    gap = F.lead("date").over(series()) - F.col("date")
    return obs.select("pos", "date", gap.alias("gap"), *[F.abs(F.lead(b).over(series()) - F.col(b)).alias(b) for b in BANDS])


def variability_by_slope(obs: DataFrame, most_gap: int = 91) -> DataFrame:
    """By pixel and band the median change a day over gaps of less than most_gap days, times the mean gap of the series."""
    mean_gap = (F.max("date") - F.min("date")) / (F.count("*") - 1)
    slopes = [F.median(F.when(F.col("gap") < most_gap, F.col(b) / F.col("gap"))).alias(f"__{b}") for b in BANDS]
    rows = _steps(obs).groupBy("pos").agg(*slopes, F.when(F.count("*") > 1, mean_gap).alias("__gap"))
    return rows.select("pos", *[(F.col(f"__{b}") * F.col("__gap")).alias(f"min_rmse_{b}") for b in BANDS])


def variability_near_pairs(obs: DataFrame, factor: float = 3.0) -> DataFrame:
    """By pixel and band the median absolute difference over gaps of less than `factor` times the pixel's median gap."""
    median_gap = F.median("gap").over(Window.partitionBy("pos"))
    rows = _steps(obs).filter("gap is not null").withColumn("__most", median_gap * factor).filter("gap < __most")
    return rows.groupBy("pos").agg(*[F.median(b).alias(f"min_rmse_{b}") for b in BANDS])


def band_variability(obs: DataFrame, band: str, by_day: bool = False) -> DataFrame:
    """By pixel the median absolute difference of a band between successive observations; by_day: each divided by its gap first."""
    step = F.col(band) / F.col("gap") if by_day else F.col(band)
    return _steps(obs).filter("gap > 0").groupBy("pos").agg(F.median(step).alias("min_rmse"))


def between(obs: DataFrame, first: int, last: int) -> DataFrame:
    """Observations of the days from first to last, both included."""
    return obs.filter(F.col("date").between(first, last))
