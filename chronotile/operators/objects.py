"""Objects over change-magnitude maps: statistics, modes, sizes, and which objects changed.

Rasters are long tables: (pos, s1, s2, cm) with labels of two scales, 0 for none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotile.schema import NO_CLASS, NO_DATA

#: Class -> (slope of the size factor, threshold): what an object's weighted magnitude must exceed.
CHANGE = {1: (0.1, 11.07), 2: (0.05, 15.086), 3: (0.05, 15.086), 4: (0.1, 11.07), 5: (0.05, 15.086), 6: (0.1, 11.07), 7: (0.05, 15.086), 8: (0.05, 15.086), NO_CLASS: (0.0, 11.07)}


def object_mean(labels: DataFrame, label: str = "s1", value: str = "cm") -> DataFrame:
    """Mean of a value by label; label 0 is no object."""
    return labels.groupBy(label).agg(F.avg(value).alias("mean")).select(label, F.when(F.col(label) == 0, F.lit(float(NO_DATA))).otherwise(F.col("mean")).alias("mean"))


def mode_by(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group; of equals the smallest."""
    return rows.groupBy(group).agg(F.mode(value, True).alias("mode"))


def mode_median_by(rows: DataFrame, group: str, value: str, measure: str) -> DataFrame:
    """mode_by, with the median of a measure; NaN and null count for neither."""
    return rows.filter(~F.isnan(measure) & F.col(measure).isNotNull()).groupBy(group).agg(F.mode(value, True).alias("mode"), F.median(measure).alias("median"))


def patch_size(rows: DataFrame, patch: str = "s2") -> DataFrame:
    return rows.withColumn("size", F.count("*").over(Window.partitionBy(patch)))


def is_change(objects: DataFrame, change: dict = CHANGE) -> DataFrame:
    """Objects (mean, size, cls) with whether they changed: the mean, weighted by a factor of up to 2 that grows with
    the log of the patch's size, exceeds the threshold of the class."""
    spark = objects.sparkSession
    table = F.broadcast(spark.createDataFrame([(k, *v) for k, v in change.items()], "cls int, slope double, threshold double"))
    factor = F.least(F.lit(0.95) + F.log10("size") * F.col("slope"), F.lit(2.0))
    return objects.join(table, "cls").withColumn("changed", F.col("mean") * factor > F.col("threshold")).drop("slope", "threshold")


def analyse(labels: DataFrame, classes: DataFrame, change: dict = CHANGE) -> DataFrame:
    """The pixels (pos) of changed objects. labels: pos, s1 (superpixel), s2 (patch), cm; classes: pos, cls."""
    rows = patch_size(labels.filter("s2 > 0"), "s2")
    mean = object_mean(labels, "s1").withColumnRenamed("mean", "object_mean")
    objects = rows.join(classes, "pos", "left").groupBy("s1").agg(F.max("size").alias("size"), F.mode(F.coalesce("cls", F.lit(NO_CLASS)), True).alias("cls"))
    objects = objects.join(mean, "s1").withColumnRenamed("object_mean", "mean").filter("s1 > 0")
    changed = is_change(objects, change).filter("changed").select("s1")
    return labels.join(changed, "s1", "left_semi").select("pos")
