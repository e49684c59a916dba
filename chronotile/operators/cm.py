"""Change magnitudes by pixel and interval (schema.CM)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotile.functions import columns as C
from chronotile.schema import LAUNCH, NO_DATA


def bucket_max(measures: DataFrame, start: int, interval: int = 60) -> DataFrame:
    """Of (pos, date, magnitude, angle) the largest weighted magnitude of each interval and its day (of equals the first)."""
    value = F.least(F.floor(C.angle_decay(F.col("angle")) * F.col("magnitude") * 100 + 0.5), F.lit(32767))
    rows = measures.select("pos", "date", F.floor((F.col("date") - start) / interval).cast("int").alias("cm_idx"), value.cast("smallint").alias("cm"))
    best = rows.groupBy("pos", "cm_idx").agg(F.min_by(F.struct("cm", "date"), F.struct(-F.col("cm"), F.col("date"))).alias("m"))
    return best.select("pos", "cm_idx", F.col("m.cm").alias("cm"), (F.col("m.date") - LAUNCH).cast("smallint").alias("cm_date"))


def fill_previous(cm: DataFrame, least: int | None = None) -> DataFrame:
    """A missing magnitude is taken, with its day, from the interval before (if it is at least `least` there)."""
    w = Window.partitionBy("pos").orderBy("cm_idx")
    before, day = F.lag("cm").over(w), F.lag("cm_date").over(w)
    there = (F.lag("cm_idx").over(w) == F.col("cm_idx") - 1) & (before != NO_DATA)
    if least is not None:
        there &= before >= least
    take = (F.col("cm") == NO_DATA) & F.coalesce(there, F.lit(False))
    return cm.select("pos", "cm_idx", F.when(take, before).otherwise(F.col("cm")).alias("cm"), F.when(take, day).otherwise(F.col("cm_date")).alias("cm_date"))


def to_maps(cm: DataFrame, path: str) -> None:
    """One folder an interval."""
    cm.repartition("cm_idx").write.partitionBy("cm_idx").mode("overwrite").parquet(path)
