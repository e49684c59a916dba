"""Scenes: which scenes, blocks and pixels are worth keeping. Rows are of schema.OBS."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotile.schema import FILL


def clear_ratio(obs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Scenes (date, ratio) whose share of clear and water among filled pixels is above the threshold; none is left out for 0."""
    seen = F.count_if(F.col("qa") != FILL)
    ratio = F.when(F.lit(threshold) <= 0, F.lit(1.0)).otherwise(F.try_divide(F.count_if(F.col("qa") < 2).cast("double"), seen.cast("double")))
    return obs.groupBy("date").agg(ratio.alias("ratio")).filter(F.col("ratio") > threshold)


def one_path(obs: DataFrame, paths: DataFrame, of_date) -> DataFrame:
    """Fill pixels of scenes that another path than the pixel's own (pos, path) took. of_date: the path of a date."""
    other = of_date != F.col("path")
    return obs.join(F.broadcast(paths) if paths.count() <= 1_000_000 else paths, "pos").withColumn("qa", F.when(other, FILL).otherwise(F.col("qa"))).drop("path")


def useful_blocks(obs: DataFrame) -> DataFrame:
    """(block_id, date) with any clear, water or snow pixel."""
    return obs.groupBy("block_id", "date").agg(F.count_if(F.col("qa").isin(0, 1, 3)).alias("n_useful")).filter("n_useful > 0")
