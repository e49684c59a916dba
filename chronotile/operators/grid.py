"""Pixels, blocks and map intervals. pos counts from 1, rows first; blocks count from 1, x fastest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotile.schema import Grid


def index(pixels: DataFrame, grid: Grid) -> DataFrame:
    """(pos) with row and col (from 1), block_x, block_y, block_id, and the row and column in the block (from 0)."""
    out = pixels.withColumn("row", F.floor((F.col("pos") - 1) / grid.n_cols) + 1).withColumn("col", (F.col("pos") - 1) % grid.n_cols + 1)
    out = out.withColumn("block_x", F.floor((F.col("col") - 1) / grid.block_width) + 1).withColumn("block_y", F.floor((F.col("row") - 1) / grid.block_height) + 1)
    out = out.withColumn("block_id", (F.col("block_y") - 1) * grid.n_block_x + F.col("block_x"))
    return out.withColumn("in_row", (F.col("row") - 1) % grid.block_height).withColumn("in_col", (F.col("col") - 1) % grid.block_width)


def rowcol_image(pixels: DataFrame, grid: Grid) -> DataFrame:
    """A raster that names its pixels: row * 10000 + col, both from 1."""
    return index(pixels, grid).select("pos", (F.col("row") * 10000 + F.col("col")).alias("value"))


def anchors(spark: SparkSession, start: int, n: int, interval: int = 60) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("cm_idx"), (F.col("id") * interval + start).cast("int").alias("date"))
