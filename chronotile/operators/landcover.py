"""Land cover from model features: samples by class, a forest, classified maps."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotile.schema import NO_CLASS, NO_DATA


def allocation(labels: DataFrame, total: int = 20000, least: int = 600, most: int = 8000) -> DataFrame:
    """By class (cls) how many samples to draw: in proportion, within bounds, never more than there are."""
    counts = labels.groupBy("cls").agg(F.count("*").alias("n"))
    all_ = F.sum("n").over(Window.partitionBy())  # one row a class
    share = F.bround(F.col("n") * total / all_)
    return counts.select("cls", "n", F.least(F.greatest(F.least(share, F.lit(most)), F.lit(least)), F.col("n")).cast("long").alias("n_sample"))


def sample(labels: DataFrame, plan: DataFrame, seed: int = 42, most: int = 8000) -> DataFrame:
    """So many pixels of each class, chosen by a hash of pos. most: no class gets more (as in allocation), so that each task
    sends its first rows of a class only."""
    nth = F.row_number().over(Window.partitionBy("cls").orderBy(F.md5(F.concat_ws("-", "pos", F.lit(seed))), "pos"))
    first = labels.withColumn("__nth", nth).filter(F.col("__nth") <= most)
    return first.join(F.broadcast(plan.select("cls", "n_sample")), "cls").filter("__nth <= n_sample").drop("__nth", "n_sample")


def train(features: DataFrame, labels: DataFrame, trees: int = 100, depth: int = 20) -> RandomForestClassificationModel:
    """features: pos, f (array of numbers); labels: pos, cls."""
    rows = features.join(labels, "pos").select(array_to_vector("f").alias("features"), F.col("cls").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42).fit(rows)


def classify(features: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """(pos, year, cls); NO_CLASS where all features are missing."""
    out = model.transform(features.withColumn("features", array_to_vector("f")))
    empty = F.forall("f", lambda x: x == NO_DATA)
    return out.select("pos", "year", F.when(empty, NO_CLASS).otherwise(F.col("prediction").cast("int")).cast("smallint").alias("cls"))


def save(model: RandomForestClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> RandomForestClassificationModel:
    return RandomForestClassificationModel.load(path)


def write_years(maps: DataFrame, path: str) -> None:
    """Classified maps (pos, year, cls), one folder a year."""
    maps.repartition("year").write.partitionBy("year").mode("overwrite").parquet(path)


def read_years(spark, path: str, years: list[int] | None = None) -> DataFrame:
    """(pos, year, cls); of given years only their folders are read."""
    maps = spark.read.schema("pos long, cls smallint, year int").parquet(path)
    return (maps.filter(F.col("year").isin(years)) if years is not None else maps).select("pos", "year", "cls")
