"""Whole runs over a tile: detection by block, and the object-based chain from magnitudes to segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotile.functions import columns as C
from chronotile.operators import cm, kernels, landcover, objects, raster, segments
from chronotile.schema import LAUNCH, NO_DATA, Grid
from chronotile.streaming import nrt


def change_maps(changed: DataFrame, magnitudes: DataFrame) -> DataFrame:
    """(pos, break_date) of changed pixels (pos, cm_idx): the day of their largest magnitude in the interval."""
    days = magnitudes.select("pos", "cm_idx", (F.col("cm_date") + LAUNCH).cast("int").alias("break_date")).filter(F.col("cm_date") != NO_DATA)
    return changed.join(days, ["pos", "cm_idx"]).select("pos", "break_date")


def object_based(obs: DataFrame, grid: Grid, start: int, n_cm: int, interval: int = 60, method: str = "floodfill", classes: DataFrame | None = None) -> DataFrame:
    """Segments between break days that objects of changed pixels confirm. classes: (pos, year, cls); an interval uses
    the year before its own, at the earliest the first."""
    least = 924 if method == "floodfill" else None  # a flood takes a magnitude of before only above its seeds' bound, 9.236
    found = cm.fill_previous(kernels.magnitudes(obs, start, n_cm, interval), least).filter(F.col("cm") != NO_DATA).persist()  # read three times
    labels = raster.segment(found, grid, method).filter("cm_idx > 0")  # nothing stands before the first interval
    size = F.count("*")
    patches = labels.filter("s2 > 0").groupBy("cm_idx", "s2").agg(size.alias("size"))
    rows = labels.filter("s1 > 0").join(patches, ["cm_idx", "s2"])
    if classes is None:
        rows = rows.withColumn("cls", F.lit(255))
    else:
        first = classes.agg(F.min("year")).first()[0]
        rows = rows.withColumn("year", F.greatest(F.year(C.from_ordinal(F.col("cm_idx") * interval + start)) - 1, F.lit(first)))
        rows = rows.join(classes, ["pos", "year"], "left").withColumn("cls", F.coalesce("cls", F.lit(255)).cast("int"))
    each = rows.groupBy("cm_idx", "s1").agg(F.max("size").alias("size"), F.mode("cls", True).alias("cls"), F.first("cm").alias("mean"))
    changed = objects.is_change(each).filter("changed").select("cm_idx", "s1")
    return kernels.reconstruct(obs, change_maps(labels.join(changed, ["cm_idx", "s1"], "left_semi").select("pos", "cm_idx"), found))


def yearly_features(found: DataFrame, pixels: DataFrame, years: list[int], bands: int = 7, names=("a0", "a1", "b1")) -> DataFrame:
    """(pos, year, f): features at 1 July of each year, band after band."""
    spark = found.sparkSession
    days = spark.createDataFrame([(y,) for y in years], "year int").select("year", C.ordinal(F.make_date("year", F.lit(7), F.lit(1))).alias("day"))
    held = segments.at_day(found, days.select("day"))
    c = F.col("coefs")
    terms = {"a0": lambda b: c[b][0] + c[b][1] * F.col("day") / 10000.0, "c1": lambda b: c[b][1] / 10000.0} | {n: (lambda b, k=k: c[b][k].cast("double")) for k, n in enumerate(("a1", "b1", "a2", "b2", "a3", "b3"), 2)} | {"error": lambda b: F.col("rmse")[b].cast("double")}
    each = [F.coalesce(F.nanvl(terms[n](b).cast("double"), F.lit(0.0)), F.lit(float(NO_DATA))) for b in range(bands) for n in names]
    every = pixels.select("pos").crossJoin(F.broadcast(days))  # a day a year; all bands come of one segment, and so of one join
    return every.join(held, ["pos", "day"], "left").select("pos", "year", F.array(*each).alias("f"))


def features_now(packs: DataFrame, day: int, names=("a0", "a1", "b1")) -> DataFrame:
    """(pos, day, f): features of the models that packs stand on, at a day, band after band (six; the thermal one has none and is NO_DATA);
    a pixel without a model has NO_DATA alone."""
    rows = nrt.nested(packs).select("pos", "model")
    c = F.col("model.coefs")
    n = F.greatest(F.col("model.num_obs") - 6, F.lit(1))
    terms = {"a0": lambda b: c[b][0] + c[b][1] * day / 10000.0, "c1": lambda b: c[b][1] / 10000.0} | {x: (lambda b, k=k: c[b][k]) for k, x in enumerate(("a1", "b1", "a2", "b2"), 2)} | {"error": lambda b: F.sqrt(F.col("model.rmse_sum")[b] / n)}
    missing = F.lit(float(NO_DATA))
    each = [F.coalesce(terms[x](b), missing) if b < 6 else missing for b in range(7) for x in names]
    return rows.select("pos", F.lit(day).alias("day"), F.array(*each).alias("f"))


def classify_now(packs: DataFrame, model, day: int) -> DataFrame:
    """(pos, year, cls): a forest applied to the models that packs stand on."""
    found = features_now(packs, day)
    return landcover.classify(found.select("pos", F.year(C.from_ordinal(F.col("day"))).alias("year"), "f"), model)


def classify_years(found: DataFrame, labels: DataFrame, years: list[int], train_year: int, trees: int = 100, depth: int = 20) -> DataFrame:
    """(pos, year, cls): a forest learned at train_year from labelled pixels (pos, cls), applied to all years."""
    pixels = found.select("pos").distinct()
    drawn = landcover.sample(labels, landcover.allocation(labels))
    model = landcover.train(yearly_features(found, pixels, [train_year]).select("pos", "f"), drawn, trees, depth)
    return landcover.classify(yearly_features(found, pixels, years), model)
